"""motorlytics — motor-repair predictive-maintenance analytics on Spark.

Every operator is a ``DataFrame -> DataFrame`` function written against the
public PySpark API so that Catalyst plans it and the cluster scales it.

Sub-packages
------------
sources     table scans, the requisition fixture, sinks and persistence
functions   column-expression helpers (rounding, clipping, hashing, scores)
operators   features, profiling, scoring, dashboards, model evaluation/training
plans       plan-shape helpers (bucketed prefix sums) and the batch lifecycle
streaming   checklist what-if scoring as a stream-static join
"""

from motorlytics.session import get_spark, ensure_checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "ensure_checkpoint_dir"]
