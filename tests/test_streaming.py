"""Checklist what-if as a stream: adjusted features and in-stream scoring."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from motorlytics.operators import scoring as SC
from motorlytics.sources.fixtures import inspection_items
from tests.conftest import SF_SMALL


def test_stream_scores_every_request(spark, monkeypatch):
    from motorlytics.operators import training as TR
    from motorlytics.registry import training as RT
    monkeypatch.setattr(RT, "_MODELS", {})
    monkeypatch.setitem(TR.GBT_PARAMS, "maxIter", 4)  # the stream is tested here, not the fit
    out = E.queries()["d03_checklist_stream_scored"](spark, SF_SMALL)
    n_req = inspection_items(spark, SF_SMALL).count()
    assert out.count() == n_req
    assert out.where((F.col("health_score") < 5) | (F.col("health_score") > 99)).count() == 0
    total = sum((F.col(c) for c in SC.COMPONENT_COLUMNS.values()), F.lit(0.0))
    assert out.where((F.abs(total - 1.0) > 0.002) & (total != 0)).count() == 0


def test_stream_matches_batch_adjustments(spark):
    stream = E.queries()["d03_checklist_stream"](spark, SF_SMALL)
    cols = [c for c in stream.columns if c != "request_id"]
    assert stream.select(*cols).where(~F.col("found")).count() == 0
    assert stream.select("request_id").distinct().count() == stream.count()
