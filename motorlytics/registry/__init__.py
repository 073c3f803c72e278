"""Registered queries: one per operator ID, each a Spark builder
``(spark, sf_dir) -> DataFrame`` with (where SQL can say it) an oracle twin.

Builders read the driver tables through ``sources.fixtures`` and run over
whole tables. Output columns carry explicit names and types so the oracle's
result schema is the same. Modules register in dependency order (the SQL
building blocks of later modules refer to those of earlier ones).
"""

from motorlytics.registry import core  # noqa: F401 - registers first
from motorlytics.registry import features, scoring, profile, dashboards, evaluation, training, io, serving  # noqa: F401
from motorlytics.registry.core import ORACLE, REGISTRY, engineered, latest, requisition  # noqa: F401


def queries():
    return dict(REGISTRY)


def oracle_sql():
    return dict(ORACLE)


__all__ = ["core", "queries", "oracle_sql", "REGISTRY", "ORACLE"]
