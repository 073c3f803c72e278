"""The query registry (see ``motorlytics.registry``)."""

from motorlytics.registry import ORACLE, REGISTRY, engineered, latest, oracle_sql, queries, requisition  # noqa: F401
