"""Registry core: registration, shared inputs and common SQL pieces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from motorlytics import oracle as O
from motorlytics import schema as S
from motorlytics.operators import features as FE
from motorlytics.operators import scoring as SC
from motorlytics.sources import fixtures as FX
from motorlytics.sources.io import shared_path


Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}

AS_OF = "2026-06-30"  # scoring date used by the registered queries (replaces now())


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        REGISTRY[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------------------
# shared Spark inputs
# ---------------------------------------------------------------------------
def requisition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FX.requisitions(spark, sf_dir)


_STAGES: dict = {}


def stage(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A stage output: computed once per session and data folder, written as Parquet under
    the shared checkpoint folder, and read back by every query that uses it."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGES:
        path = shared_path(spark, f"{name}-stage")
        build().write.mode("overwrite").parquet(path)
        _STAGES[key] = path
    return spark.read.parquet(_STAGES[key])


def engineered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engineered table (scoring, dashboards, profiling and training read the stored
    feature table, as the application does)."""
    return stage(spark, sf_dir, "engineered", lambda: FE.engineer(requisition(spark, sf_dir))[0])


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.latest_records(engineered(spark, sf_dir).drop("updated_at"), position_col="repair_count")


# exact mean of 1-decimal scores, rounded half-even to 1 decimal
MEAN_HEALTH_SQL = "round_even(sum(round_even(health_score * 10e0, 0)) / count(health_score), 0) / 10e0"

ENGINEERED_COLS = [  # engineered table minus the timestamp column
    "requisition_id", "equipment_serial_no", "motor_manufacturing_year", "installed_location", "make",
    "equipment_type_text", "main_equipment_name", "kw", "rpm", "voltage", "current", "duty_cycle",
    "application_use", "model", "frame", "status", "reason_of_failure_text", "service_type_text",
    "previous_refurbishment_job_no", "received_date", "motor_age_years", "repair_count",
    "days_since_last_repair", "previous_refurb_count", *S.TRACKED_FAILURES.values(),
    "dept_failure_rate", "make_failure_rate", *S.CATEGORICAL_COLUMNS.values(),
    "health_score", "risk_category", "risk_label",
]


def _label_values_sql() -> str:
    return "(VALUES " + ", ".join(f"({k}, {O._q(v)})" for k, v in sorted(S.RISK_LABELS.items())) + ") d(risk_class, risk_label)"
