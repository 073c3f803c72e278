"""Scans, sinks and persistence.

Every path is a folder in a shared file system. ``shared_path`` places scratch
output under the folder the session names in ``spark.checkpoint.dir`` (the
one shared location a cluster job is guaranteed to have), never in a
machine-local temp folder.
"""

from __future__ import annotations

import json
import uuid

from pyspark.ml.classification import OneVsRestModel, RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motorlytics import schema as S
from motorlytics.operators.features import parse_dates
from motorlytics.session import ensure_checkpoint_dir

BATCH_PREDICTION_COLUMNS = ["equipment_serial_no", "equipment_type_text", "make", "kw", "rpm", "installed_location",
                            "motor_age_years", "repair_count", "predicted_risk", "health_score"]


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/motorlytics-out/{name}-{uuid.uuid4().hex[:12]}"


# S1 ------------------------------------------------------------------------
def read_requisitions_csv(spark: SparkSession, path: str, schema: T.StructType = S.REQUISITION_SCHEMA,
                          mode: str = "FAILFAST") -> DataFrame:
    """CSV with a header row, read by column name with the types of ``schema`` (no
    inference); text dates are parsed to date/timestamp (unparsable -> null).

    Columns may stand in any order and more may be there; a missing one raises, as do
    files of one folder whose headers differ. A value that its type cannot hold, or a row
    of another length, raises when read (``mode="PERMISSIVE"``: becomes null)."""
    header = spark.read.option("header", True).csv(path).columns
    missing = [n for n in schema.names if n not in header]
    if missing:
        raise ValueError(f"columns missing in {path}: {', '.join(missing)}")
    found = T.StructType([schema[n] if n in schema.names else T.StructField(n, T.StringType()) for n in header])
    raw = spark.read.schema(found).option("header", True).option("enforceSchema", False).option("mode", mode).csv(path)
    return parse_dates(raw.select(*schema.names))


def write_csv(df: DataFrame, path: str) -> str:
    """CSV with header; dates and timestamps as ISO text."""
    out = df.withColumns({f.name: F.date_format(f.name, "yyyy-MM-dd") for f in df.schema.fields
                          if isinstance(f.dataType, T.DateType)})
    out = out.withColumns({f.name: F.date_format(f.name, "yyyy-MM-dd HH:mm:ss") for f in out.schema.fields
                           if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))})
    out.write.mode("overwrite").option("header", True).csv(path)
    return path


# S2 / S3 -------------------------------------------------------------------
def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def read_table_path(spark: SparkSession, path: str) -> DataFrame:
    """Parquet folder -> DataFrame; a missing folder raises AnalysisException."""
    return spark.read.parquet(path)


# S4 ------------------------------------------------------------------------
def write_batch_predictions(df: DataFrame, path: str) -> str:
    return write_csv(df.select(*BATCH_PREDICTION_COLUMNS), path)


# S5 ------------------------------------------------------------------------
def save_encoders(encoders: DataFrame, path: str) -> str:
    return write_table(encoders.select("column", "value", "code"), path)


def load_encoders(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# S6 ------------------------------------------------------------------------
def save_model(model, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str, kind: str):
    return RandomForestClassificationModel.load(path) if kind == "rf" else OneVsRestModel.load(path)


# S7 ------------------------------------------------------------------------
def model_metadata(spark: SparkSession, primary: str, params: dict[str, dict], evals: DataFrame,
                   features: list[str] | None = None) -> DataFrame:
    """One-row record: feature list, labels, params and scalar metrics per
    model of ``evals`` (no per-row predictions, no matrices)."""
    features = features or S.FEATURE_COLUMNS
    head = spark.createDataFrame(
        [(primary, features, "risk_category", {str(k): v for k, v in S.RISK_LABELS.items()}, len(features))],
        "primary_model string, feature_columns array<string>, target string, risk_labels map<string,string>, "
        "n_features int")
    out = head
    for name, p in params.items():
        m = evals.where(F.col("model") == name).drop("model")
        p = json.dumps(p, sort_keys=True)
        out = out.crossJoin(m.select(F.struct(F.lit(p).alias("params"), F.struct(*m.columns).alias("metrics"))
                                     .alias(name)))  # each side is one row
    return out


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


# S8 ------------------------------------------------------------------------
def write_evaluation_report(sections: dict[str, DataFrame], path: str) -> str:
    """Named sections (metrics, both models' per-class reports, matrices, validation
    scores, the choice) as JSON lines ``section, row``."""
    out = None
    for name, df in sections.items():
        part = df.select(F.lit(name).alias("section"), F.to_json(F.struct("*")).alias("row"))
        out = part if out is None else out.unionByName(part)
    return write_json(out, path)


# S9 ------------------------------------------------------------------------
class ServingSnapshot:
    """Raw, engineered and latest-per-motor tables shared by every request as temp
    views. The first two are read where they are stored; the latest record of each
    motor is worked out once and stored too, so nothing stays cached in the session."""

    def __init__(self, raw: DataFrame, engineered: DataFrame, latest: DataFrame, prefix: str = "motor"):
        self.spark = spark = latest.sparkSession
        self.prefix = prefix
        latest = read_table_path(spark, write_table(latest, shared_path(spark, f"{prefix}-latest")))
        raw.createOrReplaceTempView(f"{prefix}_raw")
        engineered.createOrReplaceTempView(f"{prefix}_engineered")
        latest.createOrReplaceTempView(f"{prefix}_latest")

    def views(self) -> list[str]:
        return [f"{self.prefix}_raw", f"{self.prefix}_engineered", f"{self.prefix}_latest"]

    def release(self) -> None:
        """Drop the views."""
        for name in self.views():
            self.spark.catalog.dropTempView(name)
