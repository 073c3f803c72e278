"""Profiling (P1-P7): dataset summary, value distributions, feature summary,
target distribution and health statistics. Each is one aggregation pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlytics import schema as S
from motorlytics.functions.expr import np_round

SERIAL = "equipment_serial_no"


# P1 ------------------------------------------------------------------------
def dataset_summary(df: DataFrame) -> DataFrame:
    """Rows, motors, date range and number of departments / types / makers.
    One scan; the distinct counts are planned with one Expand and a map-side
    de-duplication per column before the shuffle."""
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.countDistinct(SERIAL).alias("unique_motors"),
        F.date_format(F.min("received_date"), "yyyy-MM-dd").alias("first_received"),
        F.date_format(F.max("received_date"), "yyyy-MM-dd").alias("last_received"),
        F.countDistinct("installed_location").alias("departments"),
        F.countDistinct("equipment_type_text").alias("equipment_types"),
        F.countDistinct("make").alias("makers"),
    )


# P2-P4 ---------------------------------------------------------------------
def distribution(df: DataFrame, col: str) -> DataFrame:
    """Count per value (missing values not listed) and its share of ALL rows."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))  # one row
    return (counts.crossJoin(F.broadcast(total))
            .select(col, "count", (F.col("count") / F.col("_total") * 100.0).alias("pct")))


def failure_reason_distribution(df: DataFrame) -> DataFrame:
    return distribution(df, "reason_of_failure_text")


def department_distribution(df: DataFrame) -> DataFrame:
    return distribution(df, "installed_location")


def status_distribution(df: DataFrame) -> DataFrame:
    return distribution(df, "status")


# P5 ------------------------------------------------------------------------
def feature_summary(df: DataFrame, features: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """mean, sample std, min, max for each feature — one aggregation, then an
    unpivot of its single row to one row per feature."""
    features = features or S.FEATURE_COLUMNS
    aggs = []
    for i, c in enumerate(features):
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(i).alias("feature_order"), F.lit(c).alias("feature"),
                              F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"),
                              F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"))
                     for i, c in enumerate(features)])
    out = wide.select(F.inline(rows))
    if digits is not None:
        out = out.withColumns({c: np_round(F.col(c), digits) for c in ("mean", "std", "min", "max")})
    return out


# P6 ------------------------------------------------------------------------
def target_distribution(spark: SparkSession, df: DataFrame, class_col: str = "risk_category") -> DataFrame:
    """Rows per risk class with share, every class listed (zero-filled)."""
    counts = df.where(F.col(class_col).isNotNull()).groupBy(F.col(class_col).alias("risk_class")).count()
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    dim = S.risk_label_dim(spark).select("risk_class", "risk_label")
    return (F.broadcast(dim).join(counts, "risk_class", "left").crossJoin(F.broadcast(total))
            .select("risk_class", "risk_label",
                    F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
                    (F.coalesce(F.col("count"), F.lit(0)) / F.col("_total") * 100.0).alias("pct")))


# P7 ------------------------------------------------------------------------
def health_statistics(df: DataFrame, col: str = "health_score", digits: int | None = None) -> DataFrame:
    """mean, exact median (interpolated), sample std, min, max."""
    out = df.agg(F.avg(col).alias("mean"), F.median(col).alias("median"), F.stddev_samp(col).alias("std"),
                 F.min(col).alias("min"), F.max(col).alias("max"))
    if digits is not None:
        out = out.select(*[np_round(F.col(c), digits).alias(c) for c in out.columns])
    return out
