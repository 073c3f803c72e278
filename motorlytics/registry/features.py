"""Registered feature queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorlytics import oracle as O
from motorlytics import schema as S
from motorlytics.operators import features as FE
from motorlytics.registry.core import Builder, ENGINEERED_COLS, engineered, register, requisition


# ---------------------------------------------------------------------------
# F — features
# ---------------------------------------------------------------------------


@register("f01_motor_age", O.with_ctes(
    "SELECT requisition_id, motor_manufacturing_year, "
    f"CAST({S.DEFAULT_AS_OF_YEAR} - motor_manufacturing_year AS INTEGER) AS motor_age_years FROM requisition",
    "requisition"))
def f01(spark, sf_dir):
    return (requisition(spark, sf_dir).transform(FE.add_motor_age)
            .select("requisition_id", "motor_manufacturing_year", "motor_age_years"))


@register("f02_parse_dates", O.with_ctes(
    "SELECT requisition_id, CAST(received_date - DATE '1970-01-01' AS INTEGER) AS received_day, "
    "strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at FROM requisition",
    "requisition"))
def f02(spark, sf_dir):
    text = requisition(spark, sf_dir).select(
        "requisition_id",
        F.date_format("received_date", "yyyy-MM-dd").alias("received_date"),
        F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))
    parsed = FE.parse_dates(text)
    # parsed values rendered back as text: independent of the session time zone
    return parsed.select("requisition_id", F.unix_date("received_date").alias("received_day"),
                         F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


def _history_query(col: str) -> Builder:
    def build(spark, sf_dir):
        return (requisition(spark, sf_dir).transform(FE.add_repair_history)
                .select("requisition_id", "equipment_serial_no", col))
    return build


for _name, _col in [("f03_repair_count", "repair_count"),
                    ("f04_days_since_last_repair", "days_since_last_repair"),
                    ("f05_previous_refurb_count", "previous_refurb_count"),
                    ("f06a_bearing_failure_count", "bearing_failure_count"),
                    ("f06b_winding_failure_count", "winding_failure_count"),
                    ("f06c_rotor_failure_count", "rotor_failure_count"),
                    ("f06d_insulation_failure_count", "insulation_failure_count")]:
    register(_name, O.with_ctes(f"SELECT requisition_id, equipment_serial_no, {_col} FROM history", "history"))(
        _history_query(_col))


@register("f05_previous_refurb_count_compat", O.with_ctes(
    f"SELECT requisition_id, equipment_serial_no, CAST(row_number() OVER ({O._W}) AS BIGINT) AS previous_refurb_count "
    "FROM requisition", "requisition"))
def f05_compat(spark, sf_dir):
    return (requisition(spark, sf_dir).transform(FE.add_repair_history, True)
            .select("requisition_id", "equipment_serial_no", "previous_refurb_count"))


@register("f07_dept_failure_rate", O.with_ctes(
    "SELECT r.requisition_id, r.installed_location, d.dept_failure_rate FROM requisition r "
    "LEFT JOIN dept_rate d ON r.installed_location = d.installed_location", "requisition", "dept_rate"))
def f07(spark, sf_dir):
    return (requisition(spark, sf_dir).transform(FE.add_department_failure_rate)
            .select("requisition_id", "installed_location", "dept_failure_rate"))


@register("f08_make_failure_rate", O.with_ctes(
    "SELECT r.requisition_id, r.make, m.make_failure_rate FROM requisition r "
    "LEFT JOIN make_rate m ON r.make = m.make", "requisition", "make_rate"))
def f08(spark, sf_dir):
    return (requisition(spark, sf_dir).transform(FE.add_make_failure_rate)
            .select("requisition_id", "make", "make_failure_rate"))


@register("f09_encoder_fit", O.with_ctes('SELECT "column", value, code FROM encoders', "encoders"))
def f09(spark, sf_dir):
    return FE.fit_encoders(requisition(spark, sf_dir))


def _apply_sql() -> str:
    # encoders fitted on the requisitions received before 1996, applied to all
    fit = " UNION ".join(
        f"SELECT {O._q(c)} AS \"column\", coalesce(CAST({c} AS VARCHAR), 'nan') AS value FROM requisition "
        f"WHERE received_date < DATE '1996-01-01'" for c in S.CATEGORICAL_COLUMNS)
    enc = (f"SELECT \"column\", value, CAST(dense_rank() OVER (PARTITION BY \"column\" ORDER BY value) - 1 AS INTEGER) "
           f"AS code FROM ({fit}) d")
    joins, cols = [], []
    for i, (src, dst) in enumerate(S.CATEGORICAL_COLUMNS.items()):
        joins.append(f"LEFT JOIN early_enc e{i} ON e{i}.\"column\" = {O._q(src)} "
                     f"AND e{i}.value = coalesce(CAST(r.{src} AS VARCHAR), 'nan')")
        cols.append(f"CAST(coalesce(e{i}.code, -1) AS INTEGER) AS {dst}")
    body = f"SELECT r.requisition_id, {', '.join(cols)} FROM requisition r " + " ".join(joins)
    return "WITH requisition AS (" + O.REQUISITION + f"), early_enc AS ({enc})\n" + body


@register("f10_encoder_apply", _apply_sql())
def f10(spark, sf_dir):
    req = requisition(spark, sf_dir)
    enc = FE.fit_encoders(req.where(F.col("received_date") < F.lit("1996-01-01").cast("date")))
    return FE.apply_encoders(req, enc).select("requisition_id", *S.CATEGORICAL_COLUMNS.values())


def iso_dates(df: DataFrame) -> DataFrame:
    """Dates as ``yyyy-MM-dd`` text, the way the application stores them."""
    return df.withColumns({f.name: F.date_format(f.name, "yyyy-MM-dd")
                           for f in df.schema.fields if f.dataType.simpleString() == "date"})


ISO_DATE_SQL = "strftime(received_date, '%Y-%m-%d') AS received_date"


def _engineered_select(cols: list[str]) -> Builder:
    """Columns of the engineered table (the pipeline's stored stage output)."""
    def build(spark, sf_dir):
        return iso_dates(engineered(spark, sf_dir).select(*cols))
    return build


@register("f11_risk_components", O.with_ctes(
    "SELECT requisition_id, age_score, repair_freq_score, recency_score, kw_score, failure_history_score FROM risk",
    "risk"))
def f11(spark, sf_dir):
    return engineered(spark, sf_dir).transform(FE.add_risk_components).select(
        "requisition_id", "age_score", "repair_freq_score", "recency_score", "kw_score", "failure_history_score")


@register("f12_risk_score", O.with_ctes("SELECT requisition_id, risk_score FROM risk", "risk"))
def f12(spark, sf_dir):
    eng = engineered(spark, sf_dir).drop("health_score", "risk_category", "risk_label")
    return FE.add_risk_target(eng, keep_components=True).select("requisition_id", "risk_score")


@register("f13_score_noise", O.with_ctes("SELECT requisition_id, health_score, risk_category FROM features_noise", "features_noise"))
def f13(spark, sf_dir):
    eng, _ = FE.engineer(requisition(spark, sf_dir), noise_sd=0.05, seed=42)
    return eng.select("requisition_id", "health_score", "risk_category")


register("f14_health_score", O.with_ctes("SELECT requisition_id, health_score FROM features", "features"))(
    _engineered_select(["requisition_id", "health_score"]))
register("f15_risk_category", O.with_ctes("SELECT requisition_id, risk_category FROM features", "features"))(
    _engineered_select(["requisition_id", "risk_category"]))
register("f16_risk_label", O.with_ctes("SELECT requisition_id, risk_label FROM features", "features"))(
    _engineered_select(["requisition_id", "risk_label"]))
register("f17_feature_projection", O.with_ctes(
    "SELECT requisition_id, " + ", ".join(S.FEATURE_COLUMNS) + " FROM features", "features"))(
    _engineered_select(["requisition_id", *S.FEATURE_COLUMNS]))
register("f18_feature_engineering", O.with_ctes(
    "SELECT * REPLACE (" + ISO_DATE_SQL + ") FROM (SELECT " + ", ".join(ENGINEERED_COLS) + " FROM features)",
    "features"))(
    _engineered_select(ENGINEERED_COLS))


