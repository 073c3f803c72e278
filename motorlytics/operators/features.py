"""Feature engineering (F1-F18): per-motor history, group rates, encoders,
rule-based risk score and risk classes. Every function is DataFrame -> DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorlytics import schema as S
from motorlytics.functions.expr import clip01, hash_normal, np_round
from motorlytics.plans.ordering import global_prefix, segmented_running
from motorlytics.session import ensure_checkpoint_dir

SERIAL = "equipment_serial_no"


# F1 ------------------------------------------------------------------------
def add_motor_age(df: DataFrame, as_of_year: int = S.DEFAULT_AS_OF_YEAR) -> DataFrame:
    return df.withColumn("motor_age_years", (F.lit(as_of_year) - F.col("motor_manufacturing_year")).cast("int"))


# F2 ------------------------------------------------------------------------
def parse_dates(df: DataFrame, dates: tuple[str, ...] = ("received_date",),
                timestamps: tuple[str, ...] = ("updated_at", "created_at")) -> DataFrame:
    """Text -> date / timestamp; unparsable text becomes null (no ANSI error)."""
    out = {}
    for c in dates:
        if c in df.columns and dict(df.dtypes)[c] == "string":
            out[c] = F.coalesce(F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd HH:mm:ss")),
                                F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd"))).cast("date")
    for c in timestamps:
        if c in df.columns and dict(df.dtypes)[c] == "string":
            out[c] = F.coalesce(F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd HH:mm:ss")),
                                F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd")))
    return df.withColumns(out) if out else df


# F3-F6 ---------------------------------------------------------------------
def refurb_flag(job_no: Column, compat_nan: bool = False) -> Column:
    """1 when the requisition names a previous refurbishment job.

    ``compat_nan=True`` reproduces the shipped behaviour in which an empty job
    number, read back from CSV as a missing value, compared unequal to '' and
    so counted as a refurbishment on every row.
    """
    if compat_nan:
        return F.lit(1)
    return F.when(F.coalesce(job_no, F.lit("")) != "", 1).otherwise(0)


def add_repair_history(df: DataFrame, compat_nan: bool = False) -> DataFrame:
    """F3 repair_count, F4 days_since_last_repair, F5 previous_refurb_count,
    F6a-d running failure counts — one ordered pass per motor.

    Row order per motor: received date ascending with missing dates last, then
    requisition id (a stable sort of rows in id order gives the same).
    """
    d = F.col("received_date")
    order = {"_o_nodate": d.isNull(), "_o_date": d, "_o_id": F.col("requisition_id")}
    sums = {"previous_refurb_count": refurb_flag(F.col("previous_refurbishment_job_no"), compat_nan)}
    for reason, col_name in S.TRACKED_FAILURES.items():
        sums[col_name] = F.when(F.col("reason_of_failure_text") == reason, 1).otherwise(0)
    out = segmented_running(
        df, SERIAL, order,
        sums={k: v.cast("long") for k, v in sums.items()},
        lags={"_prev_received": d},
        position="repair_count",
    )
    gap = F.datediff(d, F.col("_prev_received"))
    return (out.withColumn("days_since_last_repair",
                           F.coalesce(gap, F.lit(S.FIRST_REPAIR_GAP_DAYS)).cast("int"))
            .drop("_prev_received"))


# F7 / F8 -------------------------------------------------------------------
def motor_group_counts(df: DataFrame, group_cols: list[str]) -> DataFrame:
    """Requisitions per (motor, group keys): one fact shuffle, combined
    map-side, shared by every group rate."""
    return df.groupBy(SERIAL, *group_cols).agg(F.count("requisition_id").alias("_n_req"))


def group_rates(df: DataFrame, group_col: str, out_col: str, counts: DataFrame | None = None) -> DataFrame:
    """requisitions / distinct motors per group. Missing group keys are dropped
    (as a group-by on them would), so their rows get a null rate; a missing
    serial counts as a requisition but not as a motor."""
    counts = counts if counts is not None else motor_group_counts(df, [group_col])
    return (counts.where(F.col(group_col).isNotNull())
            .groupBy(group_col)
            .agg(F.sum("_n_req").alias("_n_req"), F.countDistinct(SERIAL).alias("_n_motor"))
            .select(group_col, F.try_divide(F.col("_n_req").cast("double"), F.col("_n_motor")).alias(out_col)))


#: A lookup side of at most this many rows is broadcast; they are counted first.
LOOKUP_ROWS = 1 << 17


def lookup_side(df: DataFrame) -> DataFrame:
    """``df`` checkpointed, and broadcast if counted to be small. By its estimate (the size
    of what it was aggregated from) the planner would shuffle the wide rows by the few
    lookup keys before it learns the size; a large one is left to a shuffle join."""
    ensure_checkpoint_dir(df.sparkSession)
    df = df.checkpoint(eager=True)
    return F.broadcast(df) if df.count() <= LOOKUP_ROWS else df


def add_group_rates(df: DataFrame, rates: dict[str, str], source: DataFrame | None = None) -> DataFrame:
    """Map each row to its groups' rates. The (motor, group) counts are worked out and
    stored once, from ``source`` if the same requisitions have a cheaper plan there; each
    rate table has one row per group (``lookup_side``)."""
    ensure_checkpoint_dir(df.sparkSession)
    counts = motor_group_counts(df if source is None else source, list(rates)).checkpoint(eager=True)
    out = df
    for group_col, out_col in rates.items():
        out = out.join(lookup_side(group_rates(df, group_col, out_col, counts)), on=group_col, how="left")
    return out


def add_group_rate(df: DataFrame, group_col: str, out_col: str) -> DataFrame:
    return add_group_rates(df, {group_col: out_col})


def add_department_failure_rate(df: DataFrame) -> DataFrame:
    return add_group_rate(df, "installed_location", "dept_failure_rate")


def add_make_failure_rate(df: DataFrame) -> DataFrame:
    return add_group_rate(df, "make", "make_failure_rate")


def add_failure_rates(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """F7 and F8 from one shared (motor, department, maker) pre-aggregate."""
    return add_group_rates(df, {"installed_location": "dept_failure_rate", "make": "make_failure_rate"}, source)


# F9 / F10 ------------------------------------------------------------------
def category_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(S.NULL_CATEGORY))


def fit_encoders(df: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """Encoder dictionary ``(column, value, code)``: distinct values of each
    column sorted by code point, numbered from 0."""
    columns = columns or S.CATEGORICAL_COLUMNS
    # one scan: each row contributes one (column, value) pair per category;
    # distinct() de-duplicates map-side before the shuffle
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), category_text(F.col(c)).alias("value")) for c in columns])
    # the distinct categories are stored once (one pass over the fact), so
    # the range sampling and the numbering read that small table
    ensure_checkpoint_dir(df.sparkSession)
    distinct = df.select(F.inline(pairs)).distinct().checkpoint(eager=True)
    ranked = global_prefix(distinct, ["value"], "_pos", partition=["column"])
    return ranked.select("column", "value", (F.col("_pos") - 1).cast("int").alias("code"))


def apply_encoders(df: DataFrame, encoders: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """Look every category up in the dictionary; unseen values get -1.

    One left join per column against that column's slice of the dictionary
    (a dimension of distinct categories: AQE broadcasts it when small), then
    a single projection."""
    columns = columns or S.CATEGORICAL_COLUMNS
    out = df
    for i, (src, dst) in enumerate(columns.items()):
        lookup = encoders.where(F.col("column") == src).select(
            F.col("value").alias(f"_enc_v{i}"), F.col("code").alias(f"_enc_c{i}"))
        out = out.join(lookup, category_text(out[src]) == lookup[f"_enc_v{i}"], "left")
    codes = [F.coalesce(F.col(f"_enc_c{i}"), F.lit(S.UNSEEN_CODE)).cast("int").alias(dst)
             for i, dst in enumerate(columns.values())]
    keep = [c for c in df.columns if c not in columns.values()]
    return out.select(*keep, *codes)


# F11 / F12 / F13 -----------------------------------------------------------
def risk_components(df: DataFrame) -> dict[str, Column]:
    failures = sum((F.col(c) for c in S.TRACKED_FAILURES.values()), F.lit(0))
    return {
        "age_score": clip01(F.col("motor_age_years") / S.AGE_SCALE_YEARS),
        "repair_freq_score": clip01(F.col("repair_count") / S.REPAIR_SCALE),
        "recency_score": clip01(F.lit(1.0) - F.col("days_since_last_repair") / S.RECENCY_SCALE_DAYS),
        "kw_score": clip01(F.col("kw") / S.KW_SCALE),
        "failure_history_score": clip01(failures / S.FAILURE_SCALE),
    }


def add_risk_components(df: DataFrame) -> DataFrame:
    return df.withColumns(risk_components(df))


def risk_score_expr(noise_sd: float = 0.0, seed: int = 0) -> Column:
    w = S.RISK_WEIGHTS
    score = (F.lit(w["age"]) * F.col("age_score")
             + F.lit(w["repairs"]) * F.col("repair_freq_score")
             + F.lit(w["recency"]) * F.col("recency_score")
             + F.lit(w["kw"]) * F.col("kw_score")
             + F.lit(w["failures"]) * F.col("failure_history_score"))
    if noise_sd:
        score = score + F.lit(noise_sd) * hash_normal(seed, F.col("requisition_id"))
    return clip01(score)


# F14 / F15 / F16 -----------------------------------------------------------
def risk_category_expr(score: Column) -> Column:
    t0, t1, t2 = S.RISK_THRESHOLDS
    return (F.when(score.isNull(), 1).when(score < t0, 0).when(score < t1, 1)
            .when(score < t2, 2).otherwise(3)).cast("int")


def risk_label_expr(cls: Column) -> Column:
    m = F.create_map(*[x for k, v in sorted(S.RISK_LABELS.items()) for x in (F.lit(k), F.lit(v))])
    return F.element_at(m, cls)


def add_risk_target(df: DataFrame, noise_sd: float = 0.0, seed: int = 0, keep_components: bool = False) -> DataFrame:
    """Components, score (+ optional hash noise), health, class, label."""
    comps = risk_components(df)
    out = df.withColumns(comps).withColumn("risk_score", risk_score_expr(noise_sd, seed))
    out = out.withColumns({
        "health_score": np_round((F.lit(1.0) - F.col("risk_score")) * 100.0, 1),
        "risk_category": risk_category_expr(F.col("risk_score")),
    }).withColumn("risk_label", risk_label_expr(F.col("risk_category")))
    if not keep_components:
        out = out.drop(*comps.keys(), "risk_score")
    return out


# F17 -----------------------------------------------------------------------
def feature_projection(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*keep, *S.FEATURE_COLUMNS)


# F18 -----------------------------------------------------------------------
def engineer(df: DataFrame, encoders: DataFrame | None = None, fit: bool = True,
             as_of_year: int = S.DEFAULT_AS_OF_YEAR, compat_nan: bool = False,
             noise_sd: float = 0.0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The whole feature pipeline. ``fit=True`` fits the encoders on ``df``;
    ``fit=False`` applies the given ``encoders`` (unseen -> -1)."""
    if fit or encoders is None:
        # the fitted dictionary is an artifact: write it once to the shared
        # checkpoint folder so the four lookups read a small stored table
        # instead of re-planning the fit each time
        encoders = lookup_side(fit_encoders(df))
    out = (df.transform(parse_dates)
           .transform(add_motor_age, as_of_year)
           .transform(add_repair_history, compat_nan)
           .transform(add_failure_rates, df)
           .transform(apply_encoders, encoders)
           .transform(add_risk_target, noise_sd, seed))
    return out, encoders
