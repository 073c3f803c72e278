"""Scoring (C1-C14): latest record per motor, model health score, component
probabilities, inspection dates, fleet roll-ups and reports.

Model output is taken as four probability columns ``p_low, p_medium, p_high,
p_critical`` plus ``risk_class`` — produced by ``ml.predict`` from a fitted
model, or by the deterministic fixture for oracle checks.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlytics import schema as S
from motorlytics.functions.expr import clip, draw_bits, hash_uniform, mean_of_decimals, median_of_decimals, np_round
from motorlytics.operators.features import risk_label_expr

SERIAL = "equipment_serial_no"
PROBS = ["p_low", "p_medium", "p_high", "p_critical"]


# C1 ------------------------------------------------------------------------
def latest_order_key() -> Column:
    """Row order used to pick a motor's latest record: missing dates last,
    then date, then requisition id."""
    return F.struct(F.col("received_date").isNull().alias("nodate"),
                    F.col("received_date").alias("d"), F.col("requisition_id").alias("id"))


def latest_records(df: DataFrame, columns: list[str] | None = None, position_col: str | None = None) -> DataFrame:
    """Per motor, each column's last non-missing value in row order. Rows without a
    serial are dropped.

    One aggregation keyed by the serial; ``max_by`` is partially aggregated before the
    shuffle, so a motor with a huge history costs one row per map task, and columns that
    the caller does not use are pruned. ``position_col`` may name a column holding the
    motor's 1-based history position in exactly this row order (the engineered table's
    ``repair_count``); that integer is then the ordering key, about three times cheaper
    than the (missing date, date, id) struct used otherwise. For the whole record see
    ``latest_by_position``.
    """
    columns = [c for c in (columns or df.columns) if c != SERIAL]
    okey = F.col(position_col) if position_col else latest_order_key()
    aggs = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), okey)).alias(c) for c in columns]
    return df.where(F.col(SERIAL).isNotNull()).groupBy(SERIAL).agg(*aggs)


def latest_by_position(df: DataFrame, position_col: str, columns: list[str] | None = None) -> DataFrame:
    """``latest_records`` of wide records by late materialisation: a hash aggregate of longs finds each motor's last position and,
    for each column that has missing values, the last one at which it is set; only the rows
    at those positions (for most motors one) are then joined, and each column is read from
    its own. A motor has at most as many such rows as there are columns, so the map of them
    is bounded. Positions are unique within a motor."""
    df = df.where(F.col(SERIAL).isNotNull())
    columns = [c for c in (columns or df.columns) if c != SERIAL]
    missing = df.select(*[F.max(F.col(c).isNull()).alias(c) for c in columns]).first()  # one row
    at = {c: f"_at{i}" for i, c in enumerate(columns) if missing[c]}
    pos = F.col(position_col).cast("long")
    where = df.groupBy(SERIAL).agg(F.max(pos).alias("_last"), *[F.max(F.when(F.col(c).isNotNull(), pos)).alias(a) for c, a in at.items()])
    wanted = where.select(SERIAL, F.explode(F.array_distinct(F.array("_last", *at.values()))).alias("_pos")).where("_pos is not null")
    rows = df.select(SERIAL, pos.alias("_pos"), F.struct(*columns).alias("_row")).join(wanted, [SERIAL, "_pos"])
    held = rows.groupBy(SERIAL).agg(F.map_from_entries(F.collect_list(F.struct("_pos", "_row"))).alias("_rows"))
    found = where.join(held, SERIAL, "left").withColumn("_row", F.col("_rows")[F.col("_last")])
    return found.select(SERIAL, *[(F.col("_rows")[F.col(at[c])] if c in at else F.col("_row"))[c].alias(c) for c in columns])


# C2 ------------------------------------------------------------------------
def sample_motors(df: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` motors without replacement: those with the smallest draw for (seed, serial)"""
    return df.orderBy(draw_bits(seed, F.col(SERIAL)), SERIAL).limit(n)


# C3 ------------------------------------------------------------------------
def model_health_expr(p_high: Column, p_critical: Column) -> Column:
    raw = (F.lit(1.0) - p_high * S.HEALTH_WEIGHT_HIGH - p_critical * S.HEALTH_WEIGHT_CRITICAL) * 100.0
    return clip(np_round(raw, 1), float(S.HEALTH_MIN), float(S.HEALTH_MAX))


def add_model_health(df: DataFrame) -> DataFrame:
    return df.withColumn("health_score", model_health_expr(F.col("p_high"), F.col("p_critical")))


# C4 ------------------------------------------------------------------------
COMPONENT_COLUMNS = {name: name.split()[0].lower() + "_prob" for name, _, _ in S.COMPONENTS}


def component_probability_exprs(jitter: str = "mid", seed: int = 0, key: Column | None = None) -> dict[str, Column]:
    """Component failure probabilities from the class probabilities.

    ``jitter='mid'`` uses the middle of each jitter range (deterministic);
    ``jitter='seeded'`` draws it from a hash of ``key`` so reruns agree.
    """
    p = [F.col(c) for c in PROBS]
    raw = {}
    for i, (name, (wm, wh, wc), (lo, hi)) in enumerate(S.COMPONENTS):
        terms = [w * p[k] for k, w in ((1, wm), (2, wh), (3, wc)) if w]
        base = terms[0] + terms[1]
        if jitter == "seeded":
            u = hash_uniform(seed + i, key if key is not None else F.col(SERIAL))
            factor = F.lit(lo) + (F.lit(hi) - F.lit(lo)) * u
        else:
            factor = F.lit((lo + hi) / 2.0)
        raw[COMPONENT_COLUMNS[name]] = np_round(base * factor, 3)
    return raw


def add_component_probabilities(df: DataFrame, jitter: str = "mid", seed: int = 0) -> DataFrame:
    raw = component_probability_exprs(jitter, seed)
    names = list(raw)
    out = df.withColumns({f"_raw_{n}": c for n, c in raw.items()})
    total = F.col(f"_raw_{names[0]}")
    for n in names[1:]:
        total = total + F.col(f"_raw_{n}")
    out = out.withColumn("_comp_total", total)
    return out.withColumns({
        n: F.when(F.col("_comp_total") > 0, np_round(F.col(f"_raw_{n}") / F.col("_comp_total"), 3))
           .otherwise(F.col(f"_raw_{n}"))
        for n in names
    }).drop("_comp_total", *[f"_raw_{n}" for n in names])


# C5 / C6 -------------------------------------------------------------------
def inspection_days_expr(cls: Column) -> Column:
    m = F.create_map(*[x for k, v in sorted(S.INSPECTION_DAYS.items()) for x in (F.lit(k), F.lit(v))])
    return F.element_at(m, cls)


def add_inspection_date(df: DataFrame, as_of: str | _dt.date) -> DataFrame:
    as_of_col = F.lit(str(as_of)).cast("date")
    return df.withColumn("suggested_inspection_date",
                         F.date_format(F.date_add(as_of_col, inspection_days_expr(F.col("risk_class"))), "yyyy-MM-dd"))


def recommended_action_expr(cls: Column) -> Column:
    m = F.create_map(*[x for k, v in sorted(S.RECOMMENDED_ACTIONS.items()) for x in (F.lit(k), F.lit(v))])
    return F.element_at(m, cls)


def add_recommended_action(df: DataFrame) -> DataFrame:
    return df.withColumn("recommended_action", recommended_action_expr(F.col("risk_class")))


# C7 ------------------------------------------------------------------------
def prediction_record(df: DataFrame, as_of: str, jitter: str = "mid", seed: int = 0,
                      keep: list[Column] | None = None) -> DataFrame:
    """Nested prediction per motor: health, label, class, two probability maps,
    action and inspection date; ``keep`` adds columns of the input."""
    scored = (df.transform(add_model_health)
              .transform(add_component_probabilities, jitter, seed)
              .transform(add_inspection_date, as_of)
              .transform(add_recommended_action))
    risk_probs = F.create_map(*[x for k, c in zip(S.RISK_LABELS.values(), PROBS)
                                for x in (F.lit(k), np_round(F.col(c), 4))])
    comp_probs = F.create_map(*[x for name, c in COMPONENT_COLUMNS.items() for x in (F.lit(name), F.col(c))])
    return scored.select(
        SERIAL,
        *(keep or []),
        F.struct(
            F.col("health_score"),
            risk_label_expr(F.col("risk_class")).alias("risk_category"),
            F.col("risk_class"),
            risk_probs.alias("risk_probabilities"),
            comp_probs.alias("failure_probabilities"),
            F.col("recommended_action"),
            F.col("suggested_inspection_date"),
        ).alias("prediction"),
    )


# C8 ------------------------------------------------------------------------
def component_ranking(df: DataFrame) -> DataFrame:
    """Long form (motor, component, probability, rank), most likely first.
    Sorting four values per row is an array sort — no window, no shuffle."""
    entries = F.array(*[F.struct((-F.col(c)).alias("neg"), F.lit(i).alias("pos"), F.lit(name).alias("component"),
                                 F.col(c).alias("probability"))
                        for i, (name, c) in enumerate(COMPONENT_COLUMNS.items())])
    return (df.select(SERIAL, F.posexplode(F.array_sort(entries)).alias("_rank0", "_e"))
            .select(SERIAL, (F.col("_rank0") + 1).cast("int").alias("component_rank"),
                    F.col("_e.component").alias("component"), F.col("_e.probability").alias("probability")))


# C9 ------------------------------------------------------------------------
def batch_scores(df: DataFrame) -> DataFrame:
    """Adds predicted label and model health to rows that carry class
    probabilities and ``risk_class``."""
    return (df.withColumn("predicted_risk", risk_label_expr(F.col("risk_class")))
            .transform(add_model_health))


# C10 -----------------------------------------------------------------------
def fleet_totals(df: DataFrame) -> DataFrame:
    """Motors, mean and median health (1 dp). Health scores carry one decimal
    (at most 1001 distinct values), so the exact median's buffer is bounded."""
    return df.agg(F.count(F.lit(1)).alias("total_motors"),
                  mean_of_decimals(F.col("health_score"), 1).alias("avg_health_score"),
                  median_of_decimals(F.col("health_score"), 1).alias("median_health_score"))


# C11 -----------------------------------------------------------------------
def risk_distribution(spark: SparkSession, df: DataFrame, label_col: str = "predicted_risk") -> DataFrame:
    """Count and share per risk label, all four labels present (zero-filled).
    The label dimension has four rows by construction."""
    counts = (df.where(F.col(label_col).isNotNull()).groupBy(label_col).count()
              .withColumnRenamed(label_col, "risk_label"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    dim = S.risk_label_dim(spark).select("risk_class", "risk_label")
    return (F.broadcast(dim).join(counts, "risk_label", "left").crossJoin(total)
            .select("risk_label", "risk_class",
                    F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("motor_count"),
                    F.try_divide(F.coalesce(F.col("count"), F.lit(0)) * 100.0, F.col("_total")).alias("pct")))


# C12 -----------------------------------------------------------------------
def top_at_risk(df: DataFrame, k: int = 10) -> DataFrame:
    """k motors with the highest class; ties keep serial order. Spark plans
    this as a per-partition top-k followed by a merge (TakeOrderedAndProject)."""
    return df.orderBy(F.col("risk_class").desc(), F.col(SERIAL).asc()).limit(k)


# C13 -----------------------------------------------------------------------
def department_risk_summary(df: DataFrame, health_col: str = "health_score", class_col: str = "risk_class") -> DataFrame:
    return (df.where(F.col("installed_location").isNotNull())
            .groupBy("installed_location")
            .agg(mean_of_decimals(F.col(health_col), 1).alias("avg_health"),
                 np_round(F.avg(class_col), 1).alias("avg_risk"),
                 F.count(SERIAL).alias("motor_count")))


# D13 (fleet summary record over scored motors) -----------------------------
def fleet_summary_record(spark: SparkSession, s: DataFrame) -> DataFrame:
    """Total, mean health (1 dp), zero-filled distribution and top five as one row."""
    totals = s.agg(F.count(F.lit(1)).alias("total_motors"),
                   mean_of_decimals(F.col("health_score"), 1).alias("avg_health_score"))
    dist = risk_distribution(spark, s).agg(
        F.map_from_entries(F.collect_list(F.struct("risk_label", "motor_count"))).alias("risk_distribution"))
    top = top_at_risk(s, 5).agg(F.collect_list(F.struct(
        F.col("risk_class"), F.col("equipment_serial_no").alias("serial_no"), F.col("equipment_type_text").alias("type"),
        F.col("installed_location").alias("location"), "health_score", F.col("predicted_risk").alias("risk"))).alias("_top"))
    top = top.select(F.transform(F.array_sort("_top", lambda a, b: F.when(a["risk_class"] > b["risk_class"], -1)
                                              .when(a["risk_class"] < b["risk_class"], 1)
                                              .when(a["serial_no"] < b["serial_no"], -1)
                                              .when(a["serial_no"] > b["serial_no"], 1).otherwise(0)),
                                 lambda x: x.dropFields("risk_class")).alias("top_at_risk"))
    return totals.crossJoin(dist).crossJoin(top)  # each side is one row


# C14 -----------------------------------------------------------------------
def motor_metadata() -> Column:
    """Motor attributes with display defaults, as a struct."""
    na = F.lit("N/A")
    return F.struct(
        F.col(SERIAL).alias("serial_no"),
        F.coalesce(F.col("equipment_type_text"), na).alias("equipment_type"),
        F.coalesce(F.col("make"), na).alias("manufacturer"),
        F.coalesce(F.col("installed_location"), na).alias("installed_location"),
        F.coalesce(F.col("kw"), F.lit(0.0)).alias("kw_rating"),
        F.coalesce(F.col("rpm"), F.lit(0)).alias("rpm"),
        F.coalesce(F.col("motor_age_years"), F.lit(0)).alias("age_years"),
    )


def motor_report(scored: DataFrame, as_of: str) -> DataFrame:
    """Motor attributes next to the prediction record; one pass."""
    return prediction_record(scored.drop("health_score"), as_of, keep=[motor_metadata().alias("metadata")]).withColumnRenamed(SERIAL, "serial_no")
