"""Registered scoring queries (C1-C14) and the flagship slice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlytics import oracle as O
from motorlytics import schema as S
from motorlytics.operators import scoring as SC
from motorlytics.sources import fixtures as FX
from motorlytics.registry.core import AS_OF, ENGINEERED_COLS, MEAN_HEALTH_SQL, _label_values_sql, engineered, latest, register
from motorlytics.registry.features import ISO_DATE_SQL, iso_dates


# ---------------------------------------------------------------------------
# C1 and the flagship slice
# ---------------------------------------------------------------------------
LATEST_COLS = [c for c in ENGINEERED_COLS if c != "equipment_serial_no"]


def _latest_sql() -> str:
    okey = "(CASE WHEN received_date IS NULL THEN 1 ELSE 0 END, received_date, requisition_id)"
    aggs = ",\n  ".join(f"arg_max({c}, {okey}) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in LATEST_COLS)
    return (f"SELECT equipment_serial_no,\n  {aggs}\nFROM features WHERE equipment_serial_no IS NOT NULL "
            f"GROUP BY equipment_serial_no")


O.add_cte("latest", _latest_sql())


@register("c01_latest_records", O.with_ctes(f"SELECT * REPLACE ({ISO_DATE_SQL}) FROM latest", "latest"))
def c01(spark, sf_dir):
    return iso_dates(SC.latest_by_position(engineered(spark, sf_dir).drop("updated_at"), "repair_count"))


@register("c13_department_risk_rule", O.with_ctes(
    f"SELECT installed_location, {MEAN_HEALTH_SQL} AS avg_health, "
    f"{O.np_round_sql('avg(risk_category)', 1)} AS avg_risk, count(equipment_serial_no) AS motor_count "
    "FROM latest WHERE installed_location IS NOT NULL GROUP BY installed_location", "latest"))
def c13_rule(spark, sf_dir):
    return SC.department_risk_summary(latest(spark, sf_dir), "health_score", "risk_category")


# ---------------------------------------------------------------------------
# Scored fleet (fixture probabilities stand in for a fitted model)
# ---------------------------------------------------------------------------
def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest record per motor with class probabilities, label and model health."""
    return SC.batch_scores(FX.with_fixture_scores(latest(spark, sf_dir)))


O.add_cte("scored_w", """
SELECT l.*, 1e0 + (ck * 31) % 97 AS w0, 1e0 + (ck * 37) % 97 AS w1, 1e0 + (ck * 41) % 97 AS w2, 1e0 + (ck * 43) % 97 AS w3
FROM (SELECT *, CAST(substring(equipment_serial_no, 3) AS BIGINT) AS ck FROM latest) l
""")
_LABEL_CASE = "CASE risk_class " + " ".join(f"WHEN {k} THEN {O._q(v)}" for k, v in sorted(S.RISK_LABELS.items())) + " END"
_HEALTH_SQL = O.clip_sql(O.np_round_sql(
    f"(1e0 - p_high * {S.HEALTH_WEIGHT_HIGH}e0 - p_critical * {S.HEALTH_WEIGHT_CRITICAL}e0) * 100e0", 1),
    f"{S.HEALTH_MIN}e0", f"{S.HEALTH_MAX}e0")
def _classes_sql(source: str) -> str:
    return f"""
SELECT * EXCLUDE (w0, w1, w2, w3, ck, health_score), {_LABEL_CASE} AS predicted_risk, {_HEALTH_SQL} AS health_score
FROM (SELECT *, w0 / (w0 + w1 + w2 + w3) AS p_low, w1 / (w0 + w1 + w2 + w3) AS p_medium,
        w2 / (w0 + w1 + w2 + w3) AS p_high, w3 / (w0 + w1 + w2 + w3) AS p_critical,
        CAST(CASE WHEN w0 >= w1 AND w0 >= w2 AND w0 >= w3 THEN 0 WHEN w1 >= w2 AND w1 >= w3 THEN 1
                  WHEN w2 >= w3 THEN 2 ELSE 3 END AS INTEGER) AS risk_class
      FROM {source})
"""


O.add_cte("scored", _classes_sql("scored_w"))


def _components_select_sql(seed: int | None = None, source: str = "scored") -> str:
    ps = ["p_low", "p_medium", "p_high", "p_critical"]
    raw = []
    for i, (name, (wm, wh, wc), (lo, hi)) in enumerate(S.COMPONENTS):
        terms = [f"{ps[k]} * {w!r}e0" if "e" not in repr(w) else f"{ps[k]} * {w!r}"
                 for k, w in ((1, wm), (2, wh), (3, wc)) if w]
        factor = repr((lo + hi) / 2.0) if seed is None else f"({lo!r}::DOUBLE + ({hi!r}::DOUBLE - {lo!r}::DOUBLE) * {O.uniform_sql(seed + i, 'equipment_serial_no')})"
        raw.append((SC.COMPONENT_COLUMNS[name], O.np_round_sql(f"({terms[0]} + {terms[1]}) * {factor}", 3)))
    total = " + ".join(f"r_{c}" for c, _ in raw)
    inner = ", ".join(f"{e} AS r_{c}" for c, e in raw)
    outer = ", ".join(
        f"CASE WHEN ({total}) > 0 THEN {O.np_round_sql(f'r_{c} / ({total})', 3)} ELSE r_{c} END AS {c}" for c, _ in raw)
    return f"SELECT * EXCLUDE ({', '.join('r_' + c for c, _ in raw)}), {outer} FROM (SELECT *, {inner} FROM {source})"


O.add_cte("scored_components", _components_select_sql())
O.add_cte("scored_components_seeded", _components_select_sql(123))
COMP_COLS = list(SC.COMPONENT_COLUMNS.values())

# ---------------------------------------------------------------------------
# C — scoring
# ---------------------------------------------------------------------------


@register("c02_motor_sample", O.with_ctes(
    f"SELECT equipment_serial_no, installed_location, risk_label FROM latest "
    f"ORDER BY {O.draw_sql(123, 'equipment_serial_no')}, equipment_serial_no LIMIT 8", "latest"))
def c02(spark, sf_dir):
    return SC.sample_motors(latest(spark, sf_dir), 8, 123).select("equipment_serial_no", "installed_location", "risk_label")


@register("c03_model_health", O.with_ctes("SELECT equipment_serial_no, health_score FROM scored", "scored"))
def c03(spark, sf_dir):
    return scored(spark, sf_dir).select("equipment_serial_no", "health_score")


@register("c04_component_probabilities", O.with_ctes(
    f"SELECT equipment_serial_no, {', '.join(COMP_COLS)} FROM scored_components", "scored_components"))
def c04(spark, sf_dir):
    return (scored(spark, sf_dir).transform(SC.add_component_probabilities)
            .select("equipment_serial_no", *COMP_COLS))


_DAYS_CASE = "CASE risk_class " + " ".join(f"WHEN {k} THEN {v}" for k, v in sorted(S.INSPECTION_DAYS.items())) + " END"


@register("c05_inspection_date", O.with_ctes(
    f"SELECT equipment_serial_no, risk_class, strftime(DATE '{AS_OF}' + CAST({_DAYS_CASE} AS INTEGER), '%Y-%m-%d') "
    "AS suggested_inspection_date FROM scored", "scored"))
def c05(spark, sf_dir):
    return (scored(spark, sf_dir).transform(SC.add_inspection_date, AS_OF)
            .select("equipment_serial_no", "risk_class", "suggested_inspection_date"))


_ACTION_CASE = "CASE risk_class " + " ".join(
    f"WHEN {k} THEN {O._q(v)}" for k, v in sorted(S.RECOMMENDED_ACTIONS.items())) + " END"


@register("c06_recommended_action", O.with_ctes(
    f"SELECT equipment_serial_no, risk_class, {_ACTION_CASE} AS recommended_action FROM scored", "scored"))
def c06(spark, sf_dir):
    return (scored(spark, sf_dir).transform(SC.add_recommended_action)
            .select("equipment_serial_no", "risk_class", "recommended_action"))


def _prediction_columns_sql() -> str:
    rounded = ", ".join(f"{O.np_round_sql(c, 4)} AS {c}" for c in SC.PROBS)
    return (f"health_score, predicted_risk AS risk_category, risk_class, {rounded}, {', '.join(COMP_COLS)}, "
            f"{_ACTION_CASE} AS recommended_action, strftime(DATE '{AS_OF}' + CAST({_DAYS_CASE} AS INTEGER), '%Y-%m-%d') AS suggested_inspection_date")


def _prediction_sql(extra: str = "") -> str:
    return O.with_ctes(f"SELECT equipment_serial_no AS serial_no, {extra}{_prediction_columns_sql()} FROM scored_components", "scored_components")


def _flat_prediction() -> list:
    """The nested prediction, flattened for comparison."""
    p = F.col("prediction")
    return [p["health_score"].alias("health_score"), p["risk_category"].alias("risk_category"), p["risk_class"].alias("risk_class"),
            *[p["risk_probabilities"][k].alias(c) for k, c in zip(S.RISK_LABELS.values(), SC.PROBS, strict=True)],
            *[p["failure_probabilities"][k].alias(c) for k, c in SC.COMPONENT_COLUMNS.items()],
            p["recommended_action"].alias("recommended_action"), p["suggested_inspection_date"].alias("suggested_inspection_date")]


@register("c07_prediction_record", _prediction_sql())
def c07(spark, sf_dir):
    rec = SC.prediction_record(scored(spark, sf_dir).drop("health_score"), AS_OF)
    return rec.select(F.col("equipment_serial_no").alias("serial_no"), *_flat_prediction())


@register("c04_component_probabilities_seeded", O.with_ctes(
    f"SELECT equipment_serial_no, {', '.join(COMP_COLS)} FROM scored_components_seeded", "scored_components_seeded"))
def c04_seeded(spark, sf_dir):
    """Jitter drawn per motor from a hash of its serial (stable across reruns)."""
    return (scored(spark, sf_dir).transform(SC.add_component_probabilities, "seeded", 123)
            .select("equipment_serial_no", *COMP_COLS))


def _ranking_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT equipment_serial_no, {i} AS pos, {O._q(name)} AS component, {c} AS probability FROM scored_components"
        for i, (name, c) in enumerate(SC.COMPONENT_COLUMNS.items()))
    return O.with_ctes(
        "SELECT equipment_serial_no, CAST(row_number() OVER (PARTITION BY equipment_serial_no ORDER BY probability DESC, pos) "
        f"AS INTEGER) AS component_rank, component, probability FROM ({parts})", "scored_components")


@register("c08_component_ranking", _ranking_sql())
def c08(spark, sf_dir):
    return scored(spark, sf_dir).transform(SC.add_component_probabilities).transform(SC.component_ranking)


@register("c10_fleet_totals", O.with_ctes(
    f"SELECT count(*) AS total_motors, {MEAN_HEALTH_SQL} AS avg_health_score, "
    "round_even(median(round_even(health_score * 10e0, 0)), 0) / 10e0 AS median_health_score FROM scored", "scored"))
def c10(spark, sf_dir):
    return SC.fleet_totals(scored(spark, sf_dir))


@register("c11_risk_distribution", O.with_ctes(
    "SELECT d.risk_label, d.risk_class, CAST(coalesce(c.n, 0) AS BIGINT) AS motor_count, "
    "coalesce(c.n, 0) * 100e0 / (SELECT count(*) FROM scored) AS pct "
    f"FROM {_label_values_sql()} LEFT JOIN (SELECT predicted_risk, count(*) AS n FROM scored "
    "WHERE predicted_risk IS NOT NULL GROUP BY predicted_risk) c ON c.predicted_risk = d.risk_label", "scored"))
def c11(spark, sf_dir):
    return SC.risk_distribution(spark, scored(spark, sf_dir))


_TOP_COLS = ["equipment_serial_no", "equipment_type_text", "installed_location", "kw", "motor_age_years",
             "risk_class", "predicted_risk", "health_score"]


@register("c12_top_at_risk", O.with_ctes(
    f"SELECT {', '.join(_TOP_COLS)} FROM scored ORDER BY risk_class DESC, equipment_serial_no LIMIT 10", "scored"))
def c12(spark, sf_dir):
    return SC.top_at_risk(scored(spark, sf_dir), 10).select(*_TOP_COLS)


@register("c13_department_risk_summary", O.with_ctes(
    f"SELECT installed_location, {MEAN_HEALTH_SQL} AS avg_health, "
    f"{O.np_round_sql('avg(risk_class)', 1)} AS avg_risk, count(equipment_serial_no) AS motor_count "
    "FROM scored WHERE installed_location IS NOT NULL GROUP BY installed_location", "scored"))
def c13(spark, sf_dir):
    return SC.department_risk_summary(scored(spark, sf_dir))


_METADATA_SQL = (
    "coalesce(equipment_type_text, 'N/A') AS equipment_type, coalesce(make, 'N/A') AS manufacturer, "
    "coalesce(installed_location, 'N/A') AS installed_location, coalesce(kw, 0) AS kw_rating, coalesce(rpm, 0) AS rpm, "
    "coalesce(motor_age_years, 0) AS age_years, ")


@register("c14_motor_report", _prediction_sql(_METADATA_SQL))
def c14(spark, sf_dir):
    return SC.motor_report(scored(spark, sf_dir), AS_OF).select("metadata.*", *_flat_prediction())



