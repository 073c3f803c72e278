"""Hand-written cases for the null, tie and rounding rules (FIXTURES §5)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from motorlytics import schema as S
from motorlytics.operators import dashboards as DB
from motorlytics.operators import features as FE
from motorlytics.operators import scoring as SC

D = dt.date
REQ_DDL = ("requisition_id long, equipment_serial_no string, received_date date, "
           "previous_refurbishment_job_no string, reason_of_failure_text string")


def _history(spark, rows, compat=False):
    df = spark.createDataFrame(rows, REQ_DDL)
    out = FE.add_repair_history(df, compat).orderBy("requisition_id").collect()
    return {r.requisition_id: r for r in out}


def test_refurb_empty_null_set(spark):
    rows = [(1, "A", D(2024, 1, 1), "", "x"), (2, "A", D(2024, 2, 1), None, "x"), (3, "A", D(2024, 3, 1), "JOB-1", "x")]
    h = _history(spark, rows)
    assert [h[i].previous_refurb_count for i in (1, 2, 3)] == [0, 0, 1]
    h = _history(spark, rows, compat=True)
    assert [h[i].previous_refurb_count for i in (1, 2, 3)] == [1, 2, 3]


def test_same_day_ties_break_on_id(spark):
    h = _history(spark, [(5, "A", D(2024, 1, 1), None, "x"), (4, "A", D(2024, 1, 1), None, "x")])
    assert h[4].repair_count == 1 and h[5].repair_count == 2
    assert h[4].days_since_last_repair == 1095 and h[5].days_since_last_repair == 0


def test_missing_date_sorts_last(spark):
    h = _history(spark, [(1, "A", None, None, "Bearing Failure"), (2, "A", D(2024, 1, 1), None, "x")])
    assert h[2].repair_count == 1 and h[1].repair_count == 2
    assert h[1].days_since_last_repair == 1095  # no date -> default gap
    assert h[1].bearing_failure_count == 1 and h[2].bearing_failure_count == 0


def test_first_repair_recency_zero(spark):
    df = spark.createDataFrame([(30, 1, 1095, 10.0, 0, 0, 0, 0)],
                               "motor_age_years int, repair_count int, days_since_last_repair int, kw double, "
                               "bearing_failure_count long, winding_failure_count long, rotor_failure_count long, "
                               "insulation_failure_count long")
    r = FE.add_risk_components(df).first()
    assert r.recency_score == 0.0 and r.age_score == 1.0


def test_null_year_gives_medium_and_null_health(spark):
    df = spark.createDataFrame([(None, 1, 1095, 10.0, 0, 0, 0, 0)],
                               "motor_age_years int, repair_count int, days_since_last_repair int, kw double, "
                               "bearing_failure_count long, winding_failure_count long, rotor_failure_count long, "
                               "insulation_failure_count long")
    r = FE.add_risk_target(df).first()
    assert r.risk_category == 1 and r.risk_label == "MEDIUM" and r.health_score is None


@pytest.mark.parametrize("score,cls", [(0.2499, 0), (0.25, 1), (0.45, 2), (0.65, 3), (None, 1)])
def test_thresholds(spark, score, cls):
    df = spark.createDataFrame([(score,)], "s double")
    assert df.select(FE.risk_category_expr(F.col("s")).alias("c")).first().c == cls


def test_numpy_rounding(spark):
    from motorlytics.functions.expr import np_round
    df = spark.createDataFrame([(0.35,), (2.675,), (0.25,)], "x double")
    got = [r.y for r in df.select(np_round(F.col("x"), 1).alias("y")).collect()]
    assert got == [0.4, 2.7, 0.2]


def test_latest_takes_last_non_null_per_column(spark):
    df = spark.createDataFrame([(1, "A", D(2024, 1, 1), 10.0, "old"), (2, "A", D(2024, 2, 1), None, "new")],
                               "requisition_id long, equipment_serial_no string, received_date date, kw double, status string")
    r = SC.latest_records(df).first()
    assert r.kw == 10.0 and r.status == "new" and r.requisition_id == 2


def test_unseen_category_minus_one(spark):
    cols = {"make": "make_encoded"}
    fit = spark.createDataFrame([("a",), ("b",), (None,)], "make string")
    enc = FE.fit_encoders(fit, cols)
    codes = {r.value: r.code for r in enc.collect()}
    assert codes == {"a": 0, "b": 1, "nan": 2}
    app = spark.createDataFrame([("zz",), ("b",), (None,)], "make string")
    got = sorted((r.make or "", r.make_encoded) for r in FE.apply_encoders(app, enc, cols).collect())
    assert got == [("", 2), ("b", 1), ("zz", -1)]


def test_null_status_counts_as_outstanding(spark):
    df = spark.createDataFrame([(50.0, None), (25.0, "CLOSED"), (100.0, "RECEIVED")], "kw double, status string")
    bands = {r.category: r for r in DB.power_band_stats(spark, df).collect()}
    mid = bands["25.1 - 100 KW"]
    assert (mid.received_outstanding, mid.repaired, mid.at_ers) == (2, 0, 1)
    small = bands["<= 25 KW"]
    assert (small.received_outstanding, small.repaired, small.at_ers) == (0, 1, 0)
    assert bands["> 100 KW"].received_outstanding == 0


def test_null_update_lands_in_first_band(spark):
    df = spark.createDataFrame([(D(2024, 1, 1), None, "CLOSED", "Rewinding")],
                               "received_date date, updated_at timestamp, status string, service_type_text string")
    r = DB.turnaround_rewinding(df).first()
    assert r.rew_0_7 == 1 and r.rew_total == 1


def test_health_extremes_and_zero_components(spark):
    df = spark.createDataFrame([("A", 0.0, 0.0, 0.0, 1.0, 3), ("B", 1.0, 0.0, 0.0, 0.0, 0)],
                               "equipment_serial_no string, p_low double, p_medium double, p_high double, "
                               "p_critical double, risk_class int")
    out = {r.equipment_serial_no: r for r in
           SC.add_component_probabilities(SC.add_model_health(df)).collect()}
    assert out["A"].health_score == 30.0 and out["B"].health_score == 99.0
    assert [out["B"][c] for c in SC.COMPONENT_COLUMNS.values()] == [0.0, 0.0, 0.0, 0.0]
    total = sum(out["A"][c] for c in SC.COMPONENT_COLUMNS.values())
    assert abs(total - 1.0) <= 0.002


def test_checklist_rules(spark):
    latest = spark.createDataFrame([("A", 1, 400, 0, 0, 0, 0, 0)],
                                   "equipment_serial_no string, repair_count int, days_since_last_repair int, "
                                   "previous_refurb_count long, bearing_failure_count long, winding_failure_count long, "
                                   "rotor_failure_count long, insulation_failure_count long")
    req = spark.createDataFrame([("A", ["R2", "G6", "R2", "G4", "Z9"]), ("Q", ["R2"])], S.CHECKLIST_REQUEST_SCHEMA)
    out = {r.serial_no: r for r in DB.apply_checklist(latest, DB.checklist_counts(DB.explode_checklists(req))).collect()}
    a = out["A"]
    assert (a.bearing_failure_count, a.repair_count, a.previous_refurb_count, a.days_since_last_repair) == (3, 2, 1, 14)
    assert out["Q"].found is False
    from motorlytics.streaming.checklist import whatif
    s = whatif(req.withColumn("request_id", F.lit(1).cast("long")), latest).where("serial_no = 'A'").first()
    assert (s.bearing_failure_count, s.repair_count, s.days_since_last_repair) == (3, 2, 14)


def test_search_is_literal(spark):
    reg = spark.createDataFrame([("EQ1", "a%b", "m", "n", "loc"), ("EQ2", "ab", "m", "n", "loc")],
                                "equipment_serial_no string, make string, model string, main_equipment_name string, "
                                "installed_location string")
    assert [r.equipment_serial_no for r in DB.registry_search(reg, "%").collect()] == ["EQ1"]
    assert DB.registry_search(reg, "A_B").count() == 0


def test_draws_are_portable_and_uniform(spark):
    """The draw is the leading 52 bits of an md5 that any engine computes."""
    import hashlib
    from motorlytics.functions.expr import draw_bits, hash_normal, hash_uniform
    rows = spark.range(2000).select("id", draw_bits(42, F.col("id")).alias("b"), hash_uniform(42, F.col("id")).alias("u"), hash_normal(42, F.col("id")).alias("z")).collect()
    for r in rows[:50]:
        assert r["b"] == int(hashlib.md5(f"42:{r['id']}".encode()).hexdigest()[:13], 16) and r["u"] == r["b"] / 2 ** 52
    assert abs(sum(r["u"] for r in rows) / 2000 - 0.5) < 0.03 and abs(sum(r["z"] ** 2 for r in rows) / 2000 - 1) < 0.15
    assert len({r["b"] for r in rows}) == 2000


def test_latest_by_position_takes_each_column_from_its_own_row(spark):
    from motorlytics.operators import scoring as SC
    rows = [("a", 1, "x", None, None), ("a", 2, None, 5, None), ("a", 3, None, None, None), ("b", 1, "y", 1, None), (None, 1, "z", 9, None)]
    df = spark.createDataFrame(rows, "equipment_serial_no string, repair_count long, s string, n int, never double")
    got = {r["equipment_serial_no"]: tuple(r)[1:] for r in SC.latest_by_position(df, "repair_count").collect()}
    assert got == {"a": (3, "x", 5, None), "b": (1, "y", 1, None)}
    assert SC.latest_by_position(df.limit(0), "repair_count").count() == 0
    plan = SC.latest_by_position(df, "repair_count")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
