"""Properties of whole-table results and shape checks on the physical plans."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from motorlytics import schema as S
from motorlytics.operators import features as FE
from motorlytics.sources.fixtures import requisitions
from tests.conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and set(df.columns) == {"installed_location", "avg_health", "avg_risk", "motor_count"}


def test_history_properties(spark):
    eng, _ = FE.engineer(requisitions(spark, SF_SMALL))
    bad = eng.where(
        (F.col("bearing_failure_count") + F.col("winding_failure_count") + F.col("rotor_failure_count")
         + F.col("insulation_failure_count") > F.col("repair_count"))
        | (F.col("previous_refurb_count") > F.col("repair_count"))
        | (F.col("health_score") < 0) | (F.col("health_score") > 100))
    assert bad.count() == 0
    # running counts are monotone along each motor's history
    from pyspark.sql import Window
    w = Window.partitionBy("equipment_serial_no").orderBy("received_date", "requisition_id")
    lagged = eng.select("repair_count", F.lag("repair_count").over(w).alias("p"))
    assert lagged.where(F.col("p").isNotNull() & (F.col("repair_count") != F.col("p") + 1)).count() == 0


def test_band_counts_add_up(spark):
    q = E.queries()
    r = q["d10_turnaround_rewinding"](spark, SF_SMALL).first()
    assert r.rew_total == r.rew_0_7 + r.rew_8_15 + r.rew_15_30 + r.rew_30_plus
    d = q["d08_dispatched_breakdown"](spark, SF_SMALL).first()
    assert d.mechanical_jobs + d.bearings_required + d.spares_required == d.dispatched


def test_split_and_folds_disjoint_and_stratified(spark):
    from motorlytics.operators import training as TR
    prep = TR.prepare(FE.engineer(requisitions(spark, SF_SMALL))[0])
    split = TR.stratified_split(prep)
    per = {r.label: (r.n, r.t) for r in split.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")).collect()}
    for n, t in per.values():
        assert abs(t - 0.2 * n) < 1  # each class has its share
    assert sum(t for _, t in per.values()) == -(-sum(n for n, _ in per.values()) * 2 // 10)  # ceil(0.2 n) in all
    folds = TR.stratified_folds(prep, 5)
    sizes = [r["count"] for r in folds.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 4
    assert folds.select("requisition_id").distinct().count() == prep.count()


def test_history_plan_has_no_single_partition_and_no_python(spark):
    df = FE.add_repair_history(requisitions(spark, SF_SMALL))
    plan = _plan(df)
    assert "SinglePartition" not in plan
    assert "EvalPython" not in plan


def test_core_queries_have_no_python_udfs(spark):
    q = E.queries()
    for name in ["f18_feature_engineering", "c01_latest_records", "d04_equipment_registry", "d09_power_band_stats",
                 "m07_roc_auc_weighted", "d03_checklist_adjust"]:
        plan = _plan(q[name](spark, SF_SMALL))
        assert "EvalPython" not in plan, name


def test_scan_prunes_columns_and_pushes_filters(spark):
    df = requisitions(spark, SF_SMALL).where(F.col("received_date") >= F.lit("1996-01-01").cast("date")) \
        .select("requisition_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan and "PushedFilters" in plan


def test_registry_oracle_keys_subset():
    assert set(E.oracle_sql()) <= set(E.queries())
    for name in E.queries():
        assert name.split("_")[0][0] in "fpcdmso", name  # o: the numbered operators op1_ ...
    assert len(S.FEATURE_COLUMNS) == 18


def test_single_partition_only_above_bucket_totals(spark):
    """global_prefix may gather its bucket-total table (<= buckets + groups
    rows) into one partition, never the rows being ordered."""
    from motorlytics.plans.ordering import global_prefix
    df = spark.range(20000).select((F.col("id") * 7919 % 20000).alias("x"))
    out = global_prefix(df, ["x"], "pos", n_buckets=16)
    lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            child = lines[i + 1]
            assert "HashAggregate" in child and "_bk" in child, child
    assert out.agg(F.max("pos")).first()[0] == 20000


def test_latest_position_key_equals_struct_key(spark):
    from motorlytics.operators import scoring as SC
    eng, _ = FE.engineer(requisitions(spark, SF_SMALL))
    eng = eng.drop("updated_at")
    a = SC.latest_records(eng)
    b = SC.latest_records(eng, position_col="repair_count")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    c = SC.latest_by_position(eng, "repair_count")
    assert a.columns == c.columns and a.exceptAll(c).count() == 0 and c.exceptAll(a).count() == 0
