"""Lookups of the feature table and the median counts: small sides are broadcast, counts
are worked out once."""

from pyspark.sql import functions as F

from motorlytics.operators import features as FE
from motorlytics.operators import training as TR


def _requisitions(spark, n=600):
    k = F.col("id")
    return spark.range(n).select(
        k.alias("requisition_id"), F.when(k % 50 != 7, F.concat(F.lit("EQ"), (k % 40).cast("string"))).alias("equipment_serial_no"),
        F.when(k % 13 != 5, F.concat(F.lit("D"), (k % 7).cast("string"))).alias("installed_location"), F.concat(F.lit("M"), (k % 3).cast("string")).alias("make"))


def _joins(df):
    plan = df._jdf.queryExecution().sparkPlan().toString()  # before any stage has run
    return plan.count("BroadcastHashJoin"), plan.count("SortMergeJoin")


def test_group_rates_leave_wide_rows_where_they_are(spark):
    """Without a broadcast told beforehand, the rows are shuffled by a handful of keys."""
    req = _requisitions(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = FE.add_failure_rates(req)
        assert _joins(out) == (2, 0)
        rows = out.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    pdf = req.toPandas()
    for col, rate in (("installed_location", "dept_failure_rate"), ("make", "make_failure_rate")):
        want = {g: len(r) / r["equipment_serial_no"].nunique() for g, r in pdf.groupby(col)}
        assert len(rows) == len(pdf) and all(r[rate] == want.get(r[col]) for r in rows)


def test_group_rates_of_many_groups_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(FE, "LOOKUP_ROWS", 2)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = FE.add_failure_rates(_requisitions(spark))
        assert _joins(out) == (0, 2) and out.count() == 600
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_medians_read_the_table_once(spark):
    """Sizes and prefix come from the stored counts, not each from the table."""
    df = spark.range(100).select((F.col("id") % 9).alias("a"), (F.col("id") * 0.5).alias("b"))
    med = TR.exact_medians(df, ["a", "b"])
    assert "Range" not in med._jdf.queryExecution().optimizedPlan().toString()
    assert {r["feature"]: r["median"] for r in med.collect()} == {"a": 4.0, "b": 24.75}


def test_predictions_of_one_model_fit_only_that_model(spark, monkeypatch):
    from motorlytics.registry import training as RT
    fitted = []
    monkeypatch.setattr(RT, "training_sets", lambda *_: (None, spark.range(4).withColumn("requisition_id", F.col("id")).withColumn("label", F.lit(1))))
    monkeypatch.setattr(RT, "trained", lambda _s, _d, kind: fitted.append(kind) or kind)
    monkeypatch.setattr(TR, "predict", lambda model, rows: rows.withColumns({"prediction": F.lit(1), "prob": F.array(F.lit(1.0))}))
    assert RT.m04(spark, "/only-forest").count() == 4 and fitted == ["rf"]
    assert RT.m03(spark, "/only-boosted").count() == 4 and fitted == ["rf", "gbt"]
    assert RT.test_predictions(spark, "/both").count() == 8 and sorted(fitted) == ["gbt", "gbt", "rf", "rf"]


def test_checklist_response_is_flattened_from_the_written_answers(spark):
    from motorlytics.registry.serving import d03_response
    from tests.conftest import SF_SMALL
    out = d03_response(spark, SF_SMALL)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == spark.read.parquet(f"{SF_SMALL}/orders.parquet").count()
