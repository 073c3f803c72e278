"""The bucketed helpers must equal plain windows, including for a hot key."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from motorlytics.plans.ordering import global_prefix, segmented_running, segments


def _history(spark, n=3000, hot=3):
    """Rows of one hot key (1 in ``hot``), fifty others and a null one, with null dates."""
    return spark.range(n).select(
        F.col("id").alias("rid"),
        F.when(F.col("id") % hot == 0, F.lit("HOT")).when(F.col("id") % 50 != 7, (F.col("id") % 50).cast("string")).alias("k"),
        F.when(F.col("id") % 13 != 0, F.col("id") % 17).alias("d"),
        (F.col("id") % 4 == 0).cast("long").alias("v"))


def _plain(df):
    w = Window.partitionBy("k").orderBy(F.col("d").isNull(), "d", "rid")
    has = F.col("k").isNotNull()
    return sorted((tuple(r) for r in df.select("rid", F.when(has, F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("cum_v"),
                  F.when(has, F.lag("rid").over(w)).alias("prev_rid"), F.when(has, F.row_number().over(w)).alias("pos")).collect()))


def _segmented(df, partitions):
    order = {"_n": F.col("d").isNull(), "_d": F.col("d"), "_r": F.col("rid")}
    out = segmented_running(df, "k", order, sums={"cum_v": F.col("v")}, lags={"prev_rid": F.col("rid")}, position="pos", partitions=partitions)
    assert out.columns == [*df.columns, "pos", "cum_v", "prev_rid"] and dict(out.dtypes)["pos"] == "bigint"
    return sorted(tuple(r) for r in out.select("rid", "cum_v", "prev_rid", "pos").collect())


def test_segmented_running_hot_key_matches_window(spark):
    """One range, a few, as many as rows allow, and the range exchange beyond the tree's bounds."""
    df = _history(spark).repartition(5)
    want = _plain(df)
    for partitions in (1, 7, 64, 600):
        assert _segmented(df, partitions) == want


def test_segmented_running_empty_and_tiny(spark):
    assert _segmented(_history(spark, 0), 8) == []
    tiny = _history(spark, 4)
    assert _segmented(tiny, 8) == _plain(tiny)


def test_segments_balance_a_million_row_motor(spark):
    df = _history(spark, 1_250_000, 1).withColumn("k", F.when(F.col("rid") < 1_000_000, F.lit("HOT")).otherwise((F.col("rid") % 5000).cast("string")))
    dealt, cut = segments(df.withColumn("n", F.col("d").isNull()), "k", ["n", "d", "rid"], 16)
    sizes = [r["count"] for r in dealt.groupBy("_pid").count().collect()]
    assert len(sizes) == 16 and max(sizes) <= 1.5 * sum(sizes) / 16
    assert cut.where("k = 'HOT'").count() == 1 and cut.count() <= 15


def test_segmented_running_shuffles_wide_rows_once(spark):
    """One exchange takes the rows (to their range, no key); the others take totals of cut keys."""
    df = _history(spark)
    order = {"_n": F.col("d").isNull(), "_d": F.col("d"), "_r": F.col("rid")}
    out = segmented_running(df, "k", order, sums={"cum_v": F.col("v")}, lags={"prev": F.col("rid")}, position="pos", partitions=8)
    lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
    below = [lines[i + 1] for i, line in enumerate(lines) if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line]
    assert sum("REPARTITION_BY_NUM" in line for line in lines) == 1
    assert below and all("Aggregate" in line for line in below), below
    assert "SinglePartition" not in "".join(lines)


def test_global_prefix_matches_row_number(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"), (F.col("id") % 3).alias("g"))
    out = global_prefix(df, ["x"], "pos", partition=["g"], n_buckets=16)
    ref = df.select("x", "g", F.row_number().over(Window.partitionBy("g").orderBy("x")).alias("pos"))
    assert sorted(tuple(r) for r in out.select("x", "g", "pos").collect()) == sorted(tuple(r) for r in ref.collect())


def test_global_prefix_weighted(spark):
    df = spark.range(1, 301).select(F.col("id").alias("x"), F.col("id").alias("w"))
    out = {r.x: r.c for r in global_prefix(df, ["x"], "c", value=F.col("w"), n_buckets=8).collect()}
    assert out[300] == 300 * 301 // 2 and out[10] == 55


def test_repartition_invariance(spark):
    from motorlytics.sources.fixtures import requisitions
    from motorlytics.operators.features import add_repair_history
    from tests.conftest import SF_SMALL
    req = requisitions(spark, SF_SMALL)
    a = add_repair_history(req.repartition(1)).select("requisition_id", "repair_count", "days_since_last_repair")
    b = add_repair_history(req.repartition(64)).select("requisition_id", "repair_count", "days_since_last_repair")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_global_prefix_string_keys_and_two_sums(spark):
    df = spark.range(4000).select(F.format_string("K%05d", (F.col("id") * 7919) % 4000).alias("s"),
                                  (F.col("id") % 2).alias("a"), F.lit(1).alias("b"))
    out = global_prefix(df, ["s"], sums={"ca": F.col("a"), "cb": F.col("b")}, n_buckets=32)
    w = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.select("s", F.sum("a").over(w).alias("ca"), F.sum("b").over(w).alias("cb"))
    assert sorted(tuple(r) for r in out.select("s", "ca", "cb").collect()) == sorted(tuple(r) for r in ref.collect())


def test_global_prefix_many_buckets_agree(spark):
    """16 buckets (CASE tree), 600 (range exchange) and the counted default agree."""
    df = spark.range(3000).select((F.col("id") * 7919 % 3000).alias("x"), (F.col("id") % 2).alias("g"))
    want = None
    for n in (None, 16, 600):
        got = sorted(tuple(r) for r in global_prefix(df, ["x"], "pos", partition=["g"], n_buckets=n).select("g", "x", "pos").collect())
        want = want or got
        assert got == want


def test_global_prefix_bucket_count_follows_rows(spark, monkeypatch):
    from motorlytics.plans import ordering
    monkeypatch.setattr(ordering, "BUCKET_ROWS", 100)
    out = global_prefix(spark.range(2500).withColumnRenamed("id", "x"), ["x"], "pos")
    assert out.where("pos <> x + 1").count() == 0
    assert global_prefix(spark.range(0).withColumnRenamed("id", "x"), ["x"], "pos").count() == 0
