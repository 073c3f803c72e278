"""Ordered computations that stay distributed.

Two helpers replace windows that would otherwise put one whole group (or the
whole table) into a single task:

``segmented_running``
    running sums / row position / lag inside each key, where one key may hold a
    large share of all rows: a segmented scan. Rows are dealt by ranges of the
    whole (key, order) tuple, told from a sample, so a task's share does not
    hang on how rows are spread over keys; each partition is windowed on its
    own; and only the few keys that a range bound cuts carry their totals from
    one partition to the next.

``global_prefix``
    a running sum in a total order over the whole table (or over a few large
    groups). A bounded sample of the order key gives range bounds; rows are
    windowed inside their range bucket and offset by the totals of the buckets
    before them. No ``Exchange SinglePartition`` is planned on the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from motorlytics.session import ensure_checkpoint_dir

UNBOUNDED = Window.unboundedPreceding


def segments(df: DataFrame, key: str, order: list[str], partitions: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """``df`` with ``_pid``, the range of the (key, order) tuple that a row falls into,
    and the keys that lie in more than one range (None if there is one range).

    There is a range for each shuffle partition unless told otherwise. Up to
    ``TREE_BOUNDS`` bounds come from ``SEGMENT_SAMPLE`` sampled tuples a range, so a
    range is within some 30 % of the mean. More ranges are dealt by Spark's own
    range exchange and checkpointed, so that every later read sees the same ones.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n > TREE_BOUNDS:
        ensure_checkpoint_dir(df.sparkSession)
        dealt = df.repartitionByRange(n, key, *order).withColumn("_pid", F.spark_partition_id()).checkpoint()
        ends = dealt.groupBy("_pid").agg(F.min(key).alias("a"), F.max(key).alias("b"))
        return dealt, ends.select(F.explode(F.array("a", "b")).alias(key)).where(F.col(key).isNotNull()).distinct()
    okey = F.struct(F.col(key), *[F.col(c) for c in order])
    bounds = range_bounds(df, [key, *order], n, per_bucket=SEGMENT_SAMPLE) if n > 1 else []
    if not bounds:
        return df.withColumn("_pid", F.lit(0)), None
    types = df.select(okey.alias("k")).schema["k"].dataType
    dealt = df.withColumn("_pid", bucket_expr(okey, _bound_literals(bounds, types)))
    cut = sorted({b[0] for b in bounds if b[0] is not None})
    return dealt, df.sparkSession.createDataFrame([(c,) for c in cut], T.StructType([T.StructField(key, df.schema[key].dataType)]))


def segmented_running(df: DataFrame, key: str, order: dict[str, Column], sums: dict[str, Column] | None = None,
                      lags: dict[str, Column] | None = None, position: str | None = None, partitions: int | None = None) -> DataFrame:
    """Per ``key``, rows ordered by the ``order`` expressions (named helper columns, nulls
    first; unique per key).

    Adds: each ``sums`` name = inclusive running sum; each ``lags`` name = value of the
    expression on the previous row of the key; ``position`` = 1-based row number within
    the key (long). Rows with a null key get nulls.

    The wide rows are shuffled once, to the partition of their range. Keys that bounds
    cut - no more than there are bounds - are aggregated beforehand, by (range, key), and
    the prefix of these totals joins back as the carry: at most two rows a bound.
    """
    sums, lags, ocols = sums or {}, lags or {}, list(order)
    rows = df.withColumns({**order, **{f"_v_{n}": c for n, c in sums.items()}, **{f"_l_{n}": c for n, c in lags.items()}})
    rows, cut = segments(rows, key, ocols, partitions)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the partition id is the range, so a window by (range, key) needs no further exchange
    dealt = rows.repartitionById(n, F.col("_pid")) if cut is not None and n <= TREE_BOUNDS else rows
    w_in = Window.partitionBy("_pid", key).orderBy(*ocols)
    w_cum = w_in.rowsBetween(UNBOUNDED, Window.currentRow)
    out = dealt.select("*", F.row_number().over(w_in).cast("long").alias("_rn"),
                       *[F.sum(f"_v_{c}").over(w_cum).alias(f"_in_{c}") for c in sums],
                       *[F.lag(f"_l_{c}").over(w_in).alias(f"_inlag_{c}") for c in lags])
    if cut is not None:
        few = F.broadcast(cut) if n <= TREE_BOUNDS else cut  # a key for each bound at most
        totals = rows.join(few, key, "left_semi").groupBy("_pid", key).agg(
            F.count(F.lit(1)).alias("_cnt"), *[F.sum(f"_v_{c}").alias(f"_tot_{c}") for c in sums],
            *[F.max_by(f"_l_{c}", F.struct(*ocols)).alias(f"_last_{c}") for c in lags])
        w_key = Window.partitionBy(key).orderBy("_pid")
        w_before = w_key.rowsBetween(UNBOUNDED, -1)
        carry = totals.select("_pid", key, F.sum("_cnt").over(w_before).alias("_off_rn"),
                              *[F.sum(f"_tot_{c}").over(w_before).alias(f"_off_{c}") for c in sums],
                              *[F.lag(f"_last_{c}").over(w_key).alias(f"_prev_{c}") for c in lags])
        out = out.join(F.broadcast(carry) if n <= TREE_BOUNDS else carry, ["_pid", key], "left")
    else:
        out = out.withColumns({"_off_rn": F.lit(0), **{f"_off_{c}": F.lit(0) for c in sums}, **{f"_prev_{c}": F.lit(None) for c in lags}})
    has_key, zero = F.col(key).isNotNull(), F.lit(0)
    new = {position: F.col("_rn") + F.coalesce("_off_rn", zero)} if position else {}
    new |= {c: F.col(f"_in_{c}") + F.coalesce(f"_off_{c}", zero) for c in sums}
    new |= {c: F.when(F.col("_rn") == 1, F.col(f"_prev_{c}")).otherwise(F.col(f"_inlag_{c}")) for c in lags}
    return out.select(*df.columns, *(F.when(has_key, v).alias(c) for c, v in new.items()))


def _bound_literals(rows: list, key_type: T.StructType) -> list[Column]:
    return [F.struct(*[F.lit(r[i]).cast(f.dataType).alias(f.name) for i, f in enumerate(key_type.fields)])
            for r in rows]


def range_bounds(df: DataFrame, keycols: list[str], n_buckets: int, seed: int = 42, per_bucket: int = 20) -> list:
    """Up to ``n_buckets - 1`` split points for the struct of ``keycols``,
    ascending in Spark's own ordering.

    One job: the ``per_bucket * n_buckets`` rows with the smallest hash of the key are
    a uniform sample without replacement (Spark takes a per-partition top-k
    and merges, so at most that many rows reach the driver); Spark then sorts
    that sample by the key.
    """
    k = per_bucket * n_buckets
    okey = F.struct(*[F.col(c) for c in keycols])
    sample = (df.select(okey.alias("k"), F.xxhash64(*[F.col(c) for c in keycols], F.lit(seed)).alias("h"))
              .orderBy("h").limit(k).orderBy("k").collect())
    ks = [tuple(r["k"]) for r in sample]
    if not ks:
        return []
    step = len(ks) / n_buckets
    bounds = []
    for i in range(1, n_buckets):
        b = ks[int(i * step)]
        if not bounds or b != bounds[-1]:
            bounds.append(b)
    return bounds


def bucket_expr(okey: Column, bounds: list[Column]) -> Column:
    """Number of ``bounds`` (ascending) that are <= ``okey``, as a balanced
    CASE tree: about log2(len(bounds)) code-generated comparisons per row."""
    def rec(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(bounds[mid] <= okey, rec(mid + 1, hi)).otherwise(rec(lo, mid))
    return rec(0, len(bounds))


#: Tuples sampled for each range of ``segments``.
SEGMENT_SAMPLE = 100
#: Rows meant for one range bucket of ``global_prefix``.
BUCKET_ROWS = 1 << 20
#: Bounds compiled into one CASE tree; more buckets are dealt by a range exchange.
TREE_BOUNDS = 512


def global_prefix(df: DataFrame, order: list[str], out: str | None = None, value: Column | None = None,
                  partition: list[str] | None = None, n_buckets: int | None = None, seed: int = 42,
                  sums: dict[str, Column] | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` (default 1) in ascending ``order``,
    restarting per ``partition`` group. Order keys should be unique within a
    group (ties are then ordered arbitrarily but consistently).

    Rows are range-bucketed on ``(partition, order)``, windowed inside their
    bucket, and offset by the totals of the earlier buckets of their group (a
    table of at most ``n_buckets + groups`` rows). The number of buckets follows
    the counted rows (``BUCKET_ROWS`` each) and has no upper limit. Up to
    ``TREE_BOUNDS`` of them are told by sampled bounds in an expression; beyond
    that a range exchange deals the rows, whose bucket is then checkpointed, so
    that every later read sees the same one.
    """
    partition = partition or []
    keycols = [*partition, *order]
    okey = F.struct(*[F.col(c) for c in keycols])
    key_type = df.select(okey.alias("k")).schema["k"].dataType
    if n_buckets is None:
        n_buckets = max(1, -(-df.count() // BUCKET_ROWS))
    bounds = None
    if n_buckets > TREE_BOUNDS:
        bounds = []
        ensure_checkpoint_dir(df.sparkSession)
        df = df.repartitionByRange(n_buckets, *keycols).withColumn("_bk", F.spark_partition_id()).checkpoint()
        bucket = F.col("_bk")
    elif n_buckets > 1 and (bounds := range_bounds(df, keycols, n_buckets, seed)):
        bucket = bucket_expr(okey, _bound_literals(bounds, key_type))
    else:
        bounds, bucket = None, F.lit(0)
    sums = dict(sums or {})
    if out is not None:
        sums[out] = value if value is not None else F.lit(1)
    names = list(sums)
    d1 = df.withColumns({"_bk": bucket, **{f"_val{i}": sums[n] for i, n in enumerate(names)}})
    w_in = Window.partitionBy("_bk", *partition).orderBy(*keycols).rowsBetween(UNBOUNDED, Window.currentRow)
    if bounds is None:  # one bucket: nothing to offset
        return d1.withColumns({n: F.sum(f"_val{i}").over(w_in) for i, n in enumerate(names)}).drop("_bk", *[f"_val{i}" for i in range(len(names))])
    inner = d1.select("*", *[F.sum(f"_val{i}").over(w_in).alias(f"_in{i}") for i in range(len(names))])
    totals = d1.groupBy("_bk", *partition).agg(*[F.sum(f"_val{i}").alias(f"_tot{i}") for i in range(len(names))])
    w_tot = (Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0)))
    w_tot = w_tot.orderBy("_bk").rowsBetween(UNBOUNDED, -1)
    offsets = totals.select("_bk", *partition, *[F.coalesce(F.sum(f"_tot{i}").over(w_tot), F.lit(0)).alias(f"_off{i}")
                                                 for i in range(len(names))])
    joined = inner.join(offsets, on=["_bk", *partition], how="left")
    helpers = ["_bk"] + [f"{p}{i}" for i in range(len(names)) for p in ("_val", "_in", "_off")]
    return joined.withColumns({n: F.col(f"_in{i}") + F.col(f"_off{i}") for i, n in enumerate(names)}).drop(*helpers)
