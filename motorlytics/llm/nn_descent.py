"""Approximate nearest neighbours: NN-descent graph, greedy search.

Building. Each vector starts with a coarse list: a few of its nearest inside two small
hyperplane blocks and inside a random group, which keeps the blocks connected.
NN-descent then improves the lists in rounds of Spark joins, at every table size: a node's neighbours and a
sample of those that list it are brought together with their vectors, and every two of
them of which one is new tell each other their distance, if it beats the worst entry
of the other's list; rounds end when few entries change. Vectors and lists are broadcast to
the joins while their counted bytes are under the bound, and shuffled beyond it. Vectors
travel in the table's own precision; distances are taken in double precision, again by differences where the
product form would lose digits or overflow, so one huge vector or a group of near copies
does not blur the others. Reverse lists are sampled to about ``k``, told from pre-aggregated
counts, so no node gathers an unbounded list.

Searching. Each query is a node of the graph. Its candidates start as its own and
sampled reverse neighbours; in rounds, the unexpanded ones among the ``beam`` nearest
are joined with their lists, until none is left: the beam's worst distance only falls,
so what has left it stays out and the rounds end by themselves. Distances of results are Euclidean, in
double precision on the original vectors.

Equal vectors are one node, named by the smallest id; results are expanded to the
smallest ids of each node, so a large group of copies costs nothing.

Defined results: vectors that are null, zero, hold null, NaN or infinite components, or
differ in length from most others take no part; null ids neither; of rows repeating an
id the smallest vector counts; with fewer candidates than asked for all reachable
ones are returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motorlytics.llm.common import BROADCAST_BYTES, broadcast_if_small, hash128, shuffle_partitions, stored

K = 24
#: Rounds end when at most this share of the list entries is new, or after ROUNDS.
CHANGED = 0.01
ROUNDS = 30
BEAM = 160
#: Rows of a hyperplane block and of a random group; a block is cut between BLOCK and 2 BLOCK rows.
BLOCK, GROUP = 256, 64
#: Entries of a first list out of each of the two blocks and the random group: K in all.
FIRST = (9, 9, 6)
#: Rows of one hyperplane code that go to one task.
CODE_ROWS = 1 << 16
#: Vectors looked at to place the hyperplanes of the first blocks.
PLANE_SAMPLE = 2000
#: Rows of a block that are compared with the whole block at once; pairs compared by differences at once.
SLAB, PAIRS = 512, 1 << 15
EDGE = "u long, v long, d double"


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, vec`` (array of double) of rows that take part."""
    vec = F.col(vector_col).cast("array<double>")
    rows = table.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where("vec is not null")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.coalesce(finite, F.lit(False)) & F.exists("vec", lambda x: x != 0))
    rows = rows.groupBy("id").agg(F.min("vec").alias("vec"))
    size = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).select("dim")
    return rows.join(F.broadcast(size), F.size("vec") == F.col("dim"), "left_semi")


def _matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1) if len(column) else np.empty((0, 0), dtype)


def keep_nearest(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest distinct ``v`` of each ``u``, with their rank ``r``; an entry known before is not
    fresh. ``worst`` is the distance that a new entry has to beat (a list not full yet takes anything)."""
    dealt = edges.repartition(shuffle_partitions(edges.sparkSession), "u")
    one = dealt.groupBy("u", "v").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy("d", "v"))
    kept, whole = one.withColumn("r", rank).where(F.col("r") <= k), Window.partitionBy("u")
    return kept.withColumn("worst", F.when(F.count("*").over(whole) >= k, F.max("d").over(whole)).otherwise(F.lit(float("inf"))))


def _between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``a`` and ``b``, by their differences."""
    with np.errstate(over="ignore", under="ignore"):
        gap = np.abs(a - b)
        square = (gap * gap).sum(1)
        out = np.sqrt(square)
        # scaled where squares overflow or vanish
        odd = np.flatnonzero(~((square > 1e-200) & (square < 1e300)) & gap.any(1))
        most = gap[odd].max(1, initial=0)
        odd, most = odd[np.isfinite(most)], most[np.isfinite(most)]
        out[odd] = most * np.sqrt(((gap[odd] / most[:, None]) ** 2).sum(1))
    return out


def _pairwise(x: np.ndarray, norm: np.ndarray, low: int, high: int) -> np.ndarray:
    """Distances of the rows ``low`` to ``high`` from all rows of ``x`` (itself: infinite)."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        both = norm[low:high, None] + norm[None]
        square = both - 2 * x[low:high] @ x.T
        sure = (square > 1e-8 * both) & (square > 1e-200) & (square < 1e300)
        d = np.sqrt(np.maximum(square, 0))
    own = np.arange(low, high)
    sure[own - low, own] = True
    i, j = np.nonzero(~sure)
    for at in range(0, len(i), PAIRS):
        some, others = i[at:at + PAIRS], j[at:at + PAIRS]
        d[some, others] = _between(x[low + some], x[others])
    d[own - low, own] = np.inf
    return d


def _norms(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", under="ignore"):
        return (x * x).sum(1)


def _block_edges(table: pa.Table, kind: str) -> pa.RecordBatch | None:
    """The first entries of a block's rows ``(v, raw, turn)``, all of one turn."""
    ids, x = table["v"].to_numpy(), np.frombuffer(b"".join(table["raw"].to_pylist()), kind).astype(np.float64).reshape(table.num_rows, -1)
    m = min(FIRST[table["turn"][0].as_py()], len(ids) - 1)
    if m <= 0:
        return None
    norm, parts = _norms(x), []
    for low in range(0, len(ids), SLAB):
        d = _pairwise(x, norm, low, min(low + SLAB, len(ids)))
        near = np.argpartition(d, m - 1, axis=1)[:, :m]
        parts.append((np.repeat(ids[low:low + SLAB], m), ids[near].ravel(), np.take_along_axis(d, near, 1).ravel()))
    u, v, d = (np.concatenate(c) for c in zip(*parts, strict=True))
    other = u != v
    return pa.RecordBatch.from_arrays([pa.array(u[other]), pa.array(v[other]), pa.array(d[other])], names=["u", "v", "d"])


def _cut_blocks(kind: str):
    """Sorted rows (v, raw, turn, code, part) -> edges inside blocks; at most two blocks and a batch are held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(held: pa.Table, last: bool) -> Iterator[pa.RecordBatch | None]:
            keys = [held[c].to_numpy() for c in ("turn", "code", "part")]
            ends = np.flatnonzero(np.concatenate((np.any([k[1:] != k[:-1] for k in keys], axis=0), [True]))) + 1
            at = 0
            for end in ends:
                while end - at >= 2 * BLOCK:
                    yield _block_edges(held.slice(at, BLOCK), kind)
                    at += BLOCK
                if end < held.num_rows or last:  # the last run may go on
                    yield _block_edges(held.slice(at, end - at), kind)
                    at = int(end)
            rest.append(held.slice(at))

        held, rest = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            yield from (b for b in made(held, False) if b is not None)
            held = rest.pop()
        if held is not None and held.num_rows:
            yield from (b for b in made(held, True) if b is not None)
    return run


def first_edges(raws: DataFrame, n: int, seed: int, kind: str) -> DataFrame:
    """Coarse lists of ``raws(v, raw)``: neighbours inside two hyperplane blocks and a random group."""
    sample = raws.orderBy(F.xxhash64(F.lit(seed), "v")).limit(PLANE_SAMPLE).toPandas()
    x = np.frombuffer(b"".join(sample["raw"]), kind).astype(np.float64).reshape(len(sample), -1)
    bits, groups = max(0, int(np.ceil(np.log2(max(1, n) / BLOCK)))), -(-n // GROUP)
    rng, weights = np.random.default_rng(seed), 1 << np.arange(bits, dtype=np.int64)
    sides, crowded = [], []
    for _ in FIRST[:2]:
        planes = rng.standard_normal((x.shape[1], bits))
        with np.errstate(over="ignore", invalid="ignore"):
            middle = np.nanmedian(x @ planes, axis=0) if bits else np.zeros(0)
            codes, seen = np.unique((x @ planes > middle) @ weights, return_counts=True)
        # a code that the sample shows to hold many rows is dealt into several tasks
        crowded.append({int(c): int(p) for c, s in zip(codes, seen, strict=True) if (p := -(-int(s) * n // (len(x) * CODE_ROWS))) > 1})
        sides.append((planes, middle))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raw = batch.column(0).to_numpy(), batch.column(1)
            if not len(ids):
                continue
            rows = np.frombuffer(b"".join(raw.to_pylist()), kind).astype(np.float64).reshape(len(ids), -1)
            drawn = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
            for turn, (planes, middle) in enumerate(sides):
                with np.errstate(over="ignore", invalid="ignore"):
                    code = ((rows @ planes > middle) @ weights).astype(np.int64)
                parts = np.array([crowded[turn].get(c, 1) for c in code.tolist()], np.uint64)
                part = (drawn % parts).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), raw, pa.array(np.full(len(ids), turn, np.int32)), pa.array(code), pa.array(part)], names=names)
            group = (drawn % np.uint64(groups)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), raw, pa.array(np.full(len(ids), len(sides), np.int32)), pa.array(group), pa.array(np.zeros(len(ids), np.int64))], names=names)

    names = ["v", "raw", "turn", "code", "part"]
    dealt = raws.mapInArrow(coded, "v long, raw binary, turn int, code long, part long")
    dealt = dealt.repartition(shuffle_partitions(raws.sparkSession), "turn", "code", "part").sortWithinPartitions("turn", "code", "part", "v")
    return dealt.mapInArrow(_cut_blocks(kind), EDGE).withColumn("fresh", F.lit(True))


def packed(nodes: DataFrame, kind: str) -> DataFrame:
    """``v, raw``: the bytes of the vectors as numbers of ``kind``, that of the table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in x], pa.binary())], names=["v", "raw"])

    return nodes.select("id", "vec").mapInArrow(run, "v long, raw binary")


def _whole(df: DataFrame, small: bool) -> DataFrame:
    """``df``, a row for each node, as a broadcast side if its bytes were found ``small``."""
    return F.broadcast(df) if small else df


def _sampled_reverse(graph: DataFrame, k: int, seed: int, small: bool) -> DataFrame:
    """Edges turned round, about ``k`` for a node that many list."""
    listed = _whole(graph.groupBy("v").agg(F.count("*").alias("n")), small)
    draw = F.pmod(F.xxhash64(F.lit(seed), "u", "v"), F.lit(1 << 20)) * F.col("n") < k * (1 << 20)
    return graph.join(listed, "v").where(draw).select(F.col("v").alias("u"), F.col("u").alias("v"), "fresh")


def _introduce(per_node: int, kind: str):
    """Sorted rows (u, v, fresh, raw, worst) -> (u, v, d): nodes met at some u that improve a list."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def meet(table: pa.Table) -> pa.RecordBatch | None:
            u, v, fresh = (table[c].to_numpy() for c in ("u", "v", "fresh"))
            worst = table["worst"].to_numpy()
            x = np.frombuffer(b"".join(table["raw"].to_pylist()), kind).astype(np.float64).reshape(len(u), -1)
            norm = _norms(x)
            cuts = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1], [True])))
            got = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a < 2 or not fresh[a:b].any():
                    continue
                d = _pairwise(x[a:b], norm[a:b], 0, b - a)
                useful = (fresh[a:b, None] | fresh[None, a:b]) & (d < worst[a:b, None]) & (v[a:b, None] != v[None, a:b])
                d = np.where(useful, d, np.inf)
                m = min(per_node, b - a - 1)
                near = np.argpartition(d, m - 1, axis=1)[:, :m]
                at = np.take_along_axis(d, near, 1)
                i, j = np.nonzero(np.isfinite(at))
                got.append((v[a:b][i], v[a:b][near[i, j]], at[i, j]))
            if not got:
                return None
            who, whom, dist = (np.concatenate([g[c] for g in got]) for c in range(3))
            if not len(who):
                return None
            # combined before the shuffle: the same pair is met at several nodes
            order = np.lexsort((dist, whom, who))
            who, whom, dist = who[order], whom[order], dist[order]
            first = np.concatenate(([True], (who[1:] != who[:-1]) | (whom[1:] != whom[:-1])))
            return pa.RecordBatch.from_arrays([pa.array(who[first]), pa.array(whom[first]), pa.array(dist[first])], names=["u", "v", "d"])

        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            u = held["u"].to_numpy()
            if not len(u):
                continue
            end = int(np.searchsorted(u, u[-1]))  # the last node may go on in the next batch
            if end:
                made = meet(held.slice(0, end))
                held = held.slice(end)
                if made is not None:
                    yield made
        if held is not None and held.num_rows and (made := meet(held)) is not None:
            yield made
    return run


def descend(graph: DataFrame, raws: DataFrame, k: int, seed: int, kind: str, small: bool) -> DataFrame:
    """One round: lists improved by neighbours of neighbours."""
    parts = shuffle_partitions(graph.sparkSession)
    lists = graph.select("u", "v", "fresh").unionByName(_sampled_reverse(graph, k, seed, small)).repartition(parts, "u").groupBy("u", "v").agg(F.max("fresh").alias("fresh"))
    # where none is fresh, nobody is introduced
    lists = lists.withColumn("any", F.max("fresh").over(Window.partitionBy("u"))).where("any").drop("any")
    worst = graph.where("r = 1").select(F.col("u").alias("v"), "worst")
    known = _whole(raws.join(_whole(worst, small), "v"), small)
    met = lists.join(known, "v").select("u", "v", "fresh", "raw", "worst")
    if not small:  # a broadcast leaves the rows dealt by u
        met = met.repartition(parts, "u")
    told = met.sortWithinPartitions("u").mapInArrow(_introduce(k // 2, kind), EDGE).withColumn("fresh", F.lit(True))
    old = graph.select("u", "v", "d", F.lit(False).alias("fresh"))
    return keep_nearest(old.unionByName(told), k)


def build_graph(raws: DataFrame, n: int, small: bool, k: int = K, rounds: int = ROUNDS, seed: int = 5, kind: str = "<f8") -> DataFrame:
    """``u, v, d, fresh, r, worst`` over ``raws(v, raw)``, stored after each round."""
    graph = stored(keep_nearest(first_edges(raws, n, seed, kind), k), "nn-graph")
    for turn in range(rounds):
        graph = stored(descend(graph, raws, k, seed + turn, kind, small), "nn-graph")
        if graph.where("fresh").count() <= CHANGED * k * n:
            break
    return graph


def _distances(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), kind).astype(np.float64).reshape(batch.num_rows, -1) for i in (3, 4))
            d = _between(a, b) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(d, pa.float64())], names=["q", "c", "expanded", "d"])
    return run


def greedy_search(graph: DataFrame, raws: DataFrame, queries: DataFrame, small: bool, k: int = K, beam: int = BEAM, kind: str = "<f8", row_bytes: int = 1024) -> DataFrame:
    """``q, c, d``: the ``beam`` nearest nodes found for each query node ``queries(q)``, with
    the distance; the query itself is not among them. What a query keeps between
    rounds is its beam; a node that has left it may be measured again, not expanded."""
    asked = raws.select(F.col("v").alias("q"), F.col("raw").alias("q_raw")).join(queries, "q")
    asked = broadcast_if_small(stored(asked, "nn-queries"), row_bytes)
    vectors = _whole(raws.select(F.col("v").alias("c"), F.col("raw").alias("c_raw")), small)
    lists = stored(graph.select("u", "v").unionByName(_sampled_reverse(graph, k, 99, small).select("u", "v")).distinct(), "nn-lists")
    lists = broadcast_if_small(lists.select(F.col("u").alias("c"), "v"), 16)
    parts = shuffle_partitions(graph.sparkSession)
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "c"))

    def beamed(found: DataFrame) -> DataFrame:
        """The nearest of ``found(q, c, expanded)``, a candidate found again counting once."""
        one = found.where("q <> c").repartition(parts, "q").groupBy("q", "c").agg(F.max("expanded").alias("expanded"))
        near = one.join(vectors, "c").join(asked, "q").select("q", "c", "expanded", "q_raw", "c_raw").mapInArrow(_distances(kind), "q long, c long, expanded boolean, d double")
        return stored(near.withColumn("r", rank).where(F.col("r") <= beam).drop("r"), "nn-beam")

    def listed(front: DataFrame) -> DataFrame:
        return front.join(lists, "c").select("q", F.col("v").alias("c"), F.lit(False).alias("expanded"))

    seen = beamed(listed(queries.select("q", F.col("q").alias("c"))))
    while not (front := seen.where("not expanded").select("q", "c")).isEmpty():
        seen = beamed(seen.select("q", "c", F.lit(True).alias("expanded")).unionByName(listed(front)))
    return seen.select("q", "c", "d")


def nearest(table: DataFrame, query_ids, id_col: str = "vec_id", vector_col: str = "embedding", top: int = 10,
            k: int = K, rounds: int = ROUNDS, beam: int = BEAM) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``top`` nearest found for each row of ``table``
    whose id fulfils ``query_ids`` (a function of the id column), itself excepted."""
    rows = valid_vectors(table, id_col, vector_col)
    h1, h2 = hash128(F.col("vec"))
    rows = stored(rows.withColumns({"h1": h1, "h2": h2}), "nn-vectors")
    names = broadcast_if_small(stored(rows.groupBy("h1", "h2").agg(F.min("id").alias("node")), "nn-names"), 32)
    members = stored(rows.join(names, ["h1", "h2"]).select("id", "node"), "nn-members")
    nodes = stored(rows.join(names, (rows["h1"] == names["h1"]) & (rows["h2"] == names["h2"]) & (rows["id"] == names["node"]), "left_semi").select("id", "vec"), "nn-nodes")
    n = nodes.count()
    spark = table.sparkSession
    asked = members.where(query_ids(F.col("id")))
    if n == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kind = "<f4" if dict(table.dtypes)[vector_col] == "array<float>" else "<f8"
    raws = stored(packed(nodes, kind), "nn-raws")
    row_bytes = 32 + raws.select(F.octet_length("raw")).first()[0]
    small = n * row_bytes <= BROADCAST_BYTES
    graph = build_graph(raws, n, small, k, rounds, kind=kind)
    queries = stored(asked.select(F.col("node").alias("q")).distinct(), "nn-asked")
    seen = greedy_search(graph, raws, queries, small, k, beam, kind, row_bytes)

    # the nearest nodes of each query node, with itself at distance 0 for its copies
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "c"))
    best = seen.withColumn("r", rank).where(F.col("r") <= top).select("q", "c", "d")
    best = best.unionByName(asked.select(F.col("node").alias("q"), F.col("node").alias("c"), F.lit(0.0).alias("d")).distinct())
    # the smallest ids of each node, a large group being cut down part by part first
    part = members.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(32)))
    part = part.withColumn("r", F.row_number().over(Window.partitionBy("node", "part").orderBy("id"))).where(F.col("r") <= top + 1)
    few = part.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("r") <= top + 1).select(F.col("node").alias("c"), F.col("id").alias("vec_id"))
    found = best.join(few, "c").join(asked.select(F.col("id").alias("query_id"), F.col("node").alias("q")), "q").where("vec_id <> query_id")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("d", "vec_id"))).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", F.col("d").alias("score"))
