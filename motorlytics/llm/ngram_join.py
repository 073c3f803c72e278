"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Documents with equal shingle sets are one class, a row of the incidence matrix. Its
columns are put in one global order, frequent n-grams last (a fixed-size bitmap tells
them, found by pre-aggregated counts). Two rows whose Jaccard similarity reaches t
share at least m columns within their first n - ceil(t n) + m ones (or all they need to
share, if less), so the product runs over that block of columns first: rows meet per
column, a meeting is discarded by the bounds that the sizes and positions put on the
overlap, and a pair by its accumulated overlap in the block. Pairs that survive get
their exact overlap from the whole rows.

Only components are asked for, so a column with many rows is not multiplied out at
once. In the first rounds each column links its rows to one of them (a minimum, hence
pre-aggregated, frequent columns being dealt into salted parts first). Verified links
merge rows into components; columns whose rows are all in one component are done. The
last round multiplies what is left, the smaller row's first columns with the larger
row's longer block. Rows meet there only if their parity signatures allow the similarity:
each n-gram flips one of ``SIGN_BITS`` bits, so two rows differ in at least as many n-grams
as their signatures in bits. So no link is lost, and near copies of one text that are not
near copies of each other are told apart before they are paired.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; fewer than
``size`` words make one shingle of the whole sequence; null, empty or blank text has
the empty set, links with nothing and is its own component. Rows repeating a doc_id are
judged on their own text. A null doc_id joins by text but has no component of its own:
it gets the smallest id of its group, or null.
Shingles are 64-bit hashes, a class is named by a 64-bit hash of its set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorlytics.llm.common import broadcast_if_small, stored
from motorlytics.llm.components import components

SIZE = 5
#: Similarity of at least PERCENT / 100.
PERCENT = 80
#: Columns of the first block that similar rows share at least.
BLOCK_OVERLAP = 8
#: Bits of the bitmap that marks frequent n-grams; a fixed size, whatever the corpus.
BITMAP_BITS = 1 << 26
#: An n-gram met in BLOCK_DOCS documents of a task's block is counted, and is frequent from
#: FREQUENT on. Chance meetings of common word runs thus move behind the first block.
BLOCK_SHINGLES = 1 << 22
BLOCK_DOCS = 2
FREQUENT = 4
#: Parts that a frequent column is dealt into for the first rounds.
SALTS = 16
#: Rounds that link the rows of a column to one of them, before the last.
STAR_ROUNDS = 2
#: Bits of a row's parity signature, in 64-bit words.
SIGN_BITS = 512

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct 64-bit hashes (as int64) of the text's shingles."""
    words = (text or "").encode().lower().split()  # on bytes: ASCII letters and ASCII white space only
    if not words:
        return np.empty(0, np.int64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64).view(np.int64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - size + 1
    made = np.zeros(n, np.uint64)
    for i in range(size):
        made = _mix(made ^ hashed[i:i + n]) + _ODD[i % len(_ODD)]
    return np.unique(made.view(np.int64))


def _class(found: np.ndarray) -> int | None:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())))) if len(found) else None


def signature(found: np.ndarray) -> np.ndarray:
    """Parity, bit by bit, of how many n-grams fall on each of ``SIGN_BITS`` cells."""
    cell = found.view(np.uint64) >> np.uint64(64 - (SIGN_BITS - 1).bit_length())
    odd = np.bincount(cell.astype(np.int64), minlength=SIGN_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def classes_and_counts(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Two kinds of rows: ``(doc_id, n, node, sign)`` per document row, and
    ``(shingle, docs)`` for n-grams met often within a block of a task."""
    schema = "doc_id long, n int, node long, sign array<long>, shingle long, docs long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = [], 0

        def counted() -> pa.RecordBatch:
            values, times = np.unique(np.concatenate(block), return_counts=True)
            often = times >= BLOCK_DOCS
            none = pa.nulls(int(often.sum()))
            return pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.list_(pa.int64())),
                                               pa.array(values[often]), pa.array(times[often].astype(np.int64))], names=names)

        names = ["doc_id", "n", "node", "sign", "shingle", "docs"]
        for batch in batches:
            n, node, sign = [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py(), size)
                n.append(len(found))
                node.append(_class(found))
                sign.append(signature(found) if len(found) else None)
                block.append(found)
                held += len(found)
                if held >= BLOCK_SHINGLES:
                    yield counted()
                    block, held = [], 0
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(node, pa.int64()),
                                               pa.array(sign, pa.list_(pa.int64())), none, none], names=names)
        if block:
            yield counted()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def frequent_bitmap(counts: DataFrame) -> np.ndarray:
    """Bitmap, as 64-bit words, of ``BITMAP_BITS`` cells that hold a frequent n-gram. What
    comes to the driver is at most those words (8 MB), whatever the corpus."""
    often = counts.groupBy("shingle").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= FREQUENT)
    cell = F.pmod(F.col("shingle"), F.lit(BITMAP_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(cell, F.lit(64)).cast("int"))
    words = often.select((cell / 64).cast("int").alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros(BITMAP_BITS // 64, np.int64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy()
    return bitmap


def prefixes(docs: DataFrame, bitmap: np.ndarray, percent: int = PERCENT, size: int = SIZE) -> DataFrame:
    """``(doc_id, node, n, rare, prefix)``: the first ones of each non-empty row in the
    global order; the first ``rare`` of them are not frequent."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = shingles(text.as_py(), size)
                n = len(found)
                if not n:
                    continue
                cell = np.mod(found, BITMAP_BITS)
                late = (words[cell >> 6] >> (cell & 63)) & 1 == 1
                keep = n - -(-percent * n // 100) + BLOCK_OVERLAP
                rare = found[~late][:keep]
                rows.append((doc_id, _class(found), n, len(rare), np.concatenate([rare, found[late][:keep - len(rare)]])))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "node", "n", "rare", "prefix"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, node long, n int, rare int, prefix array<long>")


def whole_rows(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``(node, n, ones)``: the whole row of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), size) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([_class(f) for f in found], pa.int64()), pa.array([len(f) for f in found], pa.int32()),
                                              pa.array(found, pa.list_(pa.int64()))], names=["node", "n", "ones"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "node long, n int, ones array<long>")


def _possible(n1: Column, at1: Column, n2: Column, at2: Column, percent: int) -> Column:
    """Whether two rows meeting for the first time at these positions (from 0) can still
    reach the similarity: 100 o >= percent (n1 + n2 - o), with o at most one more than
    what follows in either row."""
    most = F.least(n1 - at1, n2 - at2).cast("long")
    return ((100 + percent) * most >= percent * (n1 + n2)) & (100 * F.least(n1, n2).cast("long") >= percent * F.greatest(n1, n2))


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def _early(percent: int) -> Column:
    """Whether the smaller of two similar rows may meet the other first at this column."""
    n = F.col("n").cast("long")
    return (100 + percent) * (n - F.col("at")) >= 2 * percent * n


def _pivot(seed: int) -> Column:
    """Of the first round one order of rows for all columns, of later ones one for each column."""
    order = F.xxhash64(F.lit(seed), "shingle", "node") if seed else F.xxhash64(F.lit(seed), "node")
    return F.struct(order.alias("o"), "node", "n", "at", "component")


def star_pairs(columns: DataFrame, by: list[str], seed: int, percent: int) -> DataFrame:
    """Each column's rows with one of them, the one whose seeded hash is smallest, unless
    they are in one component already. With an order for each column the copies of a text,
    which share many columns, are tried against many of them."""
    pivot = columns.where(_early(percent)).groupBy(*by).agg(F.min(_pivot(seed)).alias("p"))
    met = columns.join(pivot, by).where(F.col("component") != F.col("p.component"))
    met = met.where(_possible(F.col("n"), F.col("at"), F.col("p.n"), F.col("p.at"), percent))
    return met.select(F.col("node").alias("a"), F.col("p.node").alias("b"))


def near_signs(percent: int) -> Column:
    """Whether rows of ``n1`` and ``n2`` n-grams may differ in as many as their signatures
    ``sign1`` and ``sign2`` differ in bits: (100 + p) d <= (100 - p) (n1 + n2)."""
    words = [F.bit_count(F.col("sign1")[i].bitwiseXOR(F.col("sign2")[i])) for i in range(SIGN_BITS // 64)]
    return (100 + percent) * sum(words[1:], words[0]) <= (100 - percent) * (F.col("n1") + F.col("n2")).cast("long")


def all_pairs(columns: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """Every two rows of different components that share a column and can be similar.
    Rows that meet first at a column share it within the smaller one's first
    n - (2 p n / (100 + p)) columns and the larger one's first n - p n / 100. ``signs(node, sign)``
    holds the signature of each row."""
    columns = columns.join(signs, "node")
    some = ("node", "n", "at", "component", "sign")
    left = columns.where(_early(percent)).select("shingle", *(F.col(c).alias(c + "1") for c in some))
    right = columns.where(100 * (F.col("n") - F.col("at")).cast("long") >= percent * F.col("n")).select("shingle", *(F.col(c).alias(c + "2") for c in some))
    met = left.join(right, "shingle").where("component1 <> component2 and (n1 < n2 or n1 = n2 and node1 < node2)")
    met = met.where(_possible(F.col("n1"), F.col("at1"), F.col("n2"), F.col("at2"), percent) & near_signs(percent))
    return met.select(F.col("node1").alias("a"), F.col("node2").alias("b"))


def enough_in_block(pairs: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """``pairs(a, b)`` that share enough columns of the first block. ``blocks(node, n,
    shingles)`` holds those columns of a row that another row has too."""
    a = blocks.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("xa"))
    b = blocks.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("xb"))
    needed = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent))
    shared = F.size(F.array_intersect("xa", "xb"))
    return pairs.join(a, "a").join(b, "b").where(shared >= F.least(F.lit(BLOCK_OVERLAP), needed)).select("a", "b")


def rows_of(docs: DataFrame, firsts: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """The whole rows of the classes in ``pairs``, each read from its first document.
    (Repeated rows of an id may give a class twice; links are made distinct later.)"""
    nodes = stored(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "ngram-nodes")
    ids = broadcast_if_small(stored(firsts.join(nodes, "node").select("doc_id").distinct(), "ngram-firsts"), 8)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
    return stored(whole_rows(keyed, size).where("node is not null").join(nodes, "node", "left_semi"), "ngram-rows")


def verified(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """``pairs(a, b)`` whose whole rows reach the similarity exactly."""
    a = rows.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("ones").alias("xa"))
    b = rows.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("ones").alias("xb"))
    both = pairs.join(a, "a").join(b, "b").withColumn("o", F.size(F.array_intersect("xa", "xb")).cast("long"))
    return both.where(100 * F.col("o") >= percent * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


def link_classes(docs: DataFrame, classes: DataFrame, counts: DataFrame, percent: int, size: int) -> DataFrame:
    """``(node, component)`` of the classes that link with another."""
    spark = docs.sparkSession
    firsts = classes.where("node is not null").groupBy("node").agg(F.min(F.coalesce("doc_id", F.lit(-1))).alias("doc_id"), F.count("*").alias("copies"))
    # a class is read from its first document; the others are left out of the product
    copies = classes.where("node is not null").select("node", F.coalesce("doc_id", F.lit(-1)).alias("doc_id")).join(
        firsts.where("copies > 1").select("node", F.col("doc_id").alias("first")), "node").where("doc_id <> first").select("node", "doc_id").distinct()
    copies = stored(copies, "ngram-copies")

    made = prefixes(docs, frequent_bitmap(counts), percent, size).withColumn("doc_id", F.coalesce("doc_id", F.lit(-1)))
    made = made.join(broadcast_if_small(copies, 24), ["node", "doc_id"], "left_anti")
    ones = made.select("node", "n", "rare", F.posexplode("prefix").alias("at", "shingle"))
    salt = F.when(F.col("at") < F.col("rare"), F.lit(0)).otherwise(F.pmod(F.xxhash64("node"), F.lit(SALTS))).cast("int")
    # columns with a single row multiply to nothing; parts of frequent ones are kept as they are
    part = Window.partitionBy("shingle", "salt")
    ones = ones.select("shingle", salt.alias("salt"), "node", "n", "at", (F.col("at") >= F.col("rare")).alias("often"))
    ones = ones.withColumns({"least": F.min("node").over(part), "most": F.max("node").over(part)})
    columns = stored(ones.where("often or least < most").select("shingle", "salt", "node", "n", "at"), "ngram-columns")

    # bounded by the first block of one document
    blocks = stored(columns.groupBy("node", "n").agg(F.collect_list("shingle").alias("shingles")), "ngram-blocks")

    links = spark.createDataFrame([], "a long, b long")
    joined, tested = columns.withColumn("component", F.col("node")), links
    for turn in range(STAR_ROUNDS + 1):
        if turn == STAR_ROUNDS:
            # one signature a class, and only of the classes still open
            signs = classes.join(joined.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.any_value("sign").alias("sign"))
            pairs = all_pairs(joined, signs, percent)
        else:
            pairs = star_pairs(joined, ["shingle", "salt"], turn, percent)
            if turn == 0:  # the parts of a frequent column meet through their pivots
                parts = joined.where(_early(percent)).groupBy("shingle", "salt").agg(F.min(_pivot(0)).alias("p")).select("shingle", "p.*")
                pairs = pairs.unionByName(star_pairs(parts, ["shingle"], 0, percent))
        pairs = _pairs(pairs).join(tested, ["a", "b"], "left_anti")
        pairs = stored(pairs, "ngram-pairs")
        likely = stored(enough_in_block(pairs, blocks, percent), "ngram-likely")
        found = stored(verified(likely, rows_of(docs, firsts, likely, size), percent), "ngram-links")
        links, tested = links.unionByName(found), tested.unionByName(pairs)
        if turn == 0 or not found.isEmpty():
            grouped = stored(components(links), "ngram-components")
        if turn < STAR_ROUNDS:
            named = columns.join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
            open_ = named.groupBy("shingle").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 < c2").select("shingle")
            joined = stored(named.join(open_, "shingle", "left_semi"), "ngram-open")
    return grouped


def ngram_components(docs: DataFrame, percent: int = PERCENT, size: int = SIZE) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> one row per document row: ``doc_id, n_shingles,
    component_id`` (smallest doc_id reachable by links)."""
    found = stored(classes_and_counts(docs, size), "ngram-classes")
    classes = found.where("shingle is null").select("doc_id", "n", "node", "sign")
    counts = found.where("shingle is not null").select("shingle", "docs")
    grouped = link_classes(docs, classes, counts, percent, size)

    of_class = classes.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    of_class = of_class.join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of_group = of_class.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stored(of_class.join(of_group, "component").select("node", "component_id"), "ngram-named")
    # no text: a component of its own; kept apart so that null classes are not one hot key
    alone = classes.where("node is null").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return classes.where("node is not null").join(named, "node").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id").unionByName(alone)
