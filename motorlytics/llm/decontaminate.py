"""Benchmark decontamination by SimHash of item-sized windows.

A window of a document that is as similar to an item as asked has at least so many
shingles of the items of its length (sum of minima <= their number; sum of minima over
sum of maxima >= threshold). Every start whose window has that many is taken, wherever
the shingles stand in the item. Windows and items
get 64-bit SimHash fingerprints of their weighted shingles (weight: how often it
occurs). A multi-index finds every pair of fingerprints within ``RADIUS``: of eight
8-bit blocks at least one differs in at most two bits, so each item is listed under all
block values within two bits of its own, and a window looks up its eight values. The
candidates' exact weighted-shingle similarity, sum of minima over sum of maxima, decides.

At similarity 0.8 fingerprints differ in about 10 of 64 bits (standard deviation 3), so
a radius of 23 loses none that matters. Only built-in functions are used. The shingles
of the benchmark are broadcast only if counted to be small, else joined by a shuffle.

Words are runs of letters and digits, lower-cased. Defined results: null, empty or
wordless texts on either side match nothing; an item of fewer than five words is one
shingle of all its words; a document shorter than an item is one window; rows with the
same doc_id and text give their matches once, other rows are judged one by one, also
those with a null doc_id; repeated item ids are judged text by text, best one reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorlytics.llm.common import broadcast_if_small, stored, text_of

SIZE = 5
SIMILARITY = 0.8
BLOCKS = 8
BLOCK_BITS = 8
#: Bits by which a block may differ; fingerprints within RADIUS share such a block.
BLOCK_RADIUS = 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def grams(hashes: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, given the hashes of the words."""
    n = F.size(hashes) - F.lit(size - 1)
    return F.when(n >= 1, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*(hashes[i + k] for k in range(size))))).otherwise(
        F.array().cast("array<bigint>"))


def word_hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def simhash(shingles: Column) -> Column:
    """Bit k is set if more than half of the shingles, counted as often as they occur, have it."""
    def bit(k: int) -> Column:
        ones = F.aggregate(shingles, F.lit(0), lambda a, h: a + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(1)).cast("int"))
        return F.when(2 * ones > F.size(shingles), F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))

    out = bit(0)
    for k in range(1, 64):
        out = out.bitwiseOR(bit(k))
    return out


def block(fingerprint: Column, k: int) -> Column:
    return F.shiftrightunsigned(fingerprint, BLOCK_BITS * k).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two shingle lists."""
    def times(xs: Column, h: Column) -> Column:
        return F.size(F.filter(xs, lambda x: x == h))

    least = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, h: s + F.least(times(a, h), times(b, h)))
    return least / (F.size(a) + F.size(b) - least)


def row_key(doc_id: Column, text: Column) -> dict[str, Column]:
    """Two hashes that name a document row by its id and text."""
    return {"k1": F.xxhash64(doc_id, text), "k2": F.xxhash64(F.lit(3), doc_id, text)}


def item_table(benchmark: DataFrame) -> DataFrame:
    """``item_id, size, n_words, item_shingles``: one row per distinct item with words."""
    items = benchmark.select("item_id", word_hashes(text_of()).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(SIZE))
    shingles = F.lit(None).cast("array<bigint>")
    for k in range(1, SIZE + 1):
        shingles = F.when(size == k, grams(F.col("w"), k)).otherwise(shingles)
    return items.select("item_id", size.alias("size"), F.size("w").alias("n_words"), shingles.alias("item_shingles")).distinct()


def window_starts(docs: DataFrame, items: DataFrame, size: int, threshold: float) -> DataFrame:
    """``k1, k2, n_words, start``: every window (from word ``start``) with as many shingles of
    the items of ``n_words`` words as a similarity of ``threshold`` to one of them needs."""
    shared = items.select("n_words", F.explode("item_shingles").alias("h")).distinct()
    shared = broadcast_if_small(stored(shared, "item-shingles"), 12)
    found = docs.select("k1", "k2", word_hashes(F.col("text")).alias("w")).where(F.size("w") >= size)
    found = found.select("k1", "k2", F.size("w").alias("n"), F.posexplode(grams(F.col("w"), size)).alias("i", "h")).join(shared, "h")
    # places of shared shingles, bounded by one document
    at = found.groupBy("k1", "k2", "n", "n_words").agg(F.array_sort(F.collect_set("i")).alias("at"))
    full, whole = F.col("n_words") - (size - 1), F.col("n") - (size - 1)
    at = at.withColumns({"full": full, "span": F.least(full, whole), "last": F.greatest(F.lit(0), F.col("n") - F.col("n_words"))})
    need = F.ceil((F.col("span") + F.col("full")) * F.lit(threshold / (1 + threshold)) - 1e-6)
    at = at.withColumn("need", F.greatest(F.lit(1), need).cast("int")).where(F.size("at") >= F.col("need"))
    # starts whose window has the shared places j to j + need - 1
    at = at.withColumn("j", F.explode(F.sequence(F.lit(0), F.size("at") - F.col("need"))))
    low = F.greatest(F.lit(0), F.get("at", F.col("j") + F.col("need") - 1) - F.col("span") + 1)
    high = F.least(F.get("at", F.col("j")), F.col("last"))
    at = at.select("k1", "k2", "n_words", low.alias("low"), high.alias("high")).where("low <= high")
    return at.select("k1", "k2", "n_words", F.explode(F.sequence("low", "high")).alias("start")).distinct()


def window_fingerprints(docs: DataFrame, spots: DataFrame, size: int) -> DataFrame:
    """The shingles and the fingerprint of each window of ``spots``."""
    keys = stored(spots.select("k1", "k2").distinct(), "leak-keys")
    near = docs.join(broadcast_if_small(keys, 16), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    # the word hashes are a column of their own, else every n-gram would compute them again
    near = near.select("k1", "k2", "doc_id", word_hashes(F.col("text")).alias("w")).select("k1", "k2", "doc_id", grams(F.col("w"), size).alias("g"))
    cut = near.join(spots, ["k1", "k2"]).select(
        "k1", "k2", "doc_id", "n_words", "start", F.slice("g", F.col("start") + 1, F.col("n_words") - (size - 1)).alias("shingles"))
    return cut.withColumn("print", simhash(F.col("shingles")))


def item_index(items: DataFrame) -> DataFrame:
    """Items under every (block, value) within BLOCK_RADIUS bits of their own."""
    flips = F.filter(F.sequence(F.lit(0), F.lit((1 << BLOCK_BITS) - 1)), lambda x: F.bit_count(x) <= BLOCK_RADIUS)
    made = items.withColumn("item_print", simhash(F.col("item_shingles")))
    listed = made.withColumn("b", F.explode(F.array(*(F.struct(F.lit(k).alias("block"), block(F.col("item_print"), k).alias("own")) for k in range(BLOCKS)))))
    return listed.select("item_id", "n_words", "item_shingles", "item_print", F.col("b.block").alias("block"),
                         F.explode(F.transform(flips, lambda x: F.col("b.own").bitwiseXOR(x))).alias("value"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One row per document and item found in it: ``doc_id, item_id, start_word, n_words,
    similarity`` of its most similar window, the first one of equals."""
    docs = docs.select("doc_id", text_of().alias("text"))
    docs = docs.withColumns(row_key(F.col("doc_id"), F.col("text")))
    items = stored(item_table(benchmark.select("item_id", F.col("text").cast("string").alias("text"))), "benchmark-items")
    found = None
    for size in sorted(r["size"] for r in items.select("size").distinct().collect()):  # at most SIZE values
        some = items.where(F.col("size") == size)
        spots = stored(window_starts(docs, some, size, threshold), "leak-spots")
        windows = stored(window_fingerprints(docs, spots, size), "leak-windows")
        looks = windows.select("k1", "k2", "n_words", "start", "print", F.explode(
            F.array(*(F.struct(F.lit(k).alias("block"), block(F.col("print"), k).alias("value")) for k in range(BLOCKS)))).alias("b"))
        looks = looks.select("k1", "k2", "n_words", "start", "print", "b.block", "b.value")
        index = item_index(some).select("item_id", "n_words", "item_print", "block", "value", F.xxhash64("item_shingles").alias("item_key"))
        pairs = looks.join(index, ["n_words", "block", "value"])
        pairs = pairs.where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
        pairs = pairs.select("k1", "k2", "n_words", "start", "item_id", "item_key").distinct()
        texts = some.select(F.col("item_id").alias("of_item"), F.col("n_words").alias("of_words"),
                            F.xxhash64("item_shingles").alias("of_key"), "item_shingles")
        exact = pairs.join(windows.drop("print"), ["k1", "k2", "n_words", "start"])
        exact = exact.join(texts, F.col("item_id").eqNullSafe(F.col("of_item")) & (F.col("item_key") == F.col("of_key")) & (F.col("n_words") == F.col("of_words")))
        exact = exact.select("k1", "k2", "doc_id", "item_id", "start", "n_words", similarity(F.col("shingles"), F.col("item_shingles")).alias("similarity"))
        exact = exact.where(F.col("similarity") >= threshold)
        found = exact if found is None else found.unionByName(exact)
    if found is None:
        found = docs.limit(0).crossJoin(benchmark.select("item_id").limit(0)).select(
            "k1", "k2", "doc_id", "item_id", F.lit(0).alias("start"), F.lit(0).alias("n_words"), F.lit(0.0).alias("similarity"))
    best = found.groupBy("k1", "k2", "doc_id", "item_id").agg(
        F.max(F.struct("similarity", (-F.col("start")).alias("from"), "n_words")).alias("best"))
    return best.select("doc_id", "item_id", (-F.col("best.from")).cast("long").alias("start_word"), F.col("best.n_words").cast("long").alias("n_words"),
                       F.col("best.similarity").alias("similarity"), "k1", "k2")
