"""Phrase collocations by vertical partitioning of the word suffixes.

Every word of a text starts a suffix, cut off after ``max_words`` words, at the end of its
piece, or before a word or pair of words too rare to be part of a phrase. Counts of
phrases are the counts of the nodes of the tree of these suffixes, which is built in
independent parts:

1. Rare words and pairs. Words are counted, then pairs of frequent words by the hashes of
   the two, each combined in the task before the shuffle. Tasks learn which are frequent
   from bitmaps of a fixed size, by hash; a collision or false hit keeps suffixes that
   could have gone, it never changes a count. Hashes that several words have, one of them
   frequent, are found from the word counts and marked in a bitmap too. The counts of all
   other pairs are exact: they are phrases of two words as they stand, so a suffix of two
   words is kept only if one of its words is marked.
2. Prefixes. The suffixes left, combined in the task and stored, are counted by first word;
   those of a word with more than ``budget`` of them by their first two words, of these
   again the too large ones by three, and so on; a bitmap marks the too large. A prefix
   marked by a false hit is only counted a level deeper than it need be.
3. Groups. The prefixes at which this ends are dealt into groups of at most twice the
   budget (their number is doubled until the exact loads keep to that).
4. Subtrees. Each group is one task's work: its suffixes are sorted by words; runs of equal
   first words are the nodes, their counts the sums of the leaves below. Only nodes of
   ``min_count`` or more leave the task. Nodes above the groups are the prefixes counted.

Scores are whole-number divisions of 38-digit decimals.

Defined results: a null text is empty, a null language ``und``; ids are not read, so
repeated rows count again; a slice of a long text ends at the end of a piece; an empty
table gives no rows; columns not named are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorlytics.llm.common import broadcast_if_small, stored

MAX_WORDS, MIN_COUNT, TOP = 5, 100, 2000
#: Suffixes that may start with one prefix of a group; about 300 bytes each in a task.
BUDGET = 1 << 17
BITS = 1 << 24
#: Bytes of text that are cut into words at once; a task holds some 40 times that.
SLICE = 4 << 20
NO_LANG = "und"

# fixed values: what ends a piece, what ends a word, A-Z to a-z; all other bytes are letters
PIECE_ENDS, WORD_ENDS, PIECE, SPACE = b".,;:!?\n\x0b\x0c\r", b" \t", 10, 32
_MAP = np.arange(256, dtype=np.uint8)
_MAP[65:91] += 32
_MAP[list(PIECE_ENDS)] = PIECE
_MAP[list(WORD_ENDS)] = SPACE


class Words(NamedTuple):
    """Words of a slice of texts: dictionary, place in it, language and piece of each."""
    dictionary: pa.Array
    code: np.ndarray
    lang: np.ndarray
    piece: np.ndarray
    langs: list[str]


def _bytes_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Mapped bytes of all texts, and where each begins (with the end)."""
    text = pc.fill_null(text.cast(pa.large_string()), "")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
    data = text.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def words_of(batch: pa.RecordBatch, slice_bytes: int = SLICE) -> Iterator[Words]:
    """The words of a batch of ``text, lang``, in slices that end where a piece ends."""
    raw, starts = _bytes_of(batch.column("text"))
    langs = batch.column("lang").dictionary_encode()
    names, of_text = langs.dictionary.to_pylist(), langs.indices.to_numpy()
    lo = 0
    while lo < len(raw):
        hi = min(lo + slice_bytes, len(raw))
        if hi < len(raw):
            next_text = int(starts[np.searchsorted(starts, hi)])
            ends = np.flatnonzero(_MAP[raw[hi:next_text]] == PIECE)
            hi = hi + int(ends[0]) + 1 if len(ends) else next_text
        found = _slice(_MAP[raw[lo:hi]], starts, lo, of_text, names)
        if found is not None:
            yield found
        lo = hi


def _slice(mapped: np.ndarray, starts: np.ndarray, lo: int, of_text: np.ndarray, names: list[str]) -> Words | None:
    letter = (mapped != SPACE) & (mapped != PIECE)
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    begins = starts[(starts >= lo) & (starts < lo + len(mapped))] - lo
    first[begins] |= letter[begins]
    at = np.flatnonzero(first)
    if not len(at):
        return None
    ends = mapped == PIECE
    ends[begins] = True
    data, index = mapped[letter], np.cumsum(letter)[at] - 1
    offsets = np.append(index, len(data)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    text = np.searchsorted(starts, at + lo, side="right") - 1
    return Words(words.dictionary.cast(pa.string()), words.indices.to_numpy().astype(np.int64), of_text[text].astype(np.int64), np.cumsum(ends)[at], names)


# -- bitmaps ---------------------------------------------------------------
def hashed(phrase: str | Column) -> Column:
    """Hash of a phrase and its language; tasks compute the same."""
    phrase = F.col(phrase) if isinstance(phrase, str) else phrase
    return F.crc32(F.concat(F.col("lang"), F.lit("\0"), phrase).cast("binary"))


def bitmap(keys: DataFrame) -> bytes:
    """Bits of the ``key`` column; at most BITS / 64 rows reach the driver."""
    slots = keys.select((F.col("key") % BITS).alias("bit")).select(F.expr("bit div 64").alias("slot"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("word"))
    rows = slots.groupBy("slot").agg(F.expr("bit_or(word)").alias("word")).toArrow()
    words = np.zeros(BITS // 64, np.int64)
    words[rows["slot"].to_numpy()] = rows["word"].to_numpy()
    return words.tobytes()


def _marked(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = keys % (len(bits) * 8)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _marker(marks: bytes) -> Callable[[str], Column]:
    @F.pandas_udf("boolean")
    def marked(key: pd.Series) -> pd.Series:
        return pd.Series(_marked(key.to_numpy(), np.frombuffer(marks, np.uint8)))
    return marked


# -- suffixes of a slice ---------------------------------------------------
def _word_hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each occurrence's word and language, and a small number for the two."""
    both = words.code * len(words.langs) + words.lang
    small, values = pd.factorize(both)
    terms = words.dictionary.cast(pa.binary()).to_pylist()
    langs = pa.array(words.langs, pa.string()).cast(pa.binary()).to_pylist()
    code, lang = np.divmod(values, len(langs))
    crc = np.fromiter((zlib.crc32(b"%b\0%b" % (langs[g], terms[w])) for w, g in zip(code.tolist(), lang.tolist())), np.int64, len(values))
    return crc[small], small


def _texts(words: Words, place: np.ndarray, length: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Language and space-joined words, ``length`` of them, from each place on."""
    lang = pa.array(words.langs, pa.string()).take(pa.array(words.lang[place]))
    last = len(words.code) - 1
    columns = [words.dictionary.take(pa.array(words.code[np.minimum(place + k, last)], mask=k >= length)) for k in range(int(length.max(initial=1)))]
    return lang, pc.binary_join_element_wise(*columns, " ", null_handling="skip")


def _pairs(words: Words, crc: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word: whether it and the next are frequent words of one piece, and the
    hash of the next."""
    known = _marked(crc, frequent)
    joined = np.zeros(len(crc), bool)
    joined[:-1] = (words.piece[1:] == words.piece[:-1]) & known[1:] & known[:-1]
    return joined, np.append(crc[1:], 0)


def _pair_key(first, second):
    """Place of a pair in its bitmap, from the words' hashes (arrays or columns)."""
    return first * 251 + second


def _each_slice(slice_bytes: int, work: Callable[[Words], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in words_of(batch, slice_bytes):
                done = work(words)
                if done is not None:
                    yield done
    return run


def _count_words(words: Words) -> pa.RecordBatch:
    both = words.code * len(words.langs) + words.lang
    n = np.bincount(both)
    used = np.flatnonzero(n)
    code, lang = np.divmod(used, len(words.langs))
    return pa.RecordBatch.from_arrays([pa.array(words.langs, pa.string()).take(pa.array(lang)), words.dictionary.take(pa.array(code)), pa.array(n[used], pa.int64())],
                                      names=["lang", "phrase", "f"])


def _count_pairs(frequent: bytes) -> Callable[[Words], pa.RecordBatch | None]:
    bits = np.frombuffer(frequent, np.uint8)

    def run(words: Words) -> pa.RecordBatch | None:
        crc = _word_hashes(words)[0]
        joined, after = _pairs(words, crc, bits)
        both = crc[joined].astype(np.uint64) << np.uint64(32) | after[joined].astype(np.uint64)
        code, keys = pd.factorize(both.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.bincount(code), pa.int64())], names=["key", "f"]) if len(keys) else None
    return run


def _suffixes(frequent: bytes, pairs: bytes, shared: bytes, max_words: int) -> Callable[[Words], pa.RecordBatch | None]:
    """Suffixes of three words or more, and those of two of which one has a shared hash;
    equal ones of a slice combined."""
    word_bits, pair_bits, shared_bits = (np.frombuffer(b, np.uint8) for b in (frequent, pairs, shared))

    def run(words: Words) -> pa.RecordBatch | None:
        crc, small = _word_hashes(words)
        joined, after = _pairs(words, crc, word_bits)
        joined &= _marked(_pair_key(crc, after), pair_bits)
        place = np.flatnonzero(joined)
        goes_on, n_small = np.append(joined, np.zeros(max_words, bool)), int(small.max()) + 2
        length, going = np.ones(len(place), np.int64), np.ones(len(place), bool)
        for k in range(1, max_words):
            going &= goes_on[place + k - 1]
            length += going
        kept = (length > 2) | _marked(crc[place], shared_bits) | _marked(after[place], shared_bits)
        place, length = place[kept], length[kept]
        if not len(place):
            return None
        same = small[place]
        for k in range(1, max_words):
            same = pd.factorize(same * n_small + np.where(k < length, small[np.minimum(place + k, len(small) - 1)] + 1, 0))[0]
        one = np.zeros(int(same.max()) + 1, np.int64)
        one[same] = np.arange(len(same))
        lang, text = _texts(words, place[one], length[one])
        return pa.RecordBatch.from_arrays([lang, text, pa.array(length[one], pa.int32()), pa.array(np.bincount(same), pa.int64())], names=["lang", "suffix", "words", "c"])
    return run


# -- subtrees --------------------------------------------------------------
def _subtree(max_words: int, min_count: int) -> Callable[[pa.Table], pa.Table]:
    """Nodes of a group's subtree, deeper than the prefixes of the group."""
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        lists = pc.split_pattern(group["suffix"].combine_chunks(), " ")
        offsets, flat = lists.offsets.to_numpy(), lists.flatten().dictionary_encode()
        length = np.diff(offsets)
        leaf = np.full((len(length), max_words), -1, np.int64)
        row = np.repeat(np.arange(len(length)), length)
        leaf[row, np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], length)] = flat.indices.to_numpy()
        langs = group["lang"].combine_chunks().dictionary_encode()
        lang = langs.indices.to_numpy()
        order = np.lexsort((*leaf.T[::-1], lang))
        leaf, lang = leaf[order], lang[order]
        depth, count = group["depth"].to_numpy()[order], group["c"].to_numpy()[order]
        starts = np.append(True, lang[1:] != lang[:-1])
        found = {"lang": [], "phrase": [], "f": []}
        for d in range(1, max_words + 1):
            starts[1:] |= leaf[1:, d - 1] != leaf[:-1, d - 1]
            first = np.flatnonzero(starts)
            total = np.add.reduceat(count, first)
            nodes = (total >= min_count) & (leaf[first, d - 1] >= 0) & (depth[first] < d)
            at = first[nodes]
            if len(at):
                found["lang"].append(langs.dictionary.take(pa.array(lang[at])))
                found["phrase"].append(pc.binary_join_element_wise(*(flat.dictionary.take(pa.array(leaf[at, k])) for k in range(d)), " "))
                found["f"].append(pa.array(total[nodes], pa.int64()))
        schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])
        return pa.table([pa.chunked_array(found[c], schema.field(c).type) for c in schema.names], schema)
    return run


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = MAX_WORDS,
                  min_count: int = MIN_COUNT, budget: int = BUDGET, slice_bytes: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, f`` of all phrases of up to ``max_words`` words that occur
    ``min_count`` times or more, and ``lang, n`` of all words."""
    rows = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"))
    counted = rows.mapInArrow(_each_slice(slice_bytes, _count_words), "lang string, phrase string, f long")
    counted = stored(counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f")), "phrase-words")
    sizes = stored(counted.groupBy("lang").agg(F.sum("f").alias("n")), "phrase-sizes")
    words = counted.where(F.col("f") >= min_count)
    if max_words < 2:
        return words, sizes
    frequent = bitmap(words.select(hashed("phrase").alias("key")))
    shared = bitmap(shared_hashes(counted, frequent, min_count))
    pairs = rows.mapInArrow(_each_slice(slice_bytes, _count_pairs(frequent)), "key long, f long").groupBy("key").agg(F.sum("f").alias("f"))
    pairs = stored(pairs.where(F.col("f") >= min_count).select(
        F.shiftrightunsigned("key", 32).alias("first"), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("second"), "f"), "phrase-pairs")
    marks = bitmap(pairs.select(_pair_key(F.col("first"), F.col("second")).alias("key")))
    suffixes = rows.mapInArrow(_each_slice(slice_bytes, _suffixes(frequent, marks, shared, max_words)), "lang string, suffix string, words int, c long")
    nodes = tree_nodes(stored(suffixes, "phrase-suffixes"), max_words, min_count, budget)
    marked = _marker(shared)
    word = lambda k: hashed(F.substring_index("phrase", " ", k))
    nodes = nodes.where((F.size(F.split("phrase", " ")) > 2) | marked(word(1)) | marked(word(-1)))
    return words.unionByName(pair_phrases(pairs, words, shared)).unionByName(nodes), sizes


def shared_hashes(counted: DataFrame, frequent: bytes, min_count: int) -> DataFrame:
    """``key``: hashes of more than one word, one of them frequent."""
    keys = counted.select(hashed("phrase").alias("key"), "f").where(_marker(frequent)("key"))
    found = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("f").alias("f"))
    return found.where((F.col("n") > 1) & (F.col("f") >= min_count)).select("key")


def pair_phrases(pairs: DataFrame, words: DataFrame, shared: bytes) -> DataFrame:
    """``lang, phrase, f`` of the counted pairs of two frequent words without a shared hash;
    a hash then names its word. Hashes of rare words, which name none, fall out."""
    named = words.select("lang", "phrase", hashed("phrase").alias("key")).where(~_marker(shared)("key"))
    named = broadcast_if_small(stored(named, "phrase-named"), 100)
    first = named.select("lang", F.col("phrase").alias("head"), F.col("key").alias("first"))
    second = named.select(F.col("phrase").alias("tail"), F.col("key").alias("second"))
    return pairs.join(first, "first").join(second, "second").select("lang", F.concat_ws(" ", "head", "tail").alias("phrase"), "f")


def tree_nodes(suffixes: DataFrame, max_words: int, min_count: int, budget: int) -> DataFrame:
    """``lang, phrase, f`` of the nodes of two words or more of the tree of ``suffixes``."""
    schema = "lang string, phrase string, f long"
    left, parts, loads, nodes = suffixes, [], [], []
    for depth in range(1, max_words + 1):
        by_prefix = left.withColumn("phrase", F.expr(f"substring_index(suffix, ' ', {depth})"))
        counted = by_prefix.groupBy("lang", "phrase").agg(F.sum("c").alias("f"), F.count("c").alias("held"))
        if depth == max_words:
            nodes.append(counted.where(F.col("f") >= min_count).select("lang", "phrase", "f"))
            break
        counted = stored(counted, f"phrase-prefixes-{depth}").withColumn("key", hashed("phrase"))
        if depth > 1:
            nodes.append(counted.where(F.col("f") >= min_count).select("lang", "phrase", "f"))
        large = counted.where((F.col("held") > budget) & (F.col("f") >= min_count))
        loads.append(counted.where(F.col("f") >= min_count).where(F.col("held") <= budget).select("key", "held"))
        by_prefix = by_prefix.where(F.col("words") > depth).withColumns({"key": hashed("phrase"), "depth": F.lit(depth)})
        if large.isEmpty():
            parts.append(by_prefix)
            break
        by_prefix = by_prefix.withColumn("more", _marker(bitmap(large))("key"))
        parts.append(by_prefix.where(~F.col("more")).drop("more"))
        left = by_prefix.where("more").drop("phrase", "key", "depth", "more")
    load = stored(_union(loads), "phrase-loads")
    groups = max(1, -(-(load.agg(F.sum("held")).first()[0] or 0) // budget))
    while (load.groupBy((F.col("key") % groups).alias("g")).agg(F.sum("held").alias("held")).agg(F.max("held")).first()[0] or 0) > 2 * budget:
        groups = 2 * groups + 1
    dealt = _union(parts).withColumn("g", F.col("key") % groups).select("g", "lang", "suffix", "depth", "c")
    nodes.append(stored(dealt.groupBy("g").applyInArrow(_subtree(max_words, min_count), schema), "phrase-nodes"))
    return _union(nodes)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def collocations(counts: DataFrame, sizes: DataFrame, top: int | None = TOP, max_words: int = MAX_WORDS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the phrases of two words or more: the
    lowest score over their cuts, without those that a longer phrase of the same count
    holds; each language's first ``top``."""
    counts = stored(counts, "phrase-counts")
    small = broadcast_if_small(counts, 250)
    words = F.split("phrase", " ")
    phrases = counts.withColumn("w", words).where(F.size("w") >= 2)
    # a longer phrase with the same count implies one of one word more
    held = phrases.where(F.size("w") >= 3).select("lang", "f", F.explode(F.array(
        F.expr("array_join(slice(w, 1, size(w) - 1), ' ')"), F.expr("array_join(slice(w, 2, size(w) - 1), ' ')"))).alias("phrase")).distinct()
    kept = phrases.join(held, ["lang", "phrase", "f"], "left_anti")
    cut = kept.withColumn("k", F.explode(F.expr("sequence(1, size(w) - 1)"))).select(
        "lang", "phrase", F.col("f").alias("a"), "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("head"), F.expr("array_join(slice(w, k + 1, size(w) - k), ' ')").alias("tail"))
    cut = cut.join(small.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cut = cut.join(small.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    cut = cut.join(broadcast_if_small(sizes, 64), "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cut = cut.withColumns({"up": wide("a") * wide("n") * F.lit(1000).cast("decimal(4,0)"), "down": wide("l") * wide("r")})
    cut = cut.withColumn("score", F.expr("up div down"))
    best = cut.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    best = best.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT,
         top: int | None = TOP, budget: int = BUDGET, slice_bytes: int = SLICE) -> DataFrame:
    counts, sizes = phrase_counts(docs, text, lang, max_words, min_count, budget, slice_bytes)
    return collocations(counts, sizes, top, max_words)
