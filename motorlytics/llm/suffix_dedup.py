"""Suffix-array dedup: removes bytes covered by strings of ``length`` bytes that start
more than once anywhere in the corpus.

Windows (strings of ``length`` bytes) that are equal have equal smallest k-gram hashes,
so the corpus is dealt into buckets by that hash: each maximal run of windows with one
smallest hash is one string of its bucket. Only buckets that hold more than one run can
repeat anything. Equal strings of a bucket are one, counted. For each bucket with
different strings a suffix array is built, and neighbours in it that share ``length``
bytes are repeats, as are all windows of a string that occurs twice.

The array is built by linear grouping: suffixes start grouped by their first symbol;
groups are processed from the largest down, and the suffixes that the previous-smaller
pointers of a group lead to are moved into groups of their own behind their old ones,
those led to most often last, until a group is the suffixes of one Lyndon prefix. One
scan then emits the order inside the groups. No names are assigned again, no recursion.

A bucket of very many different strings (a passage in a third of all documents, each
time in another context) or of many bytes (long runs of one byte or a short period share
a bucket) is split further, by the windows themselves.

Defined results: null is empty; texts shorter than ``length`` repeat nothing; rows that
repeat a doc_id, whole rows included, are places of their own; a null doc_id is judged
like any other; an empty table gives no rows.
"""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motorlytics.llm.common import BROADCAST_BYTES, shuffle_partitions, stored

LENGTH = 200
#: Length of the k-grams (a power of two, at most LENGTH).
GRAM = 64
#: A bucket of more different strings than this, or of more bytes in them (the array of
#: 1 MB takes some 250 MB of a task's memory and a few seconds), is split by windows.
HOT_STRINGS = 4000
HOT_BYTES = 3 << 19
#: Windows that a task hashes before it sends their rows on.
SLICE = 1 << 16
#: Windows of a text that are looked at together; bounds the memory for very long texts.
CHUNK = 1 << 20
#: Enough for a position inside a chunk.
POSITION_BITS = 21

_MIX = [0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xA0761D6478BD642F, 0x9FB21C651E98DF25]


def smallest_grams(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the first smallest k-gram of each window; both depend on the
    window's bytes alone, the position counted from its start."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    span, i = 1, 0
    while span < gram:
        h = h[:-span] * np.uint64(_MIX[i % len(_MIX)]) + h[span:]
        h ^= h >> np.uint64(31)
        span, i = 2 * span, i + 1
    low = np.uint64(POSITION_BITS)
    least = (h >> low << low) | np.arange(len(h), dtype=np.uint64)
    span, width = 1, length - gram + 1
    while 2 * span <= width:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    if span < width:
        rest = width - span
        least = np.minimum(least[:-rest], least[rest:])
    at = (least & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
    return h[at], at


def runs(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, int, int, bool]]:
    """(bucket, start, number of windows, whether it may repeat inside) of each run. Equal
    windows of a run have their smallest k-grams at different places, so it may only if
    the place changes."""
    whole = np.frombuffer(raw, np.uint8)
    for off in range(0, max(0, len(raw) - length + 1), CHUNK):
        value, at = smallest_grams(whole[off:off + CHUNK + length - 1], length, gram)
        starts = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
        ends = np.append(starts[1:], len(value))
        many = at[starts] != at[ends - 1]
        yield from zip(value[starts].view(np.int64).tolist(), (starts + off).tolist(), (ends - starts).tolist(), many.tolist(), strict=True)


def suffix_array(s: list[int] | np.ndarray) -> list[int]:
    """Suffix array of ``s``, whose last symbol is smaller than all others."""
    n = len(s)
    symbols = np.asarray(s)
    order = np.argsort(symbols, kind="stable")
    symbols = symbols[order]
    starts = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1])))
    sizes = np.diff(np.append(starts, n))
    # first position of a suffix's group; size of a group by first position; position of a suffix
    group, size, at = np.empty(n, np.int64), np.zeros(n, np.int64), np.empty(n, np.int64)
    group[order], size[starts], at[order] = np.repeat(starts, sizes), sizes, np.arange(n)
    sa, group, size, at = order.tolist(), group.tolist(), size.tolist(), at.tolist()
    before = [-1] * n
    end = n
    while end > 0:
        low = group[sa[end - 1]]
        led: dict[int, int] = {}
        if end - low == 1:
            x = sa[low]
            p = x - 1
            while p >= 0 and group[p] >= low:
                p = before[p]
            before[x] = p
            if p >= 0 and size[group[p]] > 1:
                led[p] = 1
        else:
            for x in sorted(sa[low:end]):
                p = x - 1
                while p >= 0 and group[p] >= low:
                    p = before[p]
                before[x] = p
                if p >= 0:
                    led[p] = led.get(p, 0) + 1
        if len(led) == 1:
            (p,) = led
            old = group[p]
            if size[old] > 1:
                last = old + size[old] - 1
                i, y = at[p], sa[last]
                sa[i], sa[last], at[y], at[p] = y, p, i, last
                size[old] -= 1
                group[p], size[last] = last, 1
        elif led:
            most = max(led.values())
            for times in range(most, 0, -1):
                parts: dict[int, list[int]] = {}
                for p, c in led.items():
                    if c == times:
                        parts.setdefault(group[p], []).append(p)
                for old, ps in parts.items():
                    if len(ps) == size[old]:
                        continue
                    cut = old + size[old]
                    for p in ps:
                        cut -= 1
                        i, y = at[p], sa[cut]
                        sa[i], sa[cut], at[y], at[p] = y, p, i, cut
                    for p in ps:
                        group[p] = cut
                    size[cut] = len(ps)
                    size[old] -= len(ps)
        end = low
    del sa, size, at
    # emit: the smallest suffix not yet placed that a placed one leads to is next in its group
    out, slot, placed = [-1] * n, list(range(n)), [False] * n
    out[0], placed[n - 1] = n - 1, True
    for i in range(n):
        x = out[i] - 1
        while x >= 0 and not placed[x]:
            g = group[x]
            out[slot[g]] = x
            slot[g] += 1
            placed[x] = True
            x = before[x]
    return out


def repeated_windows(strings: list[bytes], length: int = LENGTH) -> list[list[int]]:
    """For each of the (different) strings, the starts of its windows that occur elsewhere."""
    m = len(strings)
    text = b"\0".join(strings) + b"\0"
    lengths = np.array([len(raw) + 1 for raw in strings])
    ends = np.cumsum(lengths) - 1
    symbols = np.frombuffer(text, np.uint8).astype(np.int64) + m
    symbols[ends] = np.arange(m - 1, -1, -1)  # all ends differ, the last is the smallest
    sa = suffix_array(symbols)
    order = np.array(sa)
    window = order <= np.repeat(ends, lengths)[order] - length
    marked = np.zeros(len(text), bool)
    # suffixes between two that share `length` bytes share them too, so neighbours tell all
    for k in np.flatnonzero(window[1:] & window[:-1]).tolist():
        x, y = sa[k], sa[k + 1]
        if text[x:x + length] == text[y:y + length]:
            marked[x] = marked[y] = True
    return [np.flatnonzero(part).tolist() for part in np.split(marked, ends[:-1] + 1)]


def spans(starts: Iterable[int]) -> list[tuple[int, int]]:
    """Sorted integers as maximal [from, to) ranges."""
    out: list[tuple[int, int]] = []
    for x in starts:
        if out and x == out[-1][1]:
            out[-1] = (out[-1][0], x + 1)
        else:
            out.append((x, x + 1))
    return out


# ---- Spark -----------------------------------------------------------------
KEY = ["id0", "k1"]
MARKS = "v long, c long, marks array<struct<a:int,b:int>>"


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select("doc_id", text.alias("raw")).withColumns(
        {"id0": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "k1": F.xxhash64("raw")})


def bucket_counts(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """``v, n``: runs by bucket (a run that may repeat inside counts twice)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(v, 1 + many) for raw in batch.column(0) for v, _, _, many in runs(raw.as_py(), length, gram)]
            both = np.array(found, np.int64).reshape(-1, 2)
            value, where = np.unique(both[:, 0], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(np.bincount(where, both[:, 1], len(value)).astype(np.int64))], names=["v", "n"])

    return keyed.select("raw").mapInArrow(run, "v long, n long").groupBy("v").agg(F.sum("n").alias("n"))


def candidate_runs(keyed: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """``v, c, id0, k1, start, windows, many`` of the runs of buckets ``wanted(v)``; c is
    a hash of the string, which together with v (128 bits) stands for it. If the list of
    buckets is counted to be small the tasks filter, else a join does."""
    small = None
    if wanted.count() * 8 <= BROADCAST_BYTES:
        small = keyed.sparkSession.sparkContext.broadcast(np.sort(wanted.toArrow()["v"].to_numpy()))
    names = ["v", "c", "id0", "k1", "start", "windows", "many"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for id0, k1, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = raw.as_py()
                found = list(runs(raw, length, gram))
                if small is not None and found:
                    values = np.array([f[0] for f in found], np.int64)
                    at = np.searchsorted(small.value, values)
                    hit = np.zeros(len(values), bool) if not len(small.value) else small.value[np.minimum(at, len(small.value) - 1)] == values
                    found = [found[j] for j in np.flatnonzero(hit)]
                rows += [(v, xxhash.xxh3_64_intdigest(raw[s:s + w + length - 1]) - (1 << 63), id0, k1, s, w, many) for v, s, w, many in found]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)

    found = keyed.select("id0", "k1", "raw").mapInArrow(run, "v long, c long, id0 long, k1 long, start int, windows int, many boolean")
    return found if small is not None else found.join(wanted, "v", "left_semi")


def cut_strings(keyed: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """The bytes of the strings at ``places(id0, k1, v, c, n, start, windows)``."""
    # bounded by the runs of one document
    per_doc = places.groupBy(*KEY).agg(F.collect_list(F.struct("v", "c", "n", "hot", "start", "windows")).alias("at"))
    one = keyed.select(*KEY, "raw").join(per_doc.hint("merge"), KEY)
    one = one.select("raw", F.explode("at").alias("p")).select(
        "p.*", F.expr(f"substring(raw, p.start + 1, p.windows + {length - 1})").alias("bytes"))
    return one.select("v", "c", "n", "hot", "bytes")


def array_marks(strings: DataFrame, length: int) -> DataFrame:
    """Repeated windows of strings that occur once, by the suffix array of their bucket."""
    dealt = strings.repartition(shuffle_partitions(strings.sparkSession), "v").sortWithinPartitions("v", "c")

    def done(bucket: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int, list[tuple[int, int]]]]:
        found = repeated_windows([b for *_, b in bucket], length)
        return [(v, c, spans(f)) for (v, c, n, _), f in zip(bucket, found, strict=True) if n == 1 and f]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))]

        def batch_of(rows: list) -> pa.RecordBatch:
            columns = [[r[0] for r in rows], [r[1] for r in rows], [[{"a": a, "b": b} for a, b in r[2]] for r in rows]]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["v", "c", "marks"])

        bucket: list = []
        gc.disable()  # many small lists without cycles; the worker's collector would scan them again and again
        for batch in batches:
            made = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if bucket and bucket[0][0] != row[0]:
                    made += done(bucket)
                    bucket = []
                if not bucket or bucket[-1][1] != row[1]:  # a repeated row of a document cuts a string twice
                    bucket.append(row)
            yield batch_of(made)
        if bucket:
            yield batch_of(done(bucket))
        gc.enable()

    return dealt.select("v", "c", "n", "bytes").mapInArrow(run, MARKS)


def window_marks(strings: DataFrame, length: int) -> DataFrame:
    """The same for hot buckets, which are split until each part is one window: equal
    windows are counted by their 128-bit hash, with partial counts before the shuffle."""
    def batch_of(rows: list) -> pa.RecordBatch:
        v, c, n, digests, at = zip(*rows, strict=True)
        h = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (v, c, n, h[:, 0], h[:, 1])), pa.array(at, pa.list_(pa.int32()))],
                                          names=["v", "c", "n", "h1", "h2", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for v, c, n, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                raw = raw.as_py()
                total = len(raw) - length + 1
                for off in range(0, total, SLICE):
                    until = min(off + SLICE, total)
                    at: dict[bytes, list[int]] = {}  # equal windows of a slice are one row
                    for o in range(off, until):
                        at.setdefault(xxhash.xxh3_128_digest(raw[o:o + length]), []).append(o)
                    rows += [(v, c, n, h, places) for h, places in at.items()]
                    size += until - off
                    if size >= SLICE:
                        yield batch_of(rows)
                        rows, size = [], 0
        if rows:
            yield batch_of(rows)

    windows = strings.select("v", "c", "n", "bytes").dropDuplicates(["v", "c"]).mapInArrow(run, "v long, c long, n long, h1 long, h2 long, at array<int>")
    windows = stored(windows, "suffix-windows")
    often = windows.groupBy("h1", "h2").agg(F.sum(F.col("n") * F.size("at")).alias("times")).where("times > 1").select("h1", "h2")
    hit = windows.where("n = 1").join(often, ["h1", "h2"], "left_semi").select("v", "c", F.explode("at").alias("o"))
    # neighbouring starts of a string (at most CHUNK) are one range
    island = F.col("o") - F.row_number().over(Window.partitionBy("v", "c").orderBy("o"))
    hit = hit.withColumn("island", island).groupBy("v", "c", "island").agg(F.min("o").alias("a"), (F.max("o") + 1).alias("b"))
    return hit.groupBy("v", "c").agg(F.collect_list(F.struct("a", "b")).alias("marks"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT_STRINGS,
                   hot_bytes: int = HOT_BYTES) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``doc_id, n_bytes, n_removed, n_spans, kept`` (binary:
    the remaining bytes; a cut may fall inside a character), one row per document row."""
    keyed = _keyed(docs)
    wanted = stored(bucket_counts(keyed, length, gram).where("n > 1").select("v"), "suffix-buckets")
    found = stored(candidate_runs(keyed, wanted, length, gram), "suffix-runs")
    place = F.struct("id0", "k1", "start", "windows")
    strings = stored(found.groupBy("v", "c").agg(F.count("*").alias("n"), F.max("many").alias("many"), F.min(place).alias("place")), "suffix-strings")
    mixed = strings.groupBy("v").agg(F.count("*").alias("different"), F.min("n").alias("least"), F.max("many").alias("many"),
                                      F.sum(F.col("place.windows").cast("long") + (length - 1)).alias("held"))
    mixed = mixed.where("(different > 1 and least = 1) or many").select("v", ((F.col("different") > hot) | (F.col("held") > hot_bytes)).alias("hot"))
    places = strings.join(mixed, "v").select("place.*", "v", "c", "n", "hot")
    cut = stored(cut_strings(keyed, places, length), "suffix-cut")
    marks = array_marks(cut.where("not hot"), length).unionByName(window_marks(cut.where("hot"), length))
    whole = strings.where("n > 1").select("v", "c", F.array(F.struct(F.lit(0).alias("a"), F.col("place.windows").alias("b"))).alias("marks"))
    marks = stored(whole.unionByName(marks.select("v", "c", "marks")), "suffix-marks")

    lost = found.select("v", "c", *KEY, "start").join(marks, ["v", "c"]).select(*KEY, F.transform(
        "marks", lambda m: F.struct((F.col("start") + m["a"]).alias("a"), (F.col("start") + m["b"] - 1 + length).alias("b"))).alias("marks"))
    lost = lost.groupBy(*KEY).agg(F.flatten(F.collect_list("marks")).alias("marks")).hint("merge")
    joined = keyed.join(lost, KEY, "left").select("doc_id", "raw", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, marks in zip(batch.column(1), batch.column(2), strict=True):
                raw = raw.as_py()
                kept, removed, n, at = [], 0, 0, 0
                # `at` ends the removed run so far
                for m in sorted((m["a"], m["b"]) for m in marks.as_py() or ()):
                    if m[0] > at or n == 0:
                        kept.append(raw[at:m[0]])
                        removed, n, at = removed + m[1] - m[0], n + 1, m[1]
                    elif m[1] > at:
                        removed, at = removed + m[1] - at, m[1]
                kept.append(raw[at:])
                out.append((len(raw), removed, n, b"".join(kept)))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = dict(joined.dtypes)["doc_id"]
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
