"""Line dedup over levelled sorted runs of line hashes.

A run is a table ``(h1, h2, n_docs, last_doc)`` hash-bucketed on the line hash and
sorted by it inside each bucket, so runs are joined bucket by bucket without moving
rows again. A new batch merge-anti-joins the runs: the lines that no run holds are new
and become a run of level 0, so runs never share a line; the others only add to counts
and become a run of lines seen again. A level that holds ``fanout`` runs is compacted
into one run of the next level (runs of new lines end to end, those seen again by a
merge join that adds the counts), so the number of runs grows with the logarithm of the
number of batches. A line's count is that of the one run that holds it and what the runs
of lines seen again add.

A line's key is the line without white space at both ends, A-Z lower-cased; keys
shorter than ``min_chars`` code points never count. The 128-bit hash stands for the
key. Counting is pre-aggregated twice: per (key, document), which spreads a hot
line over all partitions, then per key with partial sums before the shuffle.

Defined results: null or empty text is one empty line; a null doc_id is no
document: its lines are neither counted nor dropped; rows repeating a doc_id are
one document for counting and are each returned; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlytics.llm.common import broadcast_if_small, hash128, lower_ascii, shuffle_partitions, stored, strip_white, text_of
from motorlytics.sources.io import shared_path

MIN_CHARS = 40
MIN_DOCS = 5
N_BATCHES = 4
FANOUT = 2
RUN_SCHEMA = "h1 long, h2 long, n_docs long, last_doc long"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def line_key(line: Column) -> Column:
    return strip_white(lower_ascii(line))


def line_hash(line: Column, min_chars: int) -> Column:
    """``struct(h1, h2)`` of the line's key; null for a key too short to count."""
    key = line_key(line)
    h1, h2 = hash128(key)
    return F.when(F.length(key) >= min_chars, F.struct(h1.alias("h1"), h2.alias("h2")))


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """``(doc_id, h1, h2)``, one row per document row and distinct counted line."""
    # the length of the raw line bounds that of its key: short lines are dropped before any work on them
    long_lines = F.filter(lines_of(text_of()), lambda x: F.length(x) >= min_chars)
    lines = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array_distinct(long_lines)).alias("line"))
    return (lines.select("doc_id", line_hash(F.col("line"), min_chars).alias("h"))
            .where("h is not null").select("doc_id", "h.h1", "h.h2"))


class LineRuns:
    """The store: ``levels[i]`` lists the runs of level i (a few paths each), ``again[i]``
    those of the lines seen again."""

    def __init__(self, spark: SparkSession, n_buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.fanout = spark, max(2, fanout)
        self.n_buckets = n_buckets or shuffle_partitions(spark)
        self.levels: list[list[str]] = []
        self.again: list[list[str]] = []

    def _write(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (run.select("h1", "h2", "n_docs", "last_doc").repartition(self.n_buckets, "h1").write
         .bucketBy(self.n_buckets, "h1").sortBy("h1", "h2")
         .option("path", shared_path(self.spark, "line-run")).saveAsTable(name))
        return name

    def _merged(self, names: list[str]) -> DataFrame:
        """Runs merged pairwise: a full merge join of tables bucketed and sorted alike. (A
        union under an aggregate would do in principle, but with bucketed scans Spark 4.1
        takes the union as partitioned by the key when it isn't, and splits keys.)"""
        if not names:
            return self.spark.createDataFrame([], RUN_SCHEMA)
        out = self.spark.table(names[0])
        for name in names[1:]:
            more = self.spark.table(name).select("h1", "h2", F.col("n_docs").alias("n"), F.col("last_doc").alias("last"))
            out = out.join(more, ["h1", "h2"], "full").select(
                "h1", "h2", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "last").alias("last_doc"))
        return out

    def _end_to_end(self, names: list[str]) -> DataFrame:
        """Runs that share no line."""
        out = self.spark.table(names[0])
        for name in names[1:]:
            out = out.unionByName(self.spark.table(name))
        return out

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def unseen(self, batch: DataFrame) -> DataFrame:
        """Rows of ``batch(h1, h2, ...)`` whose line no run holds: one merge-anti-join per run."""
        for name in self.runs():
            batch = batch.join(self.spark.table(name).select("h1", "h2"), ["h1", "h2"], "left_anti")
        return batch

    def add(self, lines: DataFrame) -> DataFrame:
        """Add the batch ``lines(doc_id, h1, h2)``: its unseen lines as a run, the others as
        a run of lines seen again. The documents of a batch must not come back in a later
        one. Returns the lines the store had not seen."""
        per_doc = lines.select("h1", "h2", "doc_id").distinct()
        batch = self._write(per_doc.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc")))
        name = batch
        if self.runs():
            name = self._write(self.unseen(self.spark.table(batch)))
            seen = self.spark.table(batch).join(self.spark.table(name).select("h1", "h2"), ["h1", "h2"], "left_anti")
            self._place(self.again, self._write(seen), 0, self._merged)
        new = self.spark.table(name)
        self._place(self.levels, name, 0, self._end_to_end)
        return new

    def _place(self, levels: list[list[str]], name: str, level: int, merge: Callable[[list[str]], DataFrame]) -> None:
        while len(levels) <= level:
            levels.append([])
        levels[level].append(name)
        if len(levels[level]) >= self.fanout:
            merged = self._write(merge(levels[level]))
            levels[level] = []
            self._place(levels, merged, level + 1, merge)

    def repeated(self, min_docs: int) -> DataFrame:
        """``(h1, h2, last_doc)`` of lines found in at least ``min_docs`` documents: each run
        joined with what the lines seen again add to it."""
        again = self._merged([name for level in self.again for name in level]).select("h1", "h2", F.col("n_docs").alias("n"), F.col("last_doc").alias("last"))
        found = self.spark.createDataFrame([], "h1 long, h2 long, last_doc long")
        for name in self.runs():
            counted = self.spark.table(name).join(again, ["h1", "h2"], "left").where(F.col("n_docs") + F.coalesce("n", F.lit(0)) >= min_docs)
            found = found.unionByName(counted.select("h1", "h2", F.greatest("last_doc", "last").alias("last_doc")))
        return found


def build_runs(docs: DataFrame, min_chars: int = MIN_CHARS, n_batches: int = N_BATCHES, fanout: int = FANOUT) -> tuple[LineRuns, DataFrame]:
    """All documents, dealt into ``n_batches`` batches by doc_id, added one after another;
    also the hashed lines, which are stored once."""
    runs = LineRuns(docs.sparkSession, fanout=fanout)
    lines = stored(hashed_lines(docs, min_chars), "hashed-lines")
    for b in range(n_batches):
        runs.add(lines.where(F.pmod(F.col("doc_id"), F.lit(n_batches)) == b))
    return runs, lines


def drop_table(lines: DataFrame, runs: LineRuns, min_docs: int) -> DataFrame:
    """``(doc_id, dropped)``: hashes of the lines that each document loses."""
    repeated = stored(runs.repeated(min_docs), "repeated-lines")
    lost = (lines.join(broadcast_if_small(repeated, 24), ["h1", "h2"])
            .where(F.col("doc_id") != F.col("last_doc")))
    # bounded by the number of lines of one document
    return lost.groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("dropped"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                n_batches: int = N_BATCHES, fanout: int = FANOUT) -> DataFrame:
    """Every column of ``docs`` plus struct ``line_dedup(n_lines, n_dropped, kept)``.
    Only ``doc_id`` and ``text`` are read besides passing columns on, so clashing
    names of other columns do no harm (a column ``line_dedup`` would be replaced)."""
    runs, hashed = build_runs(docs.select("doc_id", "text"), min_chars, n_batches, fanout)
    drops = stored(drop_table(hashed, runs, min_docs), "dropped-lines")
    # grows with the documents, so it is never broadcast
    drops = drops.select(F.col("doc_id").alias("__drop_id"), F.col("dropped").alias("__dropped")).hint("merge")
    joined = docs.join(drops, F.col("doc_id").cast("long") == F.col("__drop_id"), "left")
    lines = lines_of(text_of())

    def stays(line: Column) -> Column:
        return F.coalesce(~F.array_contains(F.col("__dropped"), line_hash(line, min_chars)), F.lit(True))

    kept = F.when(F.col("__dropped").isNull(), lines).otherwise(F.filter(lines, stays))
    return joined.withColumn("line_dedup", F.struct(lines.alias("lines"), kept.alias("kept"))).withColumn(
        "line_dedup", F.struct(F.size("line_dedup.lines").cast("long").alias("n_lines"),
                               (F.size("line_dedup.lines") - F.size("line_dedup.kept")).cast("long").alias("n_dropped"),
                               F.array_join("line_dedup.kept", "\n").alias("kept"))).drop("__drop_id", "__dropped")
