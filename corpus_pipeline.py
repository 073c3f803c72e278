"""Training-corpus pipeline: documents through five operators, stage by stage.

Each stage is written as Parquet and read again as the next one's input, so a lost
executor costs at most the stage it was working on. A stage packs the columns it does
not read into one, so extra columns may have any name. All but the last return the
columns of their input.

Null doc_ids: such rows pass the near-duplicate stage (they cannot be named) and are
judged like any other elsewhere. Rows repeating a doc_id stay or go together there.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlytics.llm import bpe_automaton, decontaminate, line_runs, ngram_join, quality_fm
from motorlytics.llm.common import broadcast_if_small, stored
from motorlytics.sources.tables import read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

VOCABULARY = "byte_bpe_50k.json"


def packed(docs: DataFrame, reads: list[str]) -> DataFrame:
    """The columns a stage reads, and all of them as one."""
    return docs.select(*(c for c in reads if c in docs.columns), F.struct(*docs.columns).alias("packed_row"))


def unpacked(docs: DataFrame, like: DataFrame, **changed: Column) -> DataFrame:
    return docs.select(*(changed.get(c, F.col("packed_row")[c]).alias(c) for c in like.columns))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on labelled rows of this input, rejects go."""
    model = quality_fm.fit(docs.select(*(c for c in ("doc_id", "text", "n_chars") if c in docs.columns)), read_table(spark, sf_dir, "labels"))
    scored = quality_fm.scores(packed(docs, ["text", "n_chars"]), model, ["packed_row"])
    return unpacked(scored.where(F.col("score") >= quality_fm.THRESHOLD), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, except in the last document holding them; a changed text gets
    its own n_chars."""
    done = line_runs.dedup_lines(packed(docs, ["doc_id", "text"]))
    changed, row = F.col("line_dedup.n_dropped") > 0, F.col("packed_row")
    new = {"text": F.when(changed, F.col("line_dedup.kept")).otherwise(row["text"])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("line_dedup.kept").cast(docs.schema["n_chars"].dataType)).otherwise(row["n_chars"])
    return unpacked(done, docs, **new)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    groups = ngram_join.ngram_components(docs.select("doc_id", "text"))
    gone = groups.where("doc_id is not null").groupBy(F.col("doc_id").alias("gone_id")).agg(
        F.max(F.col("doc_id") == F.col("component_id")).alias("first")).where("not first").select("gone_id")
    # grows with the documents, so it is never broadcast
    rest = packed(docs, ["doc_id"]).join(stored(gone, "pipeline-gone").hint("merge"), F.col("doc_id").cast("long") == F.col("gone_id"), "left_anti")
    return unpacked(rest, docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    leaks = decontaminate.find_leaks(docs.select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    leaks = broadcast_if_small(stored(leaks.select("k1", "k2").distinct(), "pipeline-leaks"), 16)
    rows = packed(docs, ["doc_id", "text"]).withColumns(decontaminate.row_key(F.col("doc_id"), decontaminate.text_of()))
    return unpacked(rows.join(leaks, ["k1", "k2"], "left_anti"), docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of the documents, ``text`` being what the tokens decode to, then
    ``token_ids`` (little-endian unsigned 32-bit integers) and ``n_tokens``, which replace
    columns of the documents with these names (in any case of letters)."""
    vocabulary = bpe_automaton.read_vocabulary(public_tokenizers.path(VOCABULARY))
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select("text", F.struct(*rest).alias("packed_row"))
    coded = bpe_automaton.encode_documents(rows, vocabulary, ids="token_ids").drop("text")
    done = bpe_automaton.decode_documents(coded, vocabulary, ids="token_ids", text="text")
    return done.select(*(F.col("text") if c == "text" else F.col("packed_row")[c].alias(c) for c in docs.columns if c.lower() not in ("token_ids", "n_tokens")),
                       "token_ids", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: The quality model is trained, so SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs
