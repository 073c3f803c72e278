"""Token counts kept up by deltas.

A rollup is a folder: ``deltas/batch_id=...`` holds the signed sums of one batch
by (source, lang, tokenizer), ``log`` one row per committed batch. A batch writes
its delta (overwriting what a failed attempt left) and then its log row; readers
sum the deltas of logged batches only, so a batch counts once however often it is
sent, and a half-written one never. ``compact`` sums the committed deltas into a
new one that replaces them with the same single log write.

Changes: ``change`` is ``insert`` (+), ``delete`` (-) or ``revise`` (the old count
under its old key is taken back, the new one added). Defined results: identical
change rows of a batch count once if they name a document; without an id each is a
document of its own; null source, lang or tokenizer is a group of
its own; a null count is 0; an unknown change raises; a group whose totals are
all 0 is left out; a rollup without batches is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlytics.llm.common import WORD_CLASS, text_of

KEYS = ["source", "lang", "tokenizer"]
CHANGE_SCHEMA = ("change string, doc_id long, source string, lang string, tokenizer string, n_tokens long, "
                 "old_source string, old_lang string, old_tokenizer string, old_n_tokens long")
DELTA_SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
LOG_SCHEMA = "batch_id string, replaces array<string>"

#: Counting rules by tokenizer version.
TOKEN_PATTERNS = {"words-1": WORD_CLASS + "+", "wordpunct-2": r"\p{L}+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{N}]"}


def token_count(version: str, col: Column | str = "text") -> Column:
    return F.regexp_count(text_of(col), F.lit(TOKEN_PATTERNS[version])).cast("long")


def signed_sums(changes: DataFrame) -> DataFrame:
    """Signed sums of a batch of changes by key; partial sums are made before the shuffle."""
    named = [f.split()[0] for f in CHANGE_SCHEMA.split(", ")]
    c = changes.groupBy(*named).agg(F.count(F.lit(1)).alias("copies"))
    known = F.col("change").isin("insert", "delete", "revise")
    c = c.withColumn("change", F.when(known, F.col("change")).otherwise(
        F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce("change", F.lit("null"))))))
    times = F.when(F.col("doc_id").isNull(), F.col("copies")).otherwise(F.lit(1)).cast("long")
    sign = F.when(F.col("change") == "delete", -times).otherwise(times)

    def row(prefix: str, s: Column) -> Column:
        return F.struct(*(F.col(prefix + k).alias(k) for k in KEYS), s.alias("n_docs"),
                        (s * F.coalesce(prefix + "n_tokens", F.lit(0))).alias("n_tokens"))

    rows = F.when(F.col("change") == "revise", F.array(row("", sign), row("old_", -times))).otherwise(F.array(row("", sign)))
    return c.select(F.inline(rows)).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class TokenRollup:
    """Additive totals in ``path`` (a shared folder). One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, create: bool = True):
        self.spark, self.path = spark, path.rstrip("/")
        if create:
            spark.createDataFrame([], LOG_SCHEMA).write.mode("ignore").parquet(f"{self.path}/log")

    def _log(self) -> DataFrame:
        return self.spark.read.schema(LOG_SCHEMA).parquet(f"{self.path}/log")

    def _append(self, batch_id: str, replaces: list[str]) -> None:
        self.spark.createDataFrame([(batch_id, replaces)], LOG_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def _write_delta(self, batch_id: str, sums: DataFrame) -> None:
        sums.select(*KEYS, "n_docs", "n_tokens").write.mode("overwrite").parquet(f"{self.path}/deltas/{batch_id}")

    def batches(self) -> list[str]:
        """Ids whose deltas make up the totals (one id per committed batch or compaction)."""
        rows = self._log().collect()
        gone = {b for r in rows for b in r.replaces}
        return sorted({r.batch_id for r in rows} - gone)

    def committed(self, batch_id: str) -> bool:
        return self._log().where(F.col("batch_id") == batch_id).limit(1).count() > 0

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch; False, and nothing changes, if it is committed already."""
        if self.committed(batch_id):
            return False
        self._write_delta(batch_id, signed_sums(changes))
        self._append(batch_id, [])
        return True

    def _deltas(self, ids: list[str]) -> DataFrame:
        if not ids:
            return self.spark.createDataFrame([], DELTA_SCHEMA)
        return self.spark.read.schema(DELTA_SCHEMA).parquet(*(f"{self.path}/deltas/{b}" for b in ids))

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, n_docs, n_tokens`` over the committed batches."""
        sums = self._deltas(self.batches()).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def compact(self, batch_id: str) -> None:
        """Replace the committed deltas by their sum. Their ids stay committed."""
        if self.committed(batch_id):
            return
        ids = self.batches()
        self._write_delta(batch_id, self.totals())
        self._append(batch_id, ids)
