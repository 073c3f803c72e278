"""Quality classifier: a factorisation machine on hashed words, structure statistics
and metadata.

Features are native columns: words hashed into ``HASH_BUCKETS`` term frequencies of
length 1, then shares that describe the text's structure and its recorded length. The
machine (``pyspark.ml`` FMClassifier: bias, linear weights, low-rank factors) is fitted
by Spark on a bounded sample of labelled rows. ``scores`` evaluates it in time linear
in the non-zero features, since the sum of all pairwise interactions is, for each
factor, half of (square of the sum) minus (sum of the squares).

Defined results: null or empty text has the features of an empty text and is scored
like any other; with no usable label every score is 0.5, and with one class only it is
that class; several labels of a document count as their mean, rounded up; repeated
rows are scored one by one; a null doc_id counts as the empty text for the fold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import FMClassifier, FMClassificationModel
from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorlytics.llm.common import stored, text_of, words_of

HASH_BUCKETS = 2048
#: The fit takes about this many labelled rows at most, drawn by a hash of doc_id.
MAX_FIT_ROWS = 20_000
THRESHOLD = 0.3
FOLDS = 5
FIT = {"factorSize": 4, "maxIter": 80, "stepSize": 0.05, "regParam": 1e-5, "initStd": 0.01, "solver": "adamW", "seed": 17}


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0: such a row's label is never learnt."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def structure(text: Column, words: Column, n_chars: Column) -> dict[str, Column]:
    """Shares in 0..1 (sizes on a log scale) that describe how a text is built."""
    length, n = F.length(text), F.size(words)

    def share(count: Column, of: Column) -> Column:
        return F.coalesce(count / F.nullif(of, F.lit(0)), F.lit(0.0)).cast("double")

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern))

    return {
        "f_upper": share(count("[A-Z]"), length), "f_digit": share(count("[0-9]"), length),
        "f_symbol": share(count(r"[#$%&*|<>{}\[\]\\^~=+@/]"), length), "f_shout": share(count("!"), n), "f_stop": share(count(r"[.?,;:]"), n),
        "f_symbol_words": share(count(r"[#$%&*|!]{2,}(?=\s|$)"), n), "f_bars": share(count(r"\|"), n),
        "f_lines": share(count("\n"), n), "f_distinct": share(F.size(F.array_distinct(words)), n),
        "f_word_length": F.least(share(length, n) / 20, F.lit(1.0)), "f_words": F.log1p(n.cast("double")) / 12,
        "f_recorded_chars": F.log1p(F.greatest(F.coalesce(n_chars, length), F.lit(0)).cast("double")) / 14,
    }


def featured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` plus vector ``features``; reads ``text`` and, if there, ``n_chars``."""
    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    base = docs.select(*keep, text_of().alias("fm_text"), n_chars.alias("fm_chars")).withColumn("fm_words", words_of(F.col("fm_text")))
    stats = structure(F.col("fm_text"), F.col("fm_words"), F.col("fm_chars"))
    made = base.withColumns(stats)
    made = HashingTF(inputCol="fm_words", outputCol="fm_tf", numFeatures=HASH_BUCKETS).transform(made)
    made = Normalizer(inputCol="fm_tf", outputCol="fm_unit").transform(made)
    made = VectorAssembler(inputCols=["fm_unit", *stats], outputCol="features").transform(made)
    return made.select(*keep, "features")


@dataclass
class Quality:
    """A fitted machine, or the constant score of a degenerate fit."""

    model: FMClassificationModel | None
    constant: float


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """``features, label`` of labelled rows outside the held-out fold; at most about ``max_rows``."""
    known = (labels.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.ceil(F.avg("quality")).cast("double").alias("label")))
    known = stored(known, "quality-labels")
    share = min(1.0, max_rows / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    # drawn has at most about max_rows rows of 16 bytes: a proven bound for the broadcast
    rows = docs.join(F.broadcast(drawn.select(F.col("doc_id").alias("fm_id"), "label")), docs["doc_id"] == F.col("fm_id"))
    return featured(rows, ["label"])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS, **params) -> Quality:
    rows = stored(training_rows(docs, labels, max_rows), "quality-features")
    seen = rows.agg(F.avg("label").alias("mean"), F.count_distinct("label").alias("classes")).first()
    if seen.classes < 2:
        return Quality(None, 0.5 if seen.mean is None else float(seen.mean))
    return Quality(FMClassifier(featuresCol="features", labelCol="label", **{**FIT, **params}).fit(rows), float(seen.mean))


def scores(docs: DataFrame, quality: Quality, keep: list[str]) -> DataFrame:
    """``keep`` plus ``score`` (0 to 1, higher: label 1 likelier)."""
    if quality.model is None:
        return docs.select(*keep, F.lit(quality.constant).alias("score"))
    made = quality.model.transform(featured(docs, keep))
    return made.select(*keep, vector_to_array("probability")[1].alias("score"))
