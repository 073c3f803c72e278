"""Model evaluation (M6-M9, M11, M14, M15) as Spark aggregations.

Input rows carry ``label`` (int), ``prediction`` (int) and, for ranking
statistics, ``prob`` (array<double>, one entry per class); further columns such
as ``model`` and ``fold`` may tell several evaluations apart (``by``).

Two small tables are aggregated from them, one exchange each, and everything
else is a projection of these:

* the confusion table: one row per ``by`` group with a count for each of the
  classes^2 cells - metrics, per-class report, matrix, fold scores and the
  choice between models;
* the score histogram: positives and negatives per (class, score). It is
  mergeable, and prefixed once in score order (range-bucketed, no window over
  the whole table) it gives both AUC and ROC points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlytics import schema as S
from motorlytics.functions.expr import count_if, np_round
from motorlytics.plans.ordering import global_prefix

N_CLASSES = len(S.RISK_LABELS)
CLASSES = range(N_CLASSES)
METRIC_DIGITS = 4


def _cell(label: int, prediction: int) -> str:
    return f"n_{label}_{prediction}"


def _total(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


# the confusion table ---------------------------------------------------------
def confusion_table(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by`` columns and ``n_<label>_<prediction>`` counts: one aggregate, combined
    map-side. Rows without a label or prediction of a class count nowhere."""
    label, prediction = F.col("label"), F.col("prediction")
    return df.groupBy(*by).agg(*[count_if((label == k) & (prediction == j)).alias(_cell(k, j)) for k in CLASSES for j in CLASSES])


def _by(table: DataFrame) -> list[str]:
    cells = {_cell(k, j) for k in CLASSES for j in CLASSES}
    return [c for c in table.columns if c not in cells]


def _with_class_stats(table: DataFrame) -> DataFrame:
    """Adds tp, support and predicted counts, then precision, recall and F1 of each class."""
    out = table.withColumns({
        **{f"tp{k}": F.col(_cell(k, k)) for k in CLASSES},
        **{f"sup{k}": _total([F.col(_cell(k, j)) for j in CLASSES]) for k in CLASSES},
        **{f"pred{k}": _total([F.col(_cell(j, k)) for j in CLASSES]) for k in CLASSES},
    })
    out = out.withColumns({f"seen{k}": F.col(f"sup{k}") + F.col(f"pred{k}") for k in CLASSES})
    ratio = lambda top, bottom: F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))
    return out.withColumns({
        **{f"p{k}": ratio(F.col(f"tp{k}"), F.col(f"pred{k}")) for k in CLASSES},
        **{f"r{k}": ratio(F.col(f"tp{k}"), F.col(f"sup{k}")) for k in CLASSES},
        **{f"f{k}": ratio(F.lit(2.0) * F.col(f"tp{k}"), F.col(f"seen{k}")) for k in CLASSES},
        "n": _total([F.col(f"sup{k}") for k in CLASSES]),
        "present": _total([F.when(F.col(f"seen{k}") > 0, 1).otherwise(0) for k in CLASSES]),
    })


def _mean(stat: str) -> Column:
    """Mean over the classes that occur as a label or a prediction."""
    return F.when(F.col("present") > 0, _total([F.when(F.col(f"seen{k}") > 0, F.col(f"{stat}{k}")).otherwise(F.lit(0.0)) for k in CLASSES]) / F.col("present"))


def _weighted(stat: str) -> Column:
    return F.when(F.col("n") > 0, _total([F.col(f"{stat}{k}") * F.col(f"sup{k}") for k in CLASSES]) / F.col("n"))


def _accuracy() -> Column:
    return F.when(F.col("n") > 0, _total([F.col(f"tp{k}") for k in CLASSES]) / F.col("n"))


# M6a-e ---------------------------------------------------------------------
def metrics(table: DataFrame) -> DataFrame:
    """accuracy, macro F1, weighted F1 / precision / recall (4 dp) of each row of a
    confusion table."""
    values = {"accuracy": _accuracy(), "f1_macro": _mean("f"), "f1_weighted": _weighted("f"),
              "precision_weighted": _weighted("p"), "recall_weighted": _weighted("r")}
    return _with_class_stats(table).select(*_by(table), *[np_round(v, METRIC_DIGITS).alias(c) for c, v in values.items()])


def summary_metrics(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return metrics(confusion_table(df, by))


# M8 ------------------------------------------------------------------------
def report(table: DataFrame) -> DataFrame:
    """Per-class rows, then accuracy, macro and weighted averages, of each row of a
    confusion table."""
    null = F.lit(None).cast("double")

    def row(order: int, label: str, *values: Column) -> Column:
        names = ["precision", "recall", "f1", "support"]
        return F.struct(F.lit(order).alias("row_order"), F.lit(label).alias("row_label"), *[v.alias(c) for c, v in zip(names, values)])

    classes = [F.when(F.col(f"seen{k}") > 0, row(k, S.RISK_LABELS[k], *(F.col(f"{s}{k}") for s in "prf"), F.col(f"sup{k}"))) for k in CLASSES]
    overall = [row(N_CLASSES, "accuracy", null, null, _accuracy(), F.col("n")),
               row(N_CLASSES + 1, "macro avg", _mean("p"), _mean("r"), _mean("f"), F.col("n")),
               row(N_CLASSES + 2, "weighted avg", _weighted("p"), _weighted("r"), _weighted("f"), F.col("n"))]
    rows = F.filter(F.array(*classes, *overall), lambda r: r.isNotNull())
    out = _with_class_stats(table).select(*_by(table), F.inline(rows))
    return out.withColumns({c: np_round(F.col(c), METRIC_DIGITS) for c in ("precision", "recall", "f1")})


def classification_report(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return report(confusion_table(df, by))


# M9 ------------------------------------------------------------------------
def matrix(table: DataFrame) -> DataFrame:
    """actual x predicted counts, all classes^2 cells, of each row of a confusion table."""
    rows = [F.struct(F.lit(k).alias("actual"), *[F.col(_cell(k, j)).alias(f"predicted_{j}") for j in CLASSES]) for k in CLASSES]
    return table.select(*_by(table), F.inline(F.array(*rows)))


def confusion_matrix(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return matrix(confusion_table(df, by))


# M7 / M11 ------------------------------------------------------------------
def score_histogram(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(``by``, class, score) -> positives, negatives, for one-vs-rest per class."""
    long = df.select(*by, "label", F.posexplode("prob").alias("cls", "score"))
    return long.groupBy(*by, "cls", "score").agg(count_if(F.col("label") == F.col("cls")).alias("pos"), count_if(F.col("label") != F.col("cls")).alias("neg"))


def merge_histograms(a: DataFrame, b: DataFrame) -> DataFrame:
    """The histogram of both inputs together."""
    keys = [c for c in a.columns if c not in ("pos", "neg")]
    return a.unionByName(b).groupBy(*keys).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def prefixed(histogram: DataFrame) -> DataFrame:
    """``pos_le`` and ``neg_le``: positives and negatives up to each score of its class.
    Range buckets are sampled from the scores themselves, so a crowded score range
    does not become one task. Store the histogram first: it is read more than once."""
    groups = [c for c in histogram.columns if c not in ("score", "pos", "neg")]
    return global_prefix(histogram, ["score"], partition=groups, sums={"pos_le": F.col("pos"), "neg_le": F.col("neg")})


def auc_per_class(prefix: DataFrame) -> DataFrame:
    """One-vs-rest AUC per class of a prefixed histogram (ties count one half), with
    positives and negatives."""
    groups = [c for c in prefix.columns if c not in ("score", "pos", "neg", "pos_le", "neg_le")]
    area = F.sum(F.col("pos") * (F.col("neg_le") - F.lit(0.5) * F.col("neg")))
    both = prefix.groupBy(*groups).agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), area.alias("_area"))
    return both.select(*groups, "positives", "negatives", F.when((F.col("positives") > 0) & (F.col("negatives") > 0),
                                                                 F.col("_area") / (F.col("positives") * F.col("negatives"))).alias("auc"))


def roc_auc_weighted(prefix: DataFrame) -> DataFrame:
    """Weighted by positives; 0.0 when some class has no positives or no negatives."""
    per_class = auc_per_class(prefix)
    by = [c for c in per_class.columns if c not in ("cls", "positives", "negatives", "auc")]
    agg = per_class.groupBy(*by).agg((F.sum(F.col("auc") * F.col("positives")) / F.sum("positives")).alias("_w"), count_if(F.col("auc").isNull()).alias("_undefined"),
                                     F.count(F.lit(1)).alias("_classes"))
    whole = (F.col("_undefined") == 0) & (F.col("_classes") == N_CLASSES)
    return agg.select(*by, F.when(whole, np_round(F.col("_w"), METRIC_DIGITS)).otherwise(F.lit(0.0)).alias("roc_auc_weighted"))


def roc_curve_points(prefix: DataFrame) -> DataFrame:
    """Per class: (threshold, fpr, tpr) at every distinct score of a prefixed histogram,
    plus the origin at threshold +inf."""
    groups = [c for c in prefix.columns if c not in ("score", "pos", "neg", "pos_le", "neg_le")]
    totals = prefix.groupBy(*groups).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    at_least = lambda total, kind: (F.col(total) - F.col(f"{kind}_le") + F.col(kind)).cast("double")
    points = prefix.join(totals, groups).select(*groups, F.col("score").alias("threshold"), F.try_divide(at_least("_n", "neg"), F.col("_n")).alias("fpr"),
                                                F.try_divide(at_least("_p", "pos"), F.col("_p")).alias("tpr"))
    return points.unionByName(totals.select(*groups, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")))


def evaluate(table: DataFrame, prefix: DataFrame) -> DataFrame:
    """M6 + M7: one row per group of the two tables."""
    by = _by(table)
    left, right = metrics(table), roc_auc_weighted(prefix)
    return left.join(right, by) if by else left.crossJoin(right)


# M14 / M15 -----------------------------------------------------------------
COMPARED_METRICS = ["accuracy", "f1_weighted", "precision_weighted", "recall_weighted", "roc_auc_weighted"]


def model_comparison(evals: DataFrame, models: list[str]) -> DataFrame:
    """metric x model table of an evaluation with a ``model`` column."""
    arr = F.array(*[F.struct(F.lit(i).alias("metric_order"), F.lit(m).alias("metric"), F.col(m).alias("value"))
                    for i, m in enumerate(COMPARED_METRICS)])
    long = evals.select("model", F.inline(arr))
    return long.groupBy("metric_order", "metric").agg(*[F.max(F.when(F.col("model") == m, F.col("value"))).alias(m) for m in models])


def select_model(evals: DataFrame, preferred: str) -> DataFrame:
    """Model with the higher weighted F1; a tie goes to ``preferred``."""
    key = F.struct(F.col("f1_weighted"), (F.col("model") == preferred).cast("int"))
    return evals.agg(F.max_by("model", key).alias("selected_model"), F.max("f1_weighted").alias("f1_weighted"))


# M10 -----------------------------------------------------------------------
def fold_scores(table: DataFrame) -> DataFrame:
    """Weighted F1 of each (model, fold) row of a confusion table, with the model's mean
    and population deviation over its folds."""
    per_fold = metrics(table).select("model", "fold", "f1_weighted")
    stats = per_fold.groupBy("model").agg(np_round(F.avg("f1_weighted"), METRIC_DIGITS).alias("cv_mean"), np_round(F.stddev_pop("f1_weighted"), METRIC_DIGITS).alias("cv_std"))
    return per_fold.join(stats, "model")
