"""Registered evaluation queries over deterministic labelled scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from motorlytics import oracle as O
from motorlytics import schema as S
from motorlytics.operators import evaluation as EV
from motorlytics.operators import features as FE
from motorlytics.sources import fixtures as FX
from motorlytics.registry.core import register, stage


# ---------------------------------------------------------------------------
# M — evaluation over deterministic labelled scores
# ---------------------------------------------------------------------------

MODEL_A, MODEL_B = "boosted_trees", "random_forest"


def _labelled_sql(mult) -> str:
    w = [f"1e0 + (o_custkey * {m}) % 97" for m in mult]
    tot = "(" + " + ".join(f"w{i}" for i in range(4)) + ")"
    return f"""
SELECT o_custkey AS id, CAST((o_custkey * 7 + o_custkey // 3) % 4 AS INTEGER) AS label,
  CAST(CASE WHEN w0 >= w1 AND w0 >= w2 AND w0 >= w3 THEN 0 WHEN w1 >= w2 AND w1 >= w3 THEN 1 WHEN w2 >= w3 THEN 2 ELSE 3 END
       AS INTEGER) AS prediction,
  [w0 / {tot}, w1 / {tot}, w2 / {tot}, w3 / {tot}] AS prob
FROM (SELECT o_custkey, {', '.join(f'{e} AS w{i}' for i, e in enumerate(w))} FROM (SELECT DISTINCT o_custkey FROM orders))
"""


O.add_cte("labelled", _labelled_sql(FX.PRIMARY_MULTIPLIERS))
O.add_cte("labelled_b", _labelled_sql(FX.SECONDARY_MULTIPLIERS))


def _per_class_sql(src: str) -> str:
    return f"""
SELECT cls, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0e0 END AS precision,
  CASE WHEN support > 0 THEN tp / support ELSE 0e0 END AS recall,
  CASE WHEN support + predicted > 0 THEN 2e0 * tp / (support + predicted) ELSE 0e0 END AS f1,
  CAST(support AS BIGINT) AS support, CAST(tp AS BIGINT) AS tp
FROM (SELECT coalesce(s.cls, p.cls) AS cls, coalesce(s.support, 0) AS support, coalesce(p.predicted, 0) AS predicted,
             coalesce(t.tp, 0) AS tp
      FROM (SELECT label AS cls, count(*) AS support FROM {src} GROUP BY label) s
      FULL JOIN (SELECT prediction AS cls, count(*) AS predicted FROM {src} GROUP BY prediction) p ON s.cls = p.cls
      LEFT JOIN (SELECT label AS cls, count(*) AS tp FROM {src} WHERE label = prediction GROUP BY label) t
        ON t.cls = coalesce(s.cls, p.cls))
"""


O.add_cte("per_class", _per_class_sql("labelled"))
O.add_cte("per_class_b", _per_class_sql("labelled_b"))


def _summary_sql(pc: str) -> str:
    r = lambda e: O.np_round_sql(e, EV.METRIC_DIGITS)
    return (f"SELECT {r('sum(tp) / sum(support)')} AS accuracy, {r('avg(f1)')} AS f1_macro, "
            f"{r('sum(f1 * support) / sum(support)')} AS f1_weighted, "
            f"{r('sum(precision * support) / sum(support)')} AS precision_weighted, "
            f"{r('sum(recall * support) / sum(support)')} AS recall_weighted FROM {pc}")


def _score_counts_sql(src: str) -> str:
    return (f"SELECT cls, score, count(*) FILTER (WHERE label = cls) AS pos, count(*) FILTER (WHERE label <> cls) AS neg "
            f"FROM (SELECT label, unnest(prob) AS score, unnest([0, 1, 2, 3]) AS cls FROM {src}) GROUP BY cls, score")


O.add_cte("score_counts", _score_counts_sql("labelled"))
O.add_cte("score_counts_b", _score_counts_sql("labelled_b"))


def _auc_class_sql(sc: str) -> str:
    return f"""
SELECT cls, sum(pos) AS positives, sum(neg) AS negatives,
  CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (neg_le - 0.5e0 * neg)) / (sum(pos) * sum(neg)) END AS auc
FROM (SELECT *, sum(neg) OVER (PARTITION BY cls ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_le
      FROM {sc}) GROUP BY cls"""


O.add_cte("auc_class", _auc_class_sql("score_counts"))
O.add_cte("auc_class_b", _auc_class_sql("score_counts_b"))


def _auc_sql(ac: str) -> str:
    return (f"SELECT CASE WHEN count(*) FILTER (WHERE auc IS NULL) = 0 AND count(*) = 4 "
            f"THEN {O.np_round_sql('sum(auc * positives) / sum(positives)', EV.METRIC_DIGITS)} ELSE 0e0 END "
            f"AS roc_auc_weighted FROM {ac}")


O.add_cte("eval_a", f"SELECT * FROM ({_summary_sql('per_class')}) CROSS JOIN ({_auc_sql('auc_class')})")
O.add_cte("eval_b", f"SELECT * FROM ({_summary_sql('per_class_b')}) CROSS JOIN ({_auc_sql('auc_class_b')})")


def _labelled(spark, sf_dir):
    return FX.labelled_models(spark, sf_dir, {MODEL_A: FX.PRIMARY_MULTIPLIERS, MODEL_B: FX.SECONDARY_MULTIPLIERS})


def confusion(spark, sf_dir):
    """Confusion table of both stand-in models: one scan, one aggregate; every query of
    M6, M8, M9, M14 and M15 projects it."""
    return stage(spark, sf_dir, "confusion-table", lambda: EV.confusion_table(_labelled(spark, sf_dir), ("model",)))


def score_prefix(spark, sf_dir):
    """Score histogram of both stand-in models, stored, then prefixed and stored; M7 and
    M11 read it."""
    histogram = stage(spark, sf_dir, "score-histogram", lambda: EV.score_histogram(_labelled(spark, sf_dir), ("model",)))
    return stage(spark, sf_dir, "score-prefix", lambda: EV.prefixed(histogram))


def of_model(df, model):
    return df.where(F.col("model") == model).drop("model")


def of_primary(df):
    return of_model(df, MODEL_A)


for _name, _metric in [("m06a_accuracy", "accuracy"), ("m06b_f1_macro", "f1_macro"), ("m06c_f1_weighted", "f1_weighted"),
                       ("m06d_precision_weighted", "precision_weighted"), ("m06e_recall_weighted", "recall_weighted")]:
    register(_name, O.with_ctes(f"SELECT {_metric} FROM eval_a", "eval_a"))(
        (lambda m: (lambda spark, sf_dir: EV.metrics(of_primary(confusion(spark, sf_dir))).select(m)))(_metric))


@register("m07_roc_auc_weighted", O.with_ctes("SELECT roc_auc_weighted FROM eval_a", "eval_a"))
def m07(spark, sf_dir):
    return EV.roc_auc_weighted(of_primary(score_prefix(spark, sf_dir)))


@register("m07_roc_auc_per_class", O.with_ctes(
    f"SELECT cls, CAST(positives AS BIGINT) AS positives, CAST(negatives AS BIGINT) AS negatives, "
    f"{O.np_round_sql('auc', 12)} AS auc FROM auc_class", "auc_class"))
def m07_per_class(spark, sf_dir):
    a = EV.auc_per_class(of_primary(score_prefix(spark, sf_dir)))
    return a.withColumn("auc", FE.np_round(F.col("auc"), 12))


_LABEL_NAME_CASE = "CASE cls " + " ".join(f"WHEN {k} THEN {O._q(v)}" for k, v in sorted(S.RISK_LABELS.items())) + " END"


def _report_sql() -> str:
    r = lambda e: O.np_round_sql(e, EV.METRIC_DIGITS)
    return O.with_ctes(f"""
SELECT cls AS row_order, {_LABEL_NAME_CASE} AS row_label, {r('precision')} AS precision, {r('recall')} AS recall,
       {r('f1')} AS f1, support FROM per_class
UNION ALL SELECT 4, 'accuracy', NULL, NULL, {r('sum(tp) / sum(support)')}, CAST(sum(support) AS BIGINT) FROM per_class
UNION ALL SELECT 5, 'macro avg', {r('avg(precision)')}, {r('avg(recall)')}, {r('avg(f1)')}, CAST(sum(support) AS BIGINT)
  FROM per_class
UNION ALL SELECT 6, 'weighted avg', {r('sum(precision * support) / sum(support)')}, {r('sum(recall * support) / sum(support)')},
  {r('sum(f1 * support) / sum(support)')}, CAST(sum(support) AS BIGINT) FROM per_class""", "per_class")


@register("m08_classification_report", _report_sql())
def m08(spark, sf_dir):
    return EV.report(of_primary(confusion(spark, sf_dir)))


@register("m09_confusion_matrix", O.with_ctes(
    "SELECT a.k AS actual, " + ", ".join(
        f"CAST(count(*) FILTER (WHERE l.prediction = {k}) AS BIGINT) AS predicted_{k}" for k in range(4)) +
    " FROM (VALUES (0), (1), (2), (3)) a(k) LEFT JOIN labelled l ON l.label = a.k GROUP BY a.k", "labelled"))
def m09(spark, sf_dir):
    return EV.matrix(of_primary(confusion(spark, sf_dir)))


@register("m11_roc_curve_points", O.with_ctes("""
SELECT cls, score AS threshold, neg_ge / n_all AS fpr, pos_ge / p_all AS tpr FROM (
  SELECT cls, score,
    sum(pos) OVER (PARTITION BY cls ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pos_ge,
    sum(neg) OVER (PARTITION BY cls ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_ge,
    sum(pos) OVER (PARTITION BY cls) AS p_all, sum(neg) OVER (PARTITION BY cls) AS n_all FROM score_counts)
UNION ALL SELECT DISTINCT cls, 'inf'::DOUBLE, 0e0, 0e0 FROM score_counts""", "score_counts"))
def m11(spark, sf_dir):
    return EV.roc_curve_points(of_primary(score_prefix(spark, sf_dir)))


def _comparison_sql() -> str:
    parts = []
    for i, m in enumerate(EV.COMPARED_METRICS):
        parts.append(f"SELECT {i} AS metric_order, '{m}' AS metric, a.{m} AS {MODEL_A}, b.{m} AS {MODEL_B} "
                     f"FROM eval_a a CROSS JOIN eval_b b")
    return O.with_ctes(" UNION ALL ".join(parts), "eval_a", "eval_b")


def _evals(spark, sf_dir):
    return EV.evaluate(confusion(spark, sf_dir), score_prefix(spark, sf_dir))


@register("m14_model_comparison", _comparison_sql())
def m14(spark, sf_dir):
    return EV.model_comparison(_evals(spark, sf_dir), [MODEL_A, MODEL_B])


@register("m15_model_selection", O.with_ctes(
    f"SELECT arg_max(model, (f1_weighted, CASE WHEN model = '{MODEL_A}' THEN 1 ELSE 0 END)) AS selected_model, "
    f"max(f1_weighted) AS f1_weighted FROM (SELECT '{MODEL_A}' AS model, f1_weighted FROM eval_a "
    f"UNION ALL SELECT '{MODEL_B}', f1_weighted FROM eval_b)", "eval_a", "eval_b"))
def m15(spark, sf_dir):
    return EV.select_model(_evals(spark, sf_dir), MODEL_A)


