"""Model tests: fitted models beat the majority class; probabilities are
proper distributions; persistence round-trips."""

from pyspark.sql import functions as F

from motorlytics.operators import evaluation as EV
from motorlytics.operators import features as FE
from motorlytics.operators import training as TR
from motorlytics.sources.fixtures import requisitions
from motorlytics.sources.manifest import Manifest
from tests.conftest import SF_SMALL


def _split(spark):
    eng, _ = FE.engineer(requisitions(spark, SF_SMALL))
    split = TR.materialize(TR.stratified_split(TR.prepare(eng)))
    return split.where(~F.col("is_test")).drop("is_test"), split.where(F.col("is_test")).drop("is_test")


def test_forest_beats_majority_and_probabilities_sum_to_one(spark):
    train, test = _split(spark)
    model = TR.fit_random_forest(train, {"numTrees": 10, "maxDepth": 5})
    pred = TR.predict(model, test)
    f1 = EV.summary_metrics(pred).first().f1_weighted
    majority = test.groupBy("label").count().orderBy(F.desc("count")).first()["count"] / test.count()
    # weighted F1 of always predicting the majority class is at most its share
    assert f1 > majority
    sums = pred.select(F.aggregate("prob", F.lit(0.0), lambda a, b: a + b).alias("s"))
    assert sums.where(F.abs(F.col("s") - 1.0) > 1e-9).count() == 0
    imp = TR.feature_importance(spark, model).collect()
    assert len(imp) == 18 and abs(sum(r.importance for r in imp) - 1.0) < 1e-6
    assert sorted(r["rank"] for r in imp) == list(range(1, 19))


def _trees(model):
    return [t.toDebugString.split("\n", 1)[1] for t in model.trees]


def test_forest_keeps_node_ids_where_they_fit_and_grows_the_same_trees(spark, monkeypatch):
    rows = spark.range(1200).select("id", *[F.pmod(F.xxhash64("id", F.lit(c)), F.lit(97)).cast("double").alias(c) for c in "abc"])
    train = TR.materialize(rows.withColumn("label", (F.pmod(F.col("a") + F.col("b") * F.col("c"), F.lit(4))).cast("int")).coalesce(1))
    params = {"numTrees": 20, "maxDepth": 7, "maxMemoryInMB": 1}  # some levels in several groups
    kept = TR.fit_random_forest(train, params, list("abc"))
    walked = TR.fit_random_forest(train, {**params, "cacheNodeIds": False}, list("abc"))
    assert kept.getCacheNodeIds() and not walked.getCacheNodeIds()
    assert _trees(kept) == _trees(walked)
    assert TR.keeps_node_ids(spark, 1200, 20) and not TR.keeps_node_ids(spark, 10**9, 300)
    monkeypatch.setattr(TR, "storage_bytes", lambda s: 2 * 12 * 1200 * 20 - 1)
    assert not TR.fit_random_forest(train, params, list("abc")).getCacheNodeIds()


def test_a_model_named_alone_is_fitted_one_fold_at_a_time(spark):
    import threading
    train, _ = _split(spark)
    running, most, lock = {"a": 0, "b": 0}, {"a": 0, "b": 0}, threading.Lock()

    def fit(name, meet):
        def run(rows):
            with lock:
                running[name] += 1
                most[name] = max(most[name], running[name])
            if meet:
                together.wait(60)
            model = TR.fit_random_forest(rows, {"numTrees": 1, "maxDepth": 2})
            with lock:
                running[name] -= 1
            return model
        return run
    together = threading.Barrier(3)
    rows = TR.cross_validate(train, {"a": fit("a", False), "b": fit("b", True)}, k=3, alone=("a",)).collect()
    assert most == {"a": 1, "b": 3} and len(rows) == 6


def test_both_models_are_fitted_side_by_side(spark, monkeypatch):
    import threading
    from motorlytics.registry import training as RT
    together = threading.Barrier(2)

    def fit(name):
        def run(rows):
            together.wait(60)
            return name
        return run
    monkeypatch.setattr(RT, "_MODELS", {(spark.sparkContext.applicationId, "x", "split"): (None, None)})
    monkeypatch.setattr(TR, "fit_boosted_trees", fit("boosted"))
    monkeypatch.setattr(TR, "fit_random_forest", fit("forest"))
    assert RT.trained_both(spark, "x") == {"gbt": "boosted", "rf": "forest"}


def test_boosting_gets_its_rows_in_equal_parts(spark, monkeypatch):
    seen, fit = [], TR.OneVsRest.fit
    monkeypatch.setattr(TR.OneVsRest, "fit", lambda self, data: seen.append(data) or fit(self, data))
    monkeypatch.setattr(TR, "BOOST_ROWS", (100, 250))
    # nine tenths of the rows lie in one of four parts
    ids = spark.range(900, numPartitions=1).union(spark.range(900, 1000, numPartitions=3))
    rows = ids.select("id", F.pmod(F.xxhash64("id"), F.lit(97)).cast("double").alias("a")).withColumn("label", (F.col("a") % 2).cast("int"))
    train = TR.materialize(rows)
    TR.fit_boosted_trees(train, {"maxIter": 1, "maxDepth": 2}, ["a"], parallelism=2)
    sizes = [r["count"] for r in seen[0].groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == max(spark.sparkContext.defaultParallelism // 2, 4) and max(sizes) <= 1.1 * 1000 / len(sizes) + 10
    assert sorted(r["id"] for r in seen[0].select("id").collect()) == list(range(1000))
    # a table too small for two parts is not dealt again
    few = train.where("id < 150")
    assert TR.spread_boosting(few, 150, 2) is few


def test_boosted_one_vs_rest_probabilities(spark):
    train, test = _split(spark)
    model = TR.fit_boosted_trees(train, {"maxIter": 3, "maxDepth": 3})
    pred = TR.predict(model, test)
    # the same classes as the library's own one-vs-rest transform
    own = model.transform(TR.assembler().transform(test)).select("requisition_id", F.col("prediction").cast("int").alias("own"))
    assert pred.join(own, "requisition_id").where("prediction <> own").count() == 0
    row = pred.select(F.size("prob").alias("n"), F.aggregate("prob", F.lit(0.0), lambda a, b: a + b).alias("s")).first()
    assert row.n == 4 and abs(row.s - 1.0) < 1e-9
    acc = EV.summary_metrics(pred).first().accuracy
    assert 0.0 <= acc <= 1.0


def test_staged_losses_end_at_the_models_own(spark):
    """The last round's losses equal those of the model's raw and normalised predictions,
    for each split; those of every round equal the library's own evaluation."""
    import numpy as np
    from pyspark.ml.functions import vector_to_array
    train, test = _split(spark)
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    model = TR.fit_boosted_trees(train, {"maxIter": 6, "maxDepth": 4})
    got = {(r["split"], r["round"]): r for r in TR.staged_losses(model, both, "split").collect()}
    assert len(got) == 12
    wide = TR.assembler().transform(both)
    for k, m in enumerate(model.models):
        wide = m.copy().setPredictionCol("").setProbabilityCol("").setRawPredictionCol(f"raw{k}").transform(wide)
    own = wide.select("split", "label", *[vector_to_array(f"raw{k}")[1].alias(f"m{k}") for k in range(4)]).toPandas()
    for split, rows in own.groupby("split"):
        loss = sum(2 * np.log1p(np.exp(-2 * np.where(rows["label"] == k, 1, -1) * rows[f"m{k}"])) for k in range(4)).mean()
        assert abs(got[(split, 6)]["logloss"] - loss) < 1e-9 and got[(split, 6)]["n"] == len(rows)
    prob = TR.predict(model, both).select("split", "label", "prob").toPandas()
    for split, rows in prob.groupby("split"):
        want = -np.mean([np.log(p[y]) for y, p in zip(rows["label"], rows["prob"])])
        assert abs(got[(split, 6)]["mlogloss"] - want) < 1e-9
    each = []
    for k, m in enumerate(model.models):
        named = train.withColumn(m.getLabelCol(), (F.col("label") == k).cast("double"))
        each.append(m.evaluateEachIteration(TR.assembler().transform(named)))
    for i in range(6):
        assert abs(got[("train", i + 1)]["logloss"] - sum(e[i] for e in each)) < 1e-9


def test_cross_validation_of_two_models(spark):
    train, _ = _split(spark)
    fits = {"a": lambda d: TR.fit_random_forest(d, {"numTrees": 4, "maxDepth": 3}), "b": lambda d: TR.fit_boosted_trees(d, {"maxIter": 2, "maxDepth": 2})}
    rows = TR.cross_validate(train, fits, k=3).collect()
    assert sorted((r["model"], r["fold"]) for r in rows) == [(m, f) for m in "ab" for f in range(3)]
    for m in "ab":
        scores = [r["f1_weighted"] for r in rows if r["model"] == m]
        assert {r["cv_mean"] for r in rows if r["model"] == m} == {round(sum(scores) / 3, 4)}


def _labelled(spark, n=400):
    k = F.col("id")
    return spark.range(n).select((k % 2).cast("string").alias("model"), (k * 7 % 4).cast("int").alias("label"), (k * 11 % 3).cast("int").alias("prediction"),
                                 F.array(*[((k * m) % 19 / 19.0) for m in (3, 5, 7, 11)]).alias("prob"))


def test_metrics_from_the_confusion_table_equal_brute_force(spark):
    df = _labelled(spark)
    table = EV.confusion_table(df, ("model",))
    got = {r["model"]: r for r in EV.metrics(table).collect()}
    reports = EV.report(table).collect()
    for model, rows in df.toPandas().groupby("model"):
        y, p = list(rows["label"]), list(rows["prediction"])
        stats = {}
        for c in sorted(set(y) | set(p)):
            tp, sup, pred = sum(a == b == c for a, b in zip(y, p)), y.count(c), p.count(c)
            stats[c] = (tp / pred if pred else 0, tp / sup if sup else 0, 2 * tp / (sup + pred), sup)
        n = len(y)
        want = {"accuracy": sum(a == b for a, b in zip(y, p)) / n, "f1_macro": sum(s[2] for s in stats.values()) / len(stats),
                "f1_weighted": sum(s[2] * s[3] for s in stats.values()) / n, "precision_weighted": sum(s[0] * s[3] for s in stats.values()) / n,
                "recall_weighted": sum(s[1] * s[3] for s in stats.values()) / n}
        assert all(abs(got[model][c] - v) <= 5e-5 + 1e-12 for c, v in want.items())
        per = {r["row_order"]: r for r in reports if r["model"] == model}
        assert sorted(per) == sorted([*stats, 4, 5, 6]) and all(per[c]["support"] == s[3] for c, s in stats.items())
        cells = {r["actual"]: r for r in EV.matrix(table).where(F.col("model") == model).collect()}
        assert all(cells[a][f"predicted_{b}"] == sum(x == a and z == b for x, z in zip(y, p)) for a in range(4) for b in range(4))


def test_metrics_of_nothing(spark):
    table = EV.confusion_table(_labelled(spark, 0))
    assert tuple(EV.metrics(table).first()) == (None,) * 5 and EV.matrix(table).count() == 4
    assert EV.metrics(EV.confusion_table(_labelled(spark, 0), ("model",))).count() == 0


def test_metrics_take_one_exchange(spark):
    """Metrics, report, matrix and fold scores add no exchange to the table's own."""
    table = EV.confusion_table(_labelled(spark), ("model",))
    for df in (EV.metrics(table), EV.report(table), EV.matrix(table)):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_histograms_merge_and_give_auc_and_roc(spark):
    df = _labelled(spark)
    whole = EV.score_histogram(df, ("model",))
    merged = EV.merge_histograms(EV.score_histogram(df.where("label < 2"), ("model",)), EV.score_histogram(df.where("label >= 2"), ("model",)))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, merged.collect()))
    prefix = EV.prefixed(TR.materialize(merged))
    auc = {(r["model"], r["cls"]): r["auc"] for r in EV.auc_per_class(prefix).collect()}
    points = EV.roc_curve_points(prefix).collect()
    for model, rows in df.toPandas().groupby("model"):
        for c in range(4):
            pos = [p[c] for y, p in zip(rows["label"], rows["prob"]) if y == c]
            neg = [p[c] for y, p in zip(rows["label"], rows["prob"]) if y != c]
            if pos and neg:
                assert abs(auc[(model, c)] - sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)) < 1e-12
                for r in (r for r in points if (r["model"], r["cls"]) == (model, c)):
                    assert r["tpr"] == sum(a >= r["threshold"] for a in pos) / len(pos) and r["fpr"] == sum(b >= r["threshold"] for b in neg) / len(neg)


def test_model_persistence_roundtrip(spark):
    from motorlytics.sources import io as IO
    train, test = _split(spark)
    model = TR.fit_random_forest(train, {"numTrees": 5, "maxDepth": 4})
    path = IO.save_model(model, IO.shared_path(spark, "rf-test"))
    a = TR.predict(model, test).select("requisition_id", "prediction")
    b = TR.predict(IO.load_model(path, "rf"), test).select("requisition_id", "prediction")
    assert a.exceptAll(b).count() == 0


def test_exact_medians_match_pandas(spark):
    import pandas as pd
    df = spark.range(1, 102).select((F.col("id") * 37 % 101).cast("double").alias("a"),
                                    F.when(F.col("id") % 2 == 0, F.col("id") * 0.5).alias("b"))
    got = {r.feature: r.median for r in TR.exact_medians(df, ["a", "b"]).collect()}
    pdf = df.toPandas()
    assert got["a"] == pd.Series(pdf["a"]).median()
    assert got["b"] == pd.Series(pdf["b"]).dropna().median()


def test_end_to_end_lifecycle(spark):
    import os
    from motorlytics.plans.lifecycle import run_batch_lifecycle
    from motorlytics.sources import io as IO
    out = IO.shared_path(spark, "lifecycle-test")
    paths = run_batch_lifecycle(spark, requisitions(spark, SF_SMALL), out, rf_params={"numTrees": 5, "maxDepth": 4},
                         gbt_params={"maxIter": 2, "maxDepth": 2}, cv_folds=2)
    assert paths["selected_model"] in ("boosted_trees", "random_forest")
    in_force = Manifest(paths["serving"]).current(spark)
    assert in_force.version == 1 and in_force.paths.items() <= paths.items() and {"gbt_model", "rf_model", "latest"} <= set(in_force.paths)
    for k in ("engineered", "encoders", "rf_model", "gbt_model", "metadata", "evaluation", "cv",
              "batch_predictions", "department_summary"):
        assert os.path.exists(paths[k].replace("file:", "")), k
    sections = spark.read.json(paths["evaluation"]).groupBy("section").count().collect()
    assert {r["section"]: r["count"] for r in sections}["cross_validation"] == 4
    assert {r["section"] for r in sections} == {"comparison", "classification_report", "confusion_matrix", "selection", "cross_validation"}
    preds = spark.read.option("header", True).csv(paths["batch_predictions"])
    assert preds.count() == requisitions(spark, SF_SMALL).select("equipment_serial_no").distinct().count()
