"""Whole fits: cross-validation at the models' own sizes; boosting in one task a class grows Spark ML's trees."""

import re

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from motorlytics.operators import boosting as BO
from motorlytics.operators import forest as FO
from motorlytics.operators import training as TR
from motorlytics.registry import training as RT


def test_cross_validation_fits_whole_models(spark, monkeypatch):
    """Each fold's fits have the parameters of the models that are compared, not smaller ones."""
    made = []
    monkeypatch.setattr(TR, "fit_boosted_trees", lambda rows, params=None, **_: made.append(("gbt", {**TR.GBT_PARAMS, **(params or {})})))
    monkeypatch.setattr(TR, "fit_random_forest", lambda rows, params=None, **_: made.append(("rf", {**TR.RF_PARAMS, **(params or {})})))
    monkeypatch.setattr(TR, "prepare", lambda df: df)
    monkeypatch.setattr(RT, "engineered", lambda *_: None)
    monkeypatch.setattr(RT, "stage", lambda s, d, name, build: build())

    def folds(df, fits, k, alone):
        for fold in range(k):
            for fit in fits.values():
                fit(df)
        return made
    monkeypatch.setattr(TR, "cross_validate", folds)
    got = RT.cross_validation(spark, "x")
    assert [kind for kind, _ in got] == ["gbt", "rf"] * 5
    assert all(p == (TR.GBT_PARAMS if kind == "gbt" else TR.RF_PARAMS) for kind, p in got)
    assert TR.GBT_PARAMS["maxIter"] == TR.RF_PARAMS["numTrees"] == 300


def _rows(spark, n, parts):
    rows = spark.range(n, numPartitions=parts).select("id", *[F.pmod(F.xxhash64("id", F.lit(c)), F.lit(97 if c < "e" else 3)).cast("double").alias(c) for c in "abcdef"])
    rows = rows.withColumn("g", F.lit(1.0)).withColumn(
        "label", ((F.col("a") * F.col("e") > F.col("b") + F.col("c")) != (F.pmod(F.xxhash64("id"), F.lit(7)) == 0)).cast("double"))
    return TR.materialize(VectorAssembler(inputCols=list("abcdefg"), outputCol="features").transform(rows))


def _splits_and_outputs(model):
    text = "".join(t.toDebugString.split("\n", 1)[1] for t in model.trees)
    return re.sub(r"Predict: \S+", "Predict", text), np.array([float(v) for v in re.findall(r"Predict: (\S+)", text)])


PARAMS = {"maxIter": 8, "maxDepth": 6, "seed": 42, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "minInstancesPerNode": 3, "minInfoGain": 1e-5}


@pytest.mark.parametrize("parts, change, joint", [(1, {}, False), (3, {}, False), (2, {"minInstancesPerNode": 60}, True), (1, {"subsamplingRate": 1.0, "featureSubsetStrategy": "all", "maxDepth": 3}, False)])
def test_boosting_in_one_task_grows_spark_mls_trees(spark, monkeypatch, parts, change, joint):
    if joint:  # several chunks, features counted together; large mixed nodes, as rounding decides whether a node is pure
        monkeypatch.setattr(BO, "CHUNK_ROWS", 1500)
        monkeypatch.setattr(BO, "BLOCK_ROWS", 700)
        monkeypatch.setattr(BO, "LANES", 16)
    rows = _rows(spark, 4000, parts)
    before = len(_jobs(spark))
    own = BO.BoostedTrees(**{**PARAMS, **change}).fit(rows)
    assert len(_jobs(spark)) - before <= 20  # not by rounds and levels
    theirs = GBTClassifier(**{**PARAMS, **change}).fit(rows)
    (a, x), (b, y) = _splits_and_outputs(own), _splits_and_outputs(theirs)
    assert a == b and np.allclose(x, y, rtol=1e-9, atol=1e-12)
    assert own.treeWeights == theirs.treeWeights and own.numFeatures == 7 and own.getMaxIter() == 8
    assert np.allclose(own.featureImportances.toArray(), theirs.featureImportances.toArray(), rtol=1e-9)


def _jobs(spark):
    return spark.sparkContext._jsc.sc().statusTracker().getJobIdsForGroup(None)


def test_boosting_leaves_large_tables_to_spark_ml(spark, monkeypatch):
    rows, seen = _rows(spark, 500, 2), []
    monkeypatch.setattr(BO, "WHOLE_BYTES", 500 * 7 - 1)
    monkeypatch.setattr(BO, "describe", lambda *a, **b: seen.append(a))
    model = BO.BoostedTrees(**{**PARAMS, "maxIter": 2}).fit(rows)
    assert not seen and model.getNumTrees == 2


def test_boosting_refuses_values_that_are_not_finite(spark):
    rows = _rows(spark, 50, 1).select("label", F.col("features"))
    bad = VectorAssembler(inputCols=["x"], outputCol="features", handleInvalid="keep").transform(rows.select("label", F.lit(float("nan")).alias("x")))
    with pytest.raises(Exception):
        BO.BoostedTrees(**PARAMS).fit(bad)


def test_draws_are_one_generator_taken_in_order():
    """The side by side generators of a part draw what one would row by row."""
    s, want = BO.hashed_seed(7), []
    for _ in range(1000):
        high = BO._next(s)
        s = BO._next(high)
        want.append(((high & 0x3FFFFFF) << 27 | s & 0x7FFFFFF) * 2.0**-53 < 0.8)
    assert BO.Bag(1000, 0.8)(7).tolist() == want and 700 < sum(want) < 900
    assert BO.Bag(0, 0.8)(7).tolist() == [] and len(BO.Bag(1, 0.8)(7)) == 1


def _classes(spark, n=4000, parts=2):
    rows = _rows(spark, n, parts).withColumn("label", (F.col("label") * 2 + (F.col("a") > 60).cast("int") * (F.col("e") > 0).cast("int")).cast("int"))
    return TR.materialize(TR.class_weights(rows))


FOREST = {"weightCol": "weight", "numTrees": 1, "maxDepth": 8, "featureSubsetStrategy": "sqrt", "minInstancesPerNode": 2, "seed": 42}


@pytest.mark.parametrize("change", [{}, {"maxDepth": 4}, {"featureSubsetStrategy": "all", "minInstancesPerNode": 20, "minInfoGain": 0.01}])
def test_a_tree_grown_whole_is_spark_mls(spark, change):
    rows = _classes(spark).withColumn("weight", F.ceil(F.col("weight") * 8) / 8)  # sums without rounding, which decides whether a node is pure
    assert rows.select("label").distinct().count() == 4
    own, theirs = (kind(**{**FOREST, "bootstrap": False, **change}).fit(rows) for kind in (FO.Forest, RandomForestClassifier))
    a, b = _splits_and_outputs(own), _splits_and_outputs(theirs)
    assert a[0] == b[0] and a[1].tolist() == b[1].tolist()
    x, y = ([r["probability"].toArray() for r in m.transform(rows).select("id", "probability").orderBy("id").collect()] for m in (own, theirs))
    assert np.allclose(x, y, atol=1e-9) and own.numClasses == 4
    assert np.allclose(own.featureImportances.toArray(), theirs.featureImportances.toArray(), atol=1e-9)


def test_a_forest_grown_whole_is_as_good_as_spark_mls(spark, monkeypatch):
    """The default bootstrap: other draws, the same kind of forest."""
    rows, test = _classes(spark, 6000).randomSplit([0.7, 0.3], seed=3)
    monkeypatch.setattr(FO, "DRAW_ROWS", 1000)
    models = [kind(**{**FOREST, "numTrees": 40}).fit(rows) for kind in (FO.Forest, RandomForestClassifier)]
    scores = [m.transform(test).where("prediction = label").count() / test.count() for m in models]
    assert models[0].getNumTrees == 40 and len({t.toDebugString.split("\n", 1)[1] for t in models[0].trees}) == 40
    assert abs(scores[0] - scores[1]) < 0.03
    shares = [m.featureImportances.toArray() for m in models]
    assert np.abs(shares[0] - shares[1]).max() < 0.05
    again = FO.Forest(**{**FOREST, "numTrees": 40}).fit(rows)
    assert _splits_and_outputs(again)[0] == _splits_and_outputs(models[0])[0]


def test_bootstrap_counts_are_poisson():
    counts = FO.bootstrap(200_000, {"seed": 42, "bootstrap": True, "subsamplingRate": 1.0}, 3)
    for k, share in enumerate((0.3679, 0.3679, 0.1839, 0.0613)):
        assert abs((counts == k).mean() - share) < 0.005
    assert (FO.bootstrap(50, {"seed": 42, "bootstrap": False, "subsamplingRate": 1.0}, 3) == 1).all()


def test_large_forests_are_grown_by_tasks(spark, monkeypatch):
    """From ``FOREST_ROWS`` on, no jobs by level; beyond ``WHOLE_BYTES`` Spark ML's."""
    rows, seen, grown = _classes(spark, 600).drop("features", "weight"), [], FO.Forest._grown
    monkeypatch.setattr(FO.Forest, "_grown", lambda self, rows: seen.append(grown(self, rows)) or seen[-1])
    params = {"numTrees": 5, "maxDepth": 4}
    TR.fit_random_forest(rows, params, list("abcdefg"))
    assert not seen
    monkeypatch.setattr(TR, "FOREST_ROWS", 600)
    assert TR.fit_random_forest(rows, params, list("abcdefg")).getNumTrees == 5 and len(seen) == 1 and seen[0] is not None
    monkeypatch.setattr(BO, "WHOLE_BYTES", 600 * 7 - 1)
    assert TR.fit_random_forest(rows, params, list("abcdefg")).getNumTrees == 5 and seen[1:] == [None]


def test_rows_walked_in_batches_get_the_models_own_scores(spark):
    """Missing and extreme values go the way Spark ML sends them; no leaf is worked out in the JVM."""
    rows = _classes(spark, 1500).drop("features", "weight")
    model = TR.fit_boosted_trees(rows, {"maxIter": 5, "maxDepth": 4}, list("abcdefg"))
    odd = rows.withColumn("a", F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 5 == 1, float("inf")).otherwise(F.col("a")))
    got = TR.predict_rows(model, odd, list("abcdefg"), ["id", "label"])
    assert got.columns == ["id", "label", "prediction", "prob"]
    want = {r["id"]: r for r in TR.predict(model, odd, list("abcdefg")).select("id", "label", "prediction", "prob").collect()}
    found = got.collect()
    assert len(found) == len(want) == 1500
    assert all(r["prediction"] == want[r["id"]]["prediction"] and np.allclose(r["prob"], want[r["id"]]["prob"], atol=1e-12) for r in found)


@pytest.mark.parametrize("call", ["losses", "attribution"])
def test_losses_and_attribution_do_not_walk_trees_in_the_jvm(spark, call):
    """Walking 1,200 trees for many rows there took most of the time of these two."""
    rows = _classes(spark, 300).drop("features", "weight")
    model = TR.fit_boosted_trees(rows, {"maxIter": 2, "maxDepth": 2}, list("abcdefg"))
    out = (TR.staged_losses(model, rows.withColumn("split", F.lit("x")), "split", list("abcdefg")) if call == "losses"
           else TR.permutation_attribution(model, rows, list("abcdefg"), key="id"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "UDF" not in plan and out.count() == (2 if call == "losses" else 7)


def test_a_fold_is_counted_before_the_next_is_fitted(spark):
    """Ten whole models at once (7,500 trees) did not fit the driver's memory."""
    import gc
    import weakref
    from motorlytics.operators import features as FE
    from motorlytics.sources.fixtures import requisitions
    from tests.conftest import SF_SMALL
    alive, most = [], []

    def fit(rows):
        gc.collect()
        most.append(sum(r() is not None for r in alive))
        model = TR.RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=2, maxDepth=2).fit(TR.assembler().transform(rows))
        alive.append(weakref.ref(model))
        return model
    got = TR.cross_validate(TR.prepare(FE.engineer(requisitions(spark, SF_SMALL))[0]), {"a": fit}, k=3, parallelism=1).collect()
    assert len(got) == 3 and max(most) == 0


def test_boosting_is_left_to_spark_ml_below_the_rows_told(spark, monkeypatch):
    rows, seen, fit = _classes(spark, 300).drop("features", "weight"), [], BO.BoostedTrees._fit_java
    monkeypatch.setattr(BO.BoostedTrees, "_fit_java", lambda self, rows: seen.append(1) or fit(self, rows))
    params = {"maxIter": 1, "maxDepth": 2}
    TR.fit_boosted_trees(rows, params, ["a", "b"])
    assert not seen
    models = [TR.fit_boosted_trees(rows, params, ["a", "b"], whole_rows=0)]
    monkeypatch.setattr(TR, "WHOLE_ROWS", 300)
    models.append(TR.fit_boosted_trees(rows, params, ["a", "b"]))
    assert len(seen) == 8 and all(len(m.models) == 4 for m in models)
