"""Random forests whose trees need no Spark jobs.

Spark ML walks every row down every tree again at each level, or keeps three integers a row
and tree. Here the rows' binned features (a byte each, with the label) go to one task for
each core, which grows its share of the trees whole, a node's rows at a time: the same
splits, bootstrap, features of each node, class weights and stopping rules. Bootstrap counts
come from numpy's generator for (seed, tree), so single draws differ from Spark ML's. A
table whose binned features take more than ``WHOLE_BYTES`` is fitted by Spark ML's jobs.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorlytics.operators import boosting as BO
from motorlytics.session import ensure_checkpoint_dir

#: Rows of which bootstrap counts are drawn at once.
DRAW_ROWS = 1 << 20
# the tasks get this module's code with their work
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _gini(weights: np.ndarray) -> np.ndarray:
    total = weights.sum(axis=-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        share = weights / total[..., None]
        return np.where(total == 0, 0.0, 1.0 - (share * share).sum(axis=-1))


def bootstrap(n: int, p: dict, tree: int) -> np.ndarray:
    """How often a tree has each row."""
    out, rng = np.ones(n, np.uint8), np.random.default_rng([p["seed"] & BO.MASK64, tree])
    if p["bootstrap"] or p["subsamplingRate"] < 1:
        for a in range(0, n, DRAW_ROWS):
            m = min(n - a, DRAW_ROWS)
            out[a:a + m] = np.minimum(rng.poisson(p["subsamplingRate"], m), 255) if p["bootstrap"] else rng.random(m) < p["subsamplingRate"]
    return out


class Tree:
    """A classification tree, grown level by level like Spark ML's; ``codes`` holds bin * classes + label by feature."""

    def __init__(self, codes: list[np.ndarray], n_bins: list[int], class_weights: np.ndarray, counts: np.ndarray, p: dict, seed: int):
        n_classes, k, rng = len(class_weights), p["n_node_features"], BO.JavaRandom(seed)
        self.raw, self.stats, self.impurity, self.gain, self.valid = [0], [None], [None], [-1.0], [True]
        self.feature, self.bin, self.child = [0], [0], [None]
        rows = np.flatnonzero(counts).astype(np.int32 if len(counts) < 2**31 else np.int64)
        held, active, level, n_splits = {0: (rows, counts[rows].astype(float))}, [0], 0, np.array(n_bins) - 1
        while active:
            orders = np.array([BO.node_features(len(n_bins), k, rng.next_long()) if k < len(n_bins) else list(range(len(n_bins))) for _ in active])
            sums = np.zeros((len(active), orders.shape[1], max(n_bins), n_classes))
            for s, node in enumerate(active):
                rows, times = held[node]
                for j, f in enumerate(orders[s]):
                    sums[s, j, :n_bins[f]] = np.bincount(codes[f][rows], times, n_bins[f] * n_classes).reshape(-1, n_classes)
            cum = np.cumsum(sums, axis=2)
            low, high = cum[:, :, :-1], cum[:, :, -1:] - cum[:, :, :-1]
            if level == 0:
                self.raw[0], self.stats[0] = int(cum[0, 0, -1].sum()), cum[0, 0, -1] * class_weights
                self.impurity[0] = float(_gini(self.stats[0]))
            gain = self._gains(low, high, class_weights, np.array([self.impurity[a] for a in active]), n_splits[orders], p)
            best = gain.argmax(axis=2)
            nodes, active, level = active, [], level + 1
            for s, node in enumerate(nodes):
                j = max((j for j, f in enumerate(orders[s]) if n_splits[f]), key=lambda j: gain[s, j, best[s, j]], default=None)  # the first of equals
                g = BO.LEAST if j is None else gain[s, j, best[s, j]]
                rows, times = held.pop(node)
                if g <= 0:
                    self.valid[node] = g != BO.LEAST
                    continue
                f, cut = int(orders[s][j]), int(best[s, j])
                self.gain[node], self.feature[node], self.bin[node] = float(g), f, cut
                self.child[node] = (len(self.child), len(self.child) + 1)
                right = None
                for child, raw, side in zip(self.child[node], (low[s, j, cut], high[s, j, cut]), (False, True)):
                    self.raw.append(int(raw.sum()))
                    self.stats.append(raw * class_weights)
                    self.impurity.append(float(_gini(self.stats[child])))
                    self.gain.append(-1.0)
                    self.valid.append(True)
                    self.feature.append(0)
                    self.bin.append(0)
                    self.child.append(None)
                    if level < p["maxDepth"] and abs(self.impurity[child]) >= np.finfo(float).eps:
                        if right is None:
                            right = codes[f][rows] >= (cut + 1) * n_classes
                        of = np.flatnonzero(right if side else ~right)
                        held[child] = rows[of], times[of]
                        active.insert(0, child)

    @staticmethod
    def _gains(low, high, class_weights, impurity, n_splits, p) -> np.ndarray:
        least = p["minInstancesPerNode"]
        allowed = (low.sum(axis=-1) >= least) & (high.sum(axis=-1) >= least)
        low, high = low * class_weights, high * class_weights
        a, b = low.sum(axis=-1), high.sum(axis=-1)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = impurity[:, None, None] - a / (a + b) * _gini(low) - b / (a + b) * _gini(high)
        gain = np.where(allowed & (gain >= p["minInfoGain"]), gain, BO.LEAST)
        return np.where(np.arange(gain.shape[2]) < n_splits[:, :, None], gain, -np.inf)

    def nodes(self, tree: int, thresholds: list[np.ndarray]) -> list[dict]:
        """The tree in Spark ML's stored form; leaves of one parent that predict the same are one leaf."""
        out: list[dict] = []

        def add(node: int) -> int | None:
            at, stats = len(out), self.stats[node]
            said = int(stats.argmax())
            own = {"id": at, "prediction": float(said), "impurity": self.impurity[node] if self.valid[node] else -1.0, "impurityStats": stats.tolist(), "rawCount": self.raw[node],
                   "gain": -1.0, "leftChild": -1, "rightChild": -1, "split": {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}}
            out.append({"treeID": tree, "nodeData": own})
            if self.child[node] is None:
                return said
            left = add(self.child[node][0])
            split = len(out)
            right = add(self.child[node][1])
            if left is not None and left == right:
                del out[at + 1:]
                own["prediction"] = float(left)
                return left
            f = self.feature[node]
            own |= {"gain": self.gain[node], "leftChild": at + 1, "rightChild": split,
                    "split": {"featureIndex": f, "leftCategoriesOrThreshold": [float(thresholds[f][self.bin[node]])], "numCategories": -1}}
            return None
        add(0)
        return out


class Forest(RandomForestClassifier):
    """``RandomForestClassifier`` that grows its trees in a task for each core while the binned rows fit there; weights are by class."""

    def _fit_java(self, dataset: DataFrame):
        columns = [self.getLabelCol(), self.getFeaturesCol(), *([self.getWeightCol()] if self.isDefined(self.weightCol) else [])]
        held = dataset.select(*columns).persist()
        try:
            return self._grown(held) or super()._fit_java(held)
        finally:
            held.unpersist()

    def _grown(self, dataset: DataFrame):
        """The Java model; None if the trees are not to be grown here."""
        spark = dataset.sparkSession
        sc, jvm = spark.sparkContext, spark.sparkContext._jvm
        label, weight = self.getLabelCol(), F.col(self.getWeightCol()) if self.isDefined(self.weightCol) else F.lit(1.0)
        classes = sorted(dataset.groupBy(F.col(label).cast("double").alias("label")).agg(F.min(weight).alias("low"), F.max(weight).alias("high")).collect(), key=lambda r: (r["label"] is not None, r["label"]))
        if not classes or any(r["label"] is None or r["label"] < 0 or r["label"] % 1 or not 0 <= r["low"] == r["high"] for r in classes):
            return None
        n_classes = int(classes[-1]["label"]) + 1
        class_weights = np.ones(n_classes)
        for r in classes:
            class_weights[int(r["label"])] = r["low"]
        self._transfer_params_to_java()
        java, ml, single = self._java_obj, jvm.org.apache.spark.ml, BO.single
        strategy = java.getOldStrategy(jvm.scala.collection.immutable.HashMap(), n_classes, single(jvm.org.apache.spark.mllib.tree.configuration, "Algo").Classification(), java.getOldImpurity())
        instances = single(ml.util, "DatasetUtils").extractInstances(java, dataset._jdf, jvm.scala.Some(n_classes))
        metadata = single(ml.tree.impl, "DecisionTreeMetadata").buildMetadata(instances, strategy, self.getNumTrees(), self.getFeatureSubsetStrategy())
        n_features = metadata.numFeatures()
        if metadata.numExamples() * n_features > BO.WHOLE_BYTES or self.getMaxBins() * n_classes > 256 or self.getImpurity() != "gini" or self.getMinWeightFractionPerNode():
            return None
        splits = single(ml.tree.impl, "RandomForest").findSplits(instances, metadata, self.getSeed())
        thresholds = [np.array([s.threshold() for s in of]) for of in splits]
        p = {k.name: v for k, v in self.extractParamMap().items()} | {"n_node_features": metadata.numFeaturesPerNode()}
        n_trees = self.getNumTrees()
        n_tasks = min(n_trees, max(sc.defaultParallelism, 1))

        def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bins, label, _, task = BO.gathered(batches, n_features)
            if not len(label):
                return
            codes = [bins[:, f] * np.uint8(n_classes) + label for f in range(n_features)]
            del bins
            for t in range(task, n_trees, n_tasks):
                tree = Tree(codes, [len(x) + 1 for x in thresholds], class_weights, bootstrap(len(label), p, t), p, self_seed + t)
                yield pa.RecordBatch.from_pylist(tree.nodes(t, thresholds), schema)

        self_seed, schema = self.getSeed(), spark.createDataFrame([], BO.NODES).toArrow().schema
        ensure_checkpoint_dir(spark)
        path = f"{sc.getCheckpointDir()}/forest-{uuid.uuid4().hex}"
        blocks = BO.binned(dataset, label, self.getFeaturesCol(), thresholds)
        dealt = blocks.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(n_tasks - 1)))).repartitionById(n_tasks, F.col("task"))
        dealt.mapInArrow(grow, BO.NODES).write.parquet(f"{path}/data")
        BO.describe(spark, self, path, "classification.RandomForestClassificationModel", "classification.DecisionTreeClassificationModel", [1.0] * n_trees,
                    numFeatures=n_features, numClasses=n_classes, numTrees=n_trees)
        return ml.classification.RandomForestClassificationModel.load(path)
