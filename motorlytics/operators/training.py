"""Model preparation and training (M1-M5, M4w, M10, M12, M13) with pyspark.ml.

* Medians are exact and distributed: per-feature value counts, then a
  range-bucketed prefix count finds the middle values.
* Split and folds are stratified and deterministic: rows are ranked inside
  their class by a hash of the row key (range-bucketed, so a large class is
  not one task) and cut by rank.
* The prepared training table is checkpointed into the shared checkpoint
  folder before the iterative fits, so tree building does not re-run the
  feature lineage on every pass and survives lost executors.
* Losses after every boosting round come from one pass over the rows, walked down the
  trees round by round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from motorlytics import schema as S
from motorlytics.functions.expr import draw_bits
from motorlytics.operators import evaluation as EV
from motorlytics.operators.boosting import BoostedTrees, Scorer, features_of
from motorlytics.operators.forest import Forest
from motorlytics.plans.ordering import global_prefix
from motorlytics.session import ensure_checkpoint_dir

LABEL = "label"

# Reference hyper-parameters, mapped to Spark ML names (defaults of the fits)
RF_PARAMS = {"numTrees": 300, "maxDepth": 10, "minInstancesPerNode": 2, "featureSubsetStrategy": "sqrt", "seed": 42}
GBT_PARAMS = {"maxIter": 300, "maxDepth": 6, "stepSize": 0.1, "subsamplingRate": 0.8,
              "featureSubsetStrategy": "0.8", "minInstancesPerNode": 3, "seed": 42}
#: Least fall of the loss, summed over the training rows, that a split must bring. Spark's
#: ``minInfoGain`` is a mean over rows, so it becomes GAMMA / rows.
GAMMA = 0.1
#: Rows for each partition of a fit (as far as there are cores).
FIT_ROWS = 1500
#: Rows for each partition of a boosting fit: fewer than the first are not worth a task of their
#: own in its many short jobs, more than the second are dealt to further ones.
BOOST_ROWS = (50_000, 1_000_000)
#: Part of the executors' storage memory that a forest's stored rows may take for its node ids to be kept.
NODE_ID_SHARE = 0.5
#: Rows from which a forest's trees and a class's boosted trees are grown whole by tasks. Fewer are
#: fitted by Spark ML's jobs: rounding can send a tree's draws another way, and small tables keep their results.
FOREST_ROWS = WHOLE_ROWS = 100_000


# M1 ------------------------------------------------------------------------
def exact_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, median) with the mean of the two middle values for even counts.

    Value counts are aggregated per (feature, value) first, so one feature's
    distinct values never have to meet in a single buffer; the middle rank is
    found with a bucketed prefix count."""
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(F.inline(arr)).where(F.col("value").isNotNull())
    # stored: its size, its totals and its prefix are read from it, not each from the table
    counts = materialize(long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")))
    sizes = counts.groupBy("feature").agg(F.sum("n").alias("total"))
    cum = global_prefix(counts, ["value"], "cum", value=F.col("n"), partition=["feature"])
    j = cum.join(sizes, "feature")
    lo_rank = F.floor((F.col("total") + 1) / 2)  # 1-based ranks of the middle values
    hi_rank = F.floor(F.col("total") / 2) + 1
    covers = lambda r: (F.col("cum") - F.col("n") < r) & (F.col("cum") >= r)
    mids = j.select("feature", F.when(covers(lo_rank), F.col("value")).alias("lo"),
                    F.when(covers(hi_rank), F.col("value")).alias("hi"))
    return mids.groupBy("feature").agg(((F.max("lo") + F.max("hi")) / 2.0).alias("median"))


def prepare(df: DataFrame, features: list[str] | None = None, label_col: str = "risk_category",
            key: str = "requisition_id", impute: str = "median") -> DataFrame:
    """Feature matrix + label; missing features filled with the column median
    over the whole table (``impute='median'``) or with 0 (``'zero'``)."""
    features = features or S.FEATURE_COLUMNS
    base = df.select(key, *[F.col(c).cast("double").alias(c) for c in features], F.col(label_col).alias(LABEL))
    if impute == "zero":
        return base.fillna(0.0, subset=features)
    med = exact_medians(base, features)
    wide = med.groupBy().pivot("feature", features).agg(F.first("median"))  # one row
    filled = base.crossJoin(F.broadcast(wide.select(*[F.col(c).alias(f"_med_{c}") for c in features])))
    return filled.select(key, *[F.coalesce(F.col(c), F.col(f"_med_{c}")).alias(c) for c in features], LABEL)


# M4w -----------------------------------------------------------------------
def class_weights(df: DataFrame, label_col: str = LABEL) -> DataFrame:
    """Balanced weights n / (k * n_class) per row (k = classes present)."""
    per = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("_nc"))
    tot = per.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k"))
    w = per.crossJoin(tot).select(label_col, (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias("weight"))
    return df.join(F.broadcast(w), label_col, "left")  # one row per class (bounded by the label set)


# M2 / M10 ------------------------------------------------------------------
def _class_rank(df: DataFrame, key: str, seed: int) -> DataFrame:
    ranked = df.withColumn("_h", draw_bits(seed, F.col(key)))
    ranked = global_prefix(ranked, ["_h", key], "_rank", partition=[LABEL])
    sizes = ranked.groupBy(LABEL).agg(F.count(F.lit(1)).alias("_class_n"))
    return ranked.join(F.broadcast(sizes), LABEL)


def split_quotas(df: DataFrame, test_size: float = 0.2) -> DataFrame:
    """``label, _class_n, _quota``: ceil(test_size * n) test rows in all, shared out by
    class in proportion; what rounding down leaves goes to the largest remainders, ties
    to the larger class, then the smaller label."""
    sizes = df.groupBy(LABEL).agg(F.count(F.lit(1)).alias("_class_n"))
    total = sizes.agg(F.sum("_class_n").alias("_n")).select("_n", F.ceil(F.round(F.col("_n") * test_size, 6)).alias("_t"))
    # one row per class: bounded by the label set
    shared = sizes.crossJoin(F.broadcast(total)).withColumn("_exact", F.round(F.col("_class_n") * F.col("_t") / F.col("_n"), 9))
    shared = shared.withColumn("_quota", F.floor("_exact"))
    one = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(one.orderBy(F.desc(F.col("_exact") - F.col("_quota")), F.desc("_class_n"), LABEL))
    left = F.col("_t") - F.sum("_quota").over(one)
    return shared.select(LABEL, "_class_n", (F.col("_quota") + F.when(rank <= left, 1).otherwise(0)).alias("_quota"))


def stratified_split(df: DataFrame, test_size: float = 0.2, seed: int = 42, key: str = "requisition_id") -> DataFrame:
    """Adds ``is_test``: ceil(test_size * n) rows, within each class (its share by
    ``split_quotas``) those with the smallest draw for (seed, key)."""
    ranked = global_prefix(df.withColumn("_h", draw_bits(seed, F.col(key))), ["_h", key], "_rank", partition=[LABEL])
    quotas = split_quotas(df, test_size).select(F.col(LABEL).alias("_of"), "_quota")
    r = ranked.join(F.broadcast(quotas), F.col(LABEL).eqNullSafe(F.col("_of")))
    return r.withColumn("is_test", F.col("_rank") <= F.col("_quota")).drop("_h", "_rank", "_quota", "_of")


def stratified_folds(df: DataFrame, k: int = 5, seed: int = 42, key: str = "requisition_id") -> DataFrame:
    """Adds ``fold`` in 0..k-1, dealt round-robin in hash order within each class."""
    r = _class_rank(df, key, seed)
    return r.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_h", "_rank", "_class_n")


# M3 / M4 / M5 --------------------------------------------------------------
def assembler(features: list[str] | None = None) -> VectorAssembler:
    return VectorAssembler(inputCols=features or S.FEATURE_COLUMNS, outputCol="features", handleInvalid="keep")


def spread(df: DataFrame, n_rows: int) -> DataFrame:
    """A fit's rows over the cores: a small stored table comes back as one partition."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if 1 < (n := min(cores, n_rows // FIT_ROWS)) else df


def spread_boosting(df: DataFrame, n_rows: int, parallelism: int) -> DataFrame:
    """A boosting fit's rows in equal parts, one for each core that a class has while
    ``parallelism`` of them are fitted: every job of a round waits for its largest part, and
    the split's own parts are uneven. A small table stays as it is."""
    cores, (few, many) = df.sparkSession.sparkContext.defaultParallelism, BOOST_ROWS
    n = min(max(cores // parallelism, -(-n_rows // many)), n_rows // few)
    return df.repartition(n) if n > 1 else df


def storage_bytes(spark: SparkSession) -> int:
    """Storage memory of all executors (in local mode of the driver, which runs the tasks)."""
    sc = spark.sparkContext
    infos = [(i.host(), i.port(), i.totalOnHeapStorageMemory()) for i in sc._jsc.sc().statusTracker().getExecutorInfos()]
    own = sc._jvm.org.apache.spark.SparkEnv.get().blockManager().blockManagerId()
    return sum(size for host, port, size in infos if sc._jsc.sc().isLocal() or (host, port) != (own.host(), own.port()))


def keeps_node_ids(spark: SparkSession, n_rows: int, n_trees: int) -> bool:
    """Whether a forest's rows may keep their node in every tree from one level to the next,
    rather than being walked down each tree from its root again; the trees are the same. A
    row then holds three integers a tree: its draws, its node before the level and after."""
    return 3 * 4 * n_rows * n_trees <= NODE_ID_SHARE * storage_bytes(spark)


def fit_random_forest(train: DataFrame, params: dict | None = None, features: list[str] | None = None):
    """Random forest with balanced class weights (``weightCol``)."""
    p, n_rows = {**RF_PARAMS, **(params or {})}, train.count()
    if keeps_node_ids(train.sparkSession, n_rows, p["numTrees"]):
        # lost node ids are worked out again from the rows; no copies go to the checkpoint folder
        p = {"cacheNodeIds": True, "checkpointInterval": -1, **p}
    data = assembler(features).transform(spread(class_weights(train), n_rows))
    kind = Forest if n_rows >= FOREST_ROWS else RandomForestClassifier
    rf = kind(featuresCol="features", labelCol=LABEL, weightCol="weight", **p)
    return rf.fit(data)


def fit_boosted_trees(train: DataFrame, params: dict | None = None, features: list[str] | None = None,
                      parallelism: int = 4, whole_rows: int | None = None):
    """Multiclass boosting as one-vs-rest binary gradient-boosted trees, a class's grown by one
    task from ``whole_rows`` rows on (``WHOLE_ROWS`` unless told otherwise)."""
    n_rows = train.count()
    p = {"minInfoGain": GAMMA / max(n_rows, 1), **GBT_PARAMS, **(params or {})}
    data = assembler(features).transform(spread_boosting(train, n_rows, parallelism))
    kind = BoostedTrees if n_rows >= (WHOLE_ROWS if whole_rows is None else whole_rows) else GBTClassifier
    ovr = OneVsRest(classifier=kind(featuresCol="features", labelCol=LABEL, **p),
                    featuresCol="features", labelCol=LABEL, parallelism=parallelism)
    return ovr.fit(data)


# M3 evaluation set ---------------------------------------------------------
def staged_losses(model, df: DataFrame, split: str, features: list[str] | None = None) -> DataFrame:
    """``split, round, n, logloss, mlogloss`` of a one-vs-rest boosted model after each
    round, for each value of the column ``split``.

    ``logloss`` is the boosting objective, 2 log(1 + exp(-2 y m)) of a class's margin m,
    summed over the classes and averaged over rows; ``mlogloss`` is minus the log of the
    normalised probability of the row's label. One pass: the tasks walk their rows down the
    trees round by round and emit a row of sums for each round and split."""
    scorer = Scorer(model.models)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            splits, label = np.array(batch.column("split").to_pylist()), batch.column("label").to_numpy(zero_copy_only=False)
            answers, margins = scorer.answers(features_of(batch)), np.zeros((len(scorer.models), batch.num_rows))
            own, sign = (label.astype(np.int64)[None, :], np.where(label[None, :] == np.arange(len(margins))[:, None], 1.0, -1.0))
            here = {name: splits == name for name in set(splits.tolist())}
            for name in here:
                found.setdefault(name, np.zeros((3, scorer.rounds)))[0] += here[name].sum()
            for m in range(scorer.rounds):
                for k in range(len(margins)):
                    margins[k] += scorer.output(k, m, answers)
                log = 2 * np.logaddexp(0, -2 * sign * margins).sum(axis=0)
                share = 1 / (1 + np.exp(-2 * margins))
                mlog = -np.log(np.maximum(np.take_along_axis(share, own, axis=0)[0] / share.sum(axis=0), 1e-300))
                for name, rows in here.items():
                    found[name][1:, m] += log[rows].sum(), mlog[rows].sum()
        for name, (n, log, mlog) in found.items():
            yield pa.RecordBatch.from_arrays([
                pa.array([name] * scorer.rounds, pa.string()), pa.array(np.arange(1, scorer.rounds + 1, dtype=np.int32)), pa.array(n.astype(np.int64)),
                pa.array(log), pa.array(mlog)], names=["split", "round", "n", "logloss", "mlogloss"])

    features = features or S.FEATURE_COLUMNS
    small = df.select(F.col(split).cast("string").alias("split"), F.col(LABEL).cast("int").alias("label"), feature_array(features))
    small = small.repartition(max(small.sparkSession.sparkContext.defaultParallelism, 1))  # in equal parts
    parts = small.where("split is not null and label is not null").mapInArrow(sums, "split string, round int, n long, logloss double, mlogloss double")
    return parts.groupBy("split", "round").agg(F.sum("n").alias("n"), *[(F.sum(c) / F.sum("n")).alias(c) for c in ("logloss", "mlogloss")])


def predict(model, df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Adds ``prediction`` (int) and ``prob`` (array<double>, one per class).

    Forests expose class probabilities. One-vs-rest boosting exposes one margin m per
    class: the largest is the prediction (ties to the smaller class), and 1/(1+exp(-2m)),
    normalised, the probabilities. The binary models are applied one by one, so that the
    scoring stays in the JVM and works on streams."""
    out = assembler(features).transform(df)
    if hasattr(model, "models"):
        raw = [f"_raw{k}" for k in range(len(model.models))]
        for name, binary in zip(raw, model.models):
            out = binary.copy().setPredictionCol("").setProbabilityCol("").setRawPredictionCol(name).transform(out)
        margins = F.array(*[vector_to_array(F.col(name))[1] for name in raw])
        sig = F.transform(F.col("_margins"), lambda m: F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * m)))
        out = out.withColumn("_margins", margins).withColumn("_sig", sig)
        prob = F.transform("_sig", lambda x: x / F.aggregate("_sig", F.lit(0.0), lambda a, b: a + b))
        prediction = F.array_position("_margins", F.array_max("_margins")) - 1
        return out.withColumns({"prob": prob, "prediction": prediction.cast("int")}).drop("features", "_margins", "_sig", *raw)
    out = model.transform(out)
    return out.withColumns({"prob": vector_to_array(F.col("probability")), "prediction": F.col("prediction").cast("int")}).drop(
        "features", "rawPrediction", "probability")


def feature_array(features: list[str]) -> Column:
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features]).alias("features")


def predict_rows(model, df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """The columns ``keep`` of a table with ``prediction`` and ``prob`` as ``predict`` gives them. One-vs-rest
    boosting is walked in Arrow batches, which for many rows takes a fraction of the time."""
    if not hasattr(model, "models"):
        return predict(model, df, features).select(*keep, "prediction", "prob")
    scorer = Scorer(model.models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            margins = scorer.margins(features_of(batch))
            sig = 1 / (1 + np.exp(-2 * margins))
            prob = np.ascontiguousarray((sig / sig.sum(axis=0)).T)
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * len(margins)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(margins.argmax(axis=0).astype(np.int32)),
                                              pa.ListArray.from_arrays(pa.array(ends), pa.array(prob.reshape(-1)))], names=[*keep, "prediction", "prob"])
    kept = df.select(*keep, feature_array(features))
    schema = StructType([*[kept.schema[c] for c in keep], StructField("prediction", IntegerType()), StructField("prob", ArrayType(DoubleType()))])
    return kept.mapInArrow(run, schema)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage into the shared checkpoint folder (reliable checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# M10 -----------------------------------------------------------------------
def cross_validate(df: DataFrame, fits: dict[str, Callable], k: int = 5, seed: int = 42, key: str = "requisition_id",
                   parallelism: int = 4, alone: tuple[str, ...] = ()) -> DataFrame:
    """``model, fold, f1_weighted, cv_mean, cv_std``: every model fitted without each fold
    in turn and scored on it. Fits are submitted ``parallelism`` at a time; those of a model
    in ``alone``, which fill cores and memory by themselves, one at a time beside them. A
    fold's predictions are counted as soon as its model is fitted, so that no more models are
    held than are being fitted; the scores are projections of the confusion table of all."""
    folded = materialize(stratified_folds(df, k, seed, key))

    def held_out(task: tuple[str, int]) -> DataFrame:
        name, fold = task
        model = fits[name](folded.where(F.col("fold") != fold).drop("fold"))
        scored = predict_rows(model, folded.where(F.col("fold") == fold), S.FEATURE_COLUMNS, ["fold", LABEL]).withColumn("model", F.lit(name))
        return materialize(EV.confusion_table(scored, ("model", "fold")))

    with ThreadPoolExecutor(parallelism) as pool, ThreadPoolExecutor(1) as single:
        tasks = [(single if name in alone else pool).submit(held_out, (name, fold)) for name in fits for fold in range(k)]
        parts = [t.result() for t in tasks]
    table = parts[0]
    for p in parts[1:]:
        table = table.unionByName(p)
    return EV.fold_scores(materialize(table))


# M12 -----------------------------------------------------------------------
def feature_importance(spark: SparkSession, model, features: list[str] | None = None) -> DataFrame:
    """Importances with names, highest first (rank 1). One-vs-rest: the mean
    over the per-class models."""
    features = features or S.FEATURE_COLUMNS
    if hasattr(model, "featureImportances"):
        imp = model.featureImportances.toArray().tolist()
    else:
        per = [m.featureImportances.toArray().tolist() for m in model.models]
        imp = [sum(v[i] for v in per) / len(per) for i in range(len(features))]
    rows = [(f, float(v)) for f, v in zip(features, imp)]
    df = spark.createDataFrame(rows, "feature string, importance double")  # one row per feature
    return global_prefix(df.withColumn("_neg", -F.col("importance")), ["_neg", "feature"], "rank").select(
        "feature", "importance", F.col("rank").cast("int").alias("rank"))


# M13 -----------------------------------------------------------------------
def permutation_attribution(model, df: DataFrame, features: list[str] | None = None, cls: int = 2,
                            seed: int = 7, n_blocks: int = 16, key: str = "requisition_id") -> DataFrame:
    """How much each feature moves the probability of class ``cls``.

    For every feature, the feature's values are permuted among the rows of a
    block (``n_blocks`` of them, by a hash of the key; a parameter, so that the
    result of the same rows does not hang on a count). All permuted copies are scored in
    one ``transform``. Per feature: the mean absolute change of p[cls] and
    the drop in accuracy against the unpermuted rows."""
    features = features or S.FEATURE_COLUMNS
    base = predict_rows(model, df, features, [key, LABEL]).select(key, F.col("prob")[cls].alias("_p0"),
                                               (F.col("prediction") == F.col(LABEL)).cast("double").alias("_ok0"))
    feats = F.array(*[F.lit(f) for f in features])
    long = df.withColumn("_feature", F.explode(feats)).withColumn(
        "_bucket", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(n_blocks)))
    w_key = Window.partitionBy("_feature", "_bucket").orderBy(key)
    w_rand = Window.partitionBy("_feature", "_bucket").orderBy(F.xxhash64(F.col(key), F.col("_feature"), F.lit(seed)), key)
    value = F.coalesce(*[F.when(F.col("_feature") == f, F.col(f)) for f in features])
    donors = long.select("_feature", "_bucket", F.row_number().over(w_rand).alias("_pos"), value.alias("_donor"))
    takers = long.withColumn("_pos", F.row_number().over(w_key))
    permuted = takers.join(donors, ["_feature", "_bucket", "_pos"])
    permuted = permuted.withColumns({f: F.when(F.col("_feature") == f, F.col("_donor")).otherwise(F.col(f))
                                     for f in features})
    scored = predict_rows(model, permuted, features, [key, "_feature", LABEL])
    delta = scored.select(key, "_feature", F.col("prob")[cls].alias("_p1"),
                          (F.col("prediction") == F.col(LABEL)).cast("double").alias("_ok1")).join(base, key)
    baseline = base.agg(F.avg("_ok0").alias("_acc0"))  # one row
    out = delta.groupBy(F.col("_feature").alias("feature")).agg(
        F.avg(F.abs(F.col("_p1") - F.col("_p0"))).alias("mean_abs_change"), F.avg("_ok1").alias("_acc1"))
    return out.crossJoin(F.broadcast(baseline)).select(
        "feature", "mean_abs_change", (F.col("_acc0") - F.col("_acc1")).alias("accuracy_drop"))
