"""Checklist requests answered in full: motor attributes, prediction, error.

``respond`` answers a frame of requests. ``start_response_stream`` runs it for each
micro-batch of a request folder: the batch reads the newest published set (latest records
and what the scorer needs), so a set published between two batches serves the second, and
one batch is answered by one set. Answers of batch n go to the folder ``batch_id=n``,
which a replay of that batch replaces, so each request is answered once.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from motorlytics.operators import scoring as SC
from motorlytics.operators.dashboards import apply_checklist
from motorlytics.operators.features import SERIAL
from motorlytics.sources.manifest import Manifest, Published
from motorlytics.streaming.checklist import REQUEST_SCHEMA, checklist_counts_per_request

#: adjusted features -> the same rows with class probabilities and ``risk_class``
Score = Callable[[DataFrame], DataFrame]
BROADCAST_BYTES = 16 << 20
#: memory of one broadcast key beyond its bytes
KEY_BYTES = 64


def asked_motors(requests: DataFrame, fleet: DataFrame) -> DataFrame:
    """The fleet rows that a batch asks for. The serials are broadcast if their counted
    bytes are few, so the fleet is filtered where it is read; else the fleet is returned
    whole and the join with the requests shuffles it."""
    keys = requests.where(F.col("serial_no").isNotNull()).select(F.col("serial_no").alias(SERIAL)).distinct()
    size = keys.agg(F.sum(F.octet_length(SERIAL) + KEY_BYTES)).first()[0] or 0
    return fleet.join(F.broadcast(keys), SERIAL, "left_semi") if size <= BROADCAST_BYTES else fleet


def respond(requests: DataFrame, fleet: DataFrame, score: Score, as_of: str) -> DataFrame:
    """``request_id, serial_no, found, error, metadata, prediction`` per request.

    Codes count as often as they are listed; null and empty lists change nothing, nor do
    null or unknown codes. A motor not in ``fleet`` (one row per serial), or a null
    serial, gives an error text and null metadata and prediction."""
    adjusted = apply_checklist(fleet, checklist_counts_per_request(requests))
    scored = score(adjusted.withColumn(SERIAL, F.col("serial_no")).drop("health_score"))
    found = F.col("found")
    missing = F.concat(F.lit("Motor "), F.coalesce("serial_no", F.lit("")), F.lit(" not found"))
    keep = [F.col("request_id"), F.col("serial_no"), found, F.when(~found, missing).alias("error"),
            F.when(found, SC.motor_metadata()).alias("metadata")]
    return SC.prediction_record(scored, as_of, keep=keep).drop(SERIAL).withColumn("prediction", F.when(found, F.col("prediction")))


def answer_batch(batch: DataFrame, batch_id: int, snapshots: Manifest, scorer: Callable[[SparkSession, Published], Score],
                 sink_dir: str, as_of: str | None = None) -> None:
    """One micro-batch: read the set in force, answer, replace the batch's folder."""
    spark = batch.sparkSession
    current = snapshots.current(spark)
    if current is None:
        raise RuntimeError(f"no set is published under {snapshots.root}")
    fleet = asked_motors(batch, spark.read.parquet(current.paths["latest"]))
    answers = respond(batch, fleet, scorer(spark, current), as_of or _dt.date.today().isoformat())
    answers.withColumn("snapshot_version", F.lit(current.version).cast("long")).write.mode("overwrite").parquet(f"{sink_dir}/batch_id={batch_id}")


def start_response_stream(spark: SparkSession, source_dir: str, snapshots: Manifest, scorer: Callable[[SparkSession, Published], Score],
                          sink_dir: str, checkpoint_dir: str, as_of: str | None = None, files_per_batch: int = 1000,
                          available_now: bool = True) -> StreamingQuery:
    """Answers the request files of ``source_dir``; ``as_of`` None means the day a batch runs."""
    stream = spark.readStream.schema(REQUEST_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(source_dir)
    writer = (stream.writeStream.option("checkpointLocation", checkpoint_dir)
              .foreachBatch(lambda batch, batch_id: answer_batch(batch, batch_id, snapshots, scorer, sink_dir, as_of)))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def model_scorer(kind: str, part: str) -> Callable[[SparkSession, Published], Score]:
    """Scores by the fitted model that a set holds under ``part``; loaded once a version."""
    from motorlytics.plans.lifecycle import with_model_scores
    from motorlytics.sources.io import load_model
    loaded: dict[int, object] = {}

    def scorer(spark: SparkSession, current: Published) -> Score:
        if current.version not in loaded:
            loaded.clear()
            loaded[current.version] = load_model(current.paths[part], kind)
        return lambda rows: with_model_scores(loaded[current.version], rows)
    return scorer
