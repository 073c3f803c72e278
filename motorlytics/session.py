"""Session helpers.

The library never overrides cluster settings that are already present; it only
fills in what a local test run needs.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings a local run needs. On a cluster these come from spark-defaults.
_LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "8g",  # local mode: the driver JVM is the only executor
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "motorlytics", extra: dict | None = None) -> SparkSession:
    """Create (or fetch) a session with the defaults the library expects."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is. Only when it is unset (local tests) a private scratch folder is made.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: no driver context; the server owns checkpoints
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder") from None
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if sc.master.startswith("local"):
            configured = tempfile.mkdtemp(prefix="motorlytics-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        else:
            raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cluster_settings(input_bytes: int, target_partition_bytes: int = 256 << 20,
                     broadcast_bytes: int = 64 << 20) -> dict[str, str]:
    """Settings sized from the input so that each task's partition fits in
    executor memory. Meant for a cluster's spark-defaults; the library never
    applies them over existing settings.

    * file splits and shuffle partitions target ``target_partition_bytes``
      (AQE coalesces small ones and splits skewed ones at run time);
    * the initial shuffle partition count covers the whole input at that size
      (e.g. 100 TB / 256 MB = 409,600), so the heaviest stage — the fact
      shuffle of the motor-history window — does not spill at 1000 executors;
    * broadcasting is decided by measured runtime size, never by hint, for
      any data-sized table.
    """
    parts = max(200, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(broadcast_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(broadcast_bytes),
    }
