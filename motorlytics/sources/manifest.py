"""Sets of artefacts that are replaced as a whole.

A set (models, metadata, report, serving tables) is written to a folder of its own; one
manifest row, written last, names it. The row is a file of a single task, so it appears
by one rename: a reader sees the whole new set or the whole old one, and a run that dies
before the row leaves the old set in force. One publisher writes at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST_SCHEMA = "version long, folder string, parts array<string>"


class Published(NamedTuple):
    version: int
    paths: dict[str, str]


class Manifest:
    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def rows(self, spark: SparkSession) -> DataFrame | None:
        """All published sets; None before the first."""
        try:
            return spark.read.schema(MANIFEST_SCHEMA).json(f"{self.root}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def current(self, spark: SparkSession, version: int | None = None) -> Published | None:
        """The newest set, or that of ``version``; None if there is none."""
        rows = self.rows(spark)
        if rows is None:
            return None
        if version is not None:
            rows = rows.where(F.col("version") == version)
        row = rows.orderBy(F.col("version").desc()).first()
        return row and Published(row["version"], {name: f"{row['folder']}/{name}" for name in row["parts"]})

    def publish(self, spark: SparkSession, parts: dict[str, Callable[[str], object]]) -> Published:
        """Writes each part by its function of a path, then the row that puts the set in force."""
        folder = f"{self.root}/sets/{uuid.uuid4().hex}"
        for name, write in parts.items():
            write(f"{folder}/{name}")
        before = self.current(spark)
        version = before.version + 1 if before else 1
        row = spark.createDataFrame([(version, folder, list(parts))], MANIFEST_SCHEMA)
        row.coalesce(1).write.mode("append").json(f"{self.root}/manifest")
        return Published(version, {name: f"{folder}/{name}" for name in parts})
