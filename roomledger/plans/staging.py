"""Intermediate tables in the cluster's shared folder.

A staged table cuts lineage (a lost executor costs a re-read, not a recomputation)
and tells the planner its true size, so a join with it is broadcast only when it
is known to be small and shuffled otherwise.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

SHARED_FOLDER = "spark.checkpoint.dir"


_own: dict[str, str] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """A path where nothing is yet, in the folder that all executors share.

    A session that names no such folder gets one of its own, if it is a single process.
    """
    context = spark.sparkContext
    base = spark.conf.get(SHARED_FOLDER, None) or _own.get(context.applicationId)
    if base is None:
        if not context.master.startswith("local["):
            raise ValueError(f"set {SHARED_FOLDER} to a folder every executor can reach")
        base = _own[context.applicationId] = tempfile.mkdtemp(prefix="roomledger-")
    return f"{base.rstrip('/')}/roomledger-{uuid.uuid4().hex}/{name}"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder through the file system its path names, if it is there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@dataclass(frozen=True)
class Staging:
    """A folder of its own for each run; without one, tables are passed on unwritten."""

    folder: str | None

    @classmethod
    def of(cls, spark: SparkSession) -> Staging:
        """Staging for a lazy result, which reads the tables later: they are not removed.

        Queries stage no student rows.  A session that names no shared folder stages nothing.
        """
        named = spark.conf.get(SHARED_FOLDER, None)
        return cls(named and f"{named}/roomledger-{uuid.uuid4().hex}")

    @classmethod
    @contextmanager
    def during(cls, spark: SparkSession) -> Iterator[Staging]:
        """Staging for a job; its folder is removed when the job ends, also when it fails."""
        staging = cls.of(spark)
        if staging.folder is None:
            raise ValueError(f"set {SHARED_FOLDER} to a folder every executor can reach")
        try:
            yield staging
        finally:
            delete_folder(spark, staging.folder)

    def keep(self, rows: DataFrame, name: str) -> DataFrame:
        """Write the rows once and return the written table."""
        if self.folder is None:
            return rows
        path = f"{self.folder}/{name}"
        rows.write.mode("errorifexists").parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)
