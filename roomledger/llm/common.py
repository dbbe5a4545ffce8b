"""What the corpus operators share: table access, staging in the cluster's shared folder, worker set-up."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])
_own: dict[str, str] = {}
_scopes: list[list[str]] = []
_held: dict[Hashable, Any] = {}
#: Bytes of texts that go to a worker at once; a batch ends with the row that reaches them.
BATCH_BYTES = 4_000_000
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready_workers(spark: SparkSession) -> None:
    """Python workers find this package where it is installed at the same path on every machine.

    On clusters that ship code with the job, `--py-files` does the same.
    """
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, known]))


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to workers and come back in batches of BATCH_BYTES, unless the session has its own limit.

    Spark's own is 64 MB, in memory as rows, Arrow vectors and messages on both sides, for each core of an executor.
    """
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """What `make` gives, kept by this worker process until it is asked for another key.

    Workers outlive jobs, so what an operator has cached would otherwise stay beside all that later ones need.
    """
    if key not in _held:
        drop_held()
        _held[key] = make()
    return _held[key]


def drop_held() -> None:
    """For the tasks of operators that hold nothing: what others have left goes first, back to the system.

    C's allocator keeps what is freed, so all workers of an executor would stay as large as they ever were.
    """
    _held.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as `spark.checkpoint.dir` names it.

    Only a single-process session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or _own.get(context.applicationId)
    if not base:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own[context.applicationId] = tempfile.mkdtemp(prefix="roomledger-")
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; nothing is there yet."""
    path = f"{shared_dir(spark)}/roomledger-llm/{name}-{uuid.uuid4().hex}"
    for scope in _scopes[-1:]:
        scope.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of `scratch`, through the file system that its path names."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """What is staged inside goes at the end, also after an error: nothing lazy may leave the block."""
    scope: list[str] = []
    _scopes.append(scope)
    try:
        yield
    finally:
        _scopes.remove(scope)
        for path in scope:
            remove(spark, path)


def staged(spark: SparkSession, frame: DataFrame, name: str) -> DataFrame:
    """`frame` written to the shared folder and read back: cuts lineage and survives lost executors."""
    path = scratch(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def free_name(frame: DataFrame, name: str) -> str:
    """`name`, or a longer one, that no column of `frame` has (names differ by more than case)."""
    taken = {column.lower() for column in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name
