"""Published tables in versions, of which readers see one at a time.

A run writes every table into folders of its own, beside what is published.  When all of them are
there, one small file, the commit record, makes them the version that readers see: for each
snapshot day it names the run whose rows stand, in every table.  So a reader sees the old or the
new rows of a day, never none, a part, or tables of different runs.

Records are numbered, and a record is put in place by a rename that fails if its number is taken;
then the newer record is read, and the run's days go on top of it.  A run that fails before its
commit leaves folders that nobody reads.  Superseded folders are removed by :func:`remove_old`,
once readers of older records are done.

On a file system whose renames do not refuse an existing target (object stores), let one job
commit at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from roomledger.plans.staging import delete_folder

RECORDS = "_published"
_STARTED = "%Y%m%dT%H%M%S"
#: Options by which a text table is written and read back to the same values: a missing value is an empty cell, an
#: empty text is an empty cell in quotes.  On reading, the control character stands for cells without any quotes.
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
CSV_READ = CSV | {"nullValue": "\x01"}


@dataclass(frozen=True)
class Table:
    """Where a table is under the output folder, its day column, and its format."""

    folder: str
    day: str = "snapshot_date"
    fmt: str = "parquet"


# -- files, through the file system that the path names ---------------------------------------


def _hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _hadoop_path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    files = _file_system(spark, path)
    if not files.exists(_hadoop_path(spark, path)):
        return []
    return [status.getPath().getName() for status in files.listStatus(_hadoop_path(spark, path))]


def _text(spark: SparkSession, path: str) -> str:
    stream = _file_system(spark, path).open(_hadoop_path(spark, path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Puts a whole file in place; False, and nothing changed, if there is one already."""
    jvm, files = spark._jvm, _file_system(spark, path)
    if files.exists(_hadoop_path(spark, path)):
        return False
    folder, name = path.rsplit("/", 1)
    draft = _hadoop_path(spark, f"{folder}/.{name}.{uuid.uuid4().hex}")
    stream = files.create(draft, False)
    stream.write(bytearray(text, "utf-8"))
    stream.close()
    target = files.makeQualified(_hadoop_path(spark, path))
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    no_options = spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(files.makeQualified(draft), target, no_options)
    except Exception as error:  # the gateway's wrapper of any Java exception
        files.delete(draft, False)
        if files.exists(target):
            return False
        raise error
    return True


# -- records ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Record:
    """What is published: the run of each day, the days that each run has rows of, and schemas."""

    number: int = 0
    days: dict[str, str] = field(default_factory=dict)
    written: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)

    def with_run(self, run: str, days: Iterable[str], written: dict, schemas: dict) -> Record:
        """The next record: the run's days replace those of earlier runs, in all tables."""
        days = self.days | dict.fromkeys(days, run)
        runs = set(days.values())
        known = {r: tables for r, tables in (self.written | {run: written}).items() if r in runs}
        return Record(self.number + 1, days, known, self.schemas | schemas)


def _record_path(out_dir: str, number: int) -> str:
    return f"{out_dir}/{RECORDS}/{number:020d}.json"


def record_numbers(spark: SparkSession, out_dir: str) -> list[int]:
    names = _names(spark, f"{out_dir}/{RECORDS}")
    return sorted(int(name.removesuffix(".json")) for name in names if name[:1] != "." and name.endswith(".json"))


def read_record(spark: SparkSession, out_dir: str, number: int | None = None) -> Record:
    """The record of that number, or the latest; an empty one if nothing is published."""
    numbers = record_numbers(spark, out_dir)
    if number is None and not numbers:
        return Record()
    return Record(**json.loads(_text(spark, _record_path(out_dir, numbers[-1] if number is None else number))))


# -- a run ------------------------------------------------------------------------------------


class Run:
    """One run's folders, unseen by readers until :meth:`commit`."""

    def __init__(self, spark: SparkSession, out_dir: str, tables: dict[str, Table]):
        started = datetime.now(timezone.utc).strftime(_STARTED)
        self.spark, self.out_dir, self.tables = spark, out_dir.rstrip("/"), tables
        self.id = f"{started}-{uuid.uuid4().hex[:12]}"
        self._schemas: dict[str, str] = {}

    def path(self, name: str) -> str:
        return f"{self.out_dir}/{self.tables[name].folder}/run={self.id}"

    def write(self, name: str, rows: DataFrame, *partitions: str) -> None:
        """Writes a table of this run by day, and by further columns below that."""
        table = self.tables[name]
        self._schemas[name] = rows.schema.json()
        writer = rows.write.mode("errorifexists").partitionBy(table.day, *partitions)
        if table.fmt == "csv":
            writer = writer.options(**CSV)
        writer.format(table.fmt).save(self.path(name))

    def commit(self, days: Iterable[str]) -> Record:
        """Publishes the run's tables as the rows of `days`, also of days without rows."""
        days, written = sorted(days), {}
        for name, table in self.tables.items():
            found = (part.partition("=") for part in _names(self.spark, self.path(name)))
            written[name] = sorted(value for column, _, value in found if column == table.day)
            strange = set(written[name]) - set(days)
            if strange:
                raise ValueError(f"{name} has rows of days that are not published: {sorted(strange)}")
        while True:
            record = read_record(self.spark, self.out_dir).with_run(self.id, days, written, self._schemas)
            if _put_new(self.spark, _record_path(self.out_dir, record.number), json.dumps(record.__dict__, indent=1)):
                return record

    def discard(self) -> None:
        """Removes what an unpublished run has written."""
        if self.id in read_record(self.spark, self.out_dir).days.values():
            return
        for name in self.tables:
            delete_folder(self.spark, self.path(name))


# -- readers ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Published:
    """All tables as one record has them; later runs do not change what it reads."""

    spark: SparkSession
    out_dir: str
    tables: dict[str, Table]
    record: Record

    @classmethod
    def latest(cls, spark: SparkSession, out_dir: str, tables: dict[str, Table]) -> Published:
        return cls(spark, out_dir.rstrip("/"), tables, read_record(spark, out_dir.rstrip("/")))

    def folders(self, name: str) -> list[str]:
        """Where the table's published rows are: a folder per day that has rows."""
        table, record = self.tables[name], self.record
        return [
            f"{self.out_dir}/{table.folder}/run={run}/{table.day}={day}"
            for day, run in sorted(record.days.items())
            if day in record.written[run][name]
        ]

    def table(self, name: str) -> DataFrame:
        table, folders = self.tables[name], self.folders(name)
        if name not in self.record.schemas:
            raise ValueError(f"{name} has never been published in {self.out_dir}")
        schema = T.StructType.fromJson(json.loads(self.record.schemas[name]))
        if not folders:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema).option("basePath", f"{self.out_dir}/{table.folder}")
        if table.fmt == "csv":
            reader = reader.options(**CSV_READ)
        return reader.format(table.fmt).load(folders).select(*schema.names)


def remove_old(
    spark: SparkSession, out_dir: str, tables: dict[str, Table], records: int = 2, hours: float = 24.0
) -> list[str]:
    """Removes day folders that none of the last `records` records names; returns their paths.

    Runs started less than `hours` ago are left alone: they may be about to commit.
    """
    out_dir = out_dir.rstrip("/")
    numbers = record_numbers(spark, out_dir)[-records:]
    used = {pair for n in numbers for pair in read_record(spark, out_dir, n).days.items()}
    latest = datetime.now(timezone.utc) - timedelta(hours=hours)
    removed = []
    for table in tables.values():
        for run in _names(spark, f"{out_dir}/{table.folder}"):
            column, _, run_id = run.partition("=")
            if column != "run":
                continue
            started = datetime.strptime(run_id.split("-")[0], _STARTED).replace(tzinfo=timezone.utc)
            if started > latest:
                continue
            path = f"{out_dir}/{table.folder}/{run}"
            parts = _names(spark, path)
            stay = [p for p in parts if (p.partition("=")[2], run_id) in used]
            gone = [f"{path}/{p}" for p in parts if p not in stay and "=" in p] if stay else [path]
            for folder in gone:
                delete_folder(spark, folder)
            removed += gone
    return removed
