"""The set of input tables a job works on, and the readers that produce it."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomledger import schemas


@dataclass(frozen=True)
class Inputs:
    """One lazily read DataFrame per input table."""

    students: DataFrame
    program_codes: DataFrame
    class_limits: DataFrame
    inclusion_ratios: DataFrame
    split_schools: DataFrame
    school_names: DataFrame
    homeroom_crosswalk: DataFrame
    structure_data: DataFrame
    school_directory: DataFrame | None = None


def read_table(
    spark: SparkSession, path: str, schema: str, fmt: str = "parquet", **options: str
) -> DataFrame:
    """A table with a fixed schema from any Spark file format."""
    return spark.read.format(fmt).options(**options).schema(schema).load(path)


def read_jdbc(spark: SparkSession, url: str, table: str, schema: str, **options: str) -> DataFrame:
    """A database table with a fixed schema; column and row filters are pushed into the database.

    Name ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions``
    among the options to read with several tasks.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    found = reader.options(**options).load()
    fields = T.StructType.fromDDL(schema).fields
    return found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def read_snapshots(
    spark: SparkSession,
    path: str,
    dates: Iterable[str] | None = None,
    fmt: str = "parquet",
    **options: str,
) -> DataFrame:
    """Student snapshots of the given days, or the whole history.

    The table is partitioned by ``snapshot_date``, so the date filter prunes
    directories and the column list prunes what is read from each file.
    """
    students = read_table(spark, path, schemas.STUDENT_SNAPSHOTS, fmt, **options)
    if dates is not None:
        students = students.where(F.col("snapshot_date").isin(*[_as_date(d) for d in dates]))
    return students.select(*schemas.STUDENT_COLUMNS)


def read_csv_export(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV export in which ``NA`` means missing and an empty text cell is empty text.

    Spark reads an empty cell as NULL and leaves ``NA`` as text, so reading every
    column as text keeps the two apart until they are given their meaning here.
    Numbers may have blanks around them and be written as whole decimals (``20.0``).
    A cell of a number column that is neither blank, ``NA`` nor a whole number
    fails the read, naming its column and file.  ``row_id`` keeps the order of the
    lines in the file.
    """
    fields = T.StructType.fromDDL(schema).fields
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in fields])
    raw = spark.read.schema(as_text).option("header", True).csv(path)

    def value(field: T.StructField):
        cell = F.col(field.name)
        if isinstance(field.dataType, T.StringType):
            typed = F.when(cell.isNull(), "").when(cell != "NA", cell)
        else:
            text = F.trim(cell)
            number = text.try_cast("decimal(38,9)")
            whole = F.when(number == F.floor(number), number.try_cast(field.dataType))
            unreadable = F.raise_error(
                F.concat(
                    F.lit(f"{field.name}: no whole number: '"),
                    cell,
                    F.lit("' in "),
                    F.col("_metadata.file_path"),
                )
            )
            blank = cell.isNull() | text.isin("", "NA")
            typed = F.when(~blank, F.coalesce(whole, unreadable.cast(field.dataType)))
        return typed.alias(field.name)

    line = F.struct(
        F.col("_metadata.file_path"),
        F.col("_metadata.file_block_start"),
        F.monotonically_increasing_id().alias("line"),
    )
    return raw.select(line.alias("row_id"), *[value(f) for f in fields])


def write_csv_export(rows: DataFrame, path: str, schema: str) -> None:
    """The columns of ``schema`` as CSV files that :func:`read_csv_export` reads back to the same values.

    Lines keep the order that ``rows`` has over all its partitions.
    """
    fields = T.StructType.fromDDL(schema).fields
    cells = [F.coalesce(F.col(f.name).cast("string"), F.lit("NA")).alias(f.name) for f in fields]
    rows.select(*cells).write.option("header", True).option("emptyValue", "").csv(path)


def active_split_schools(split_schools: DataFrame, rules) -> DataFrame:
    """Campus merges still in force, without the ones the district ignores."""
    ignored = F.coalesce(F.col("sch").isin(*rules.ignored_campus_merges), F.lit(False))
    return split_schools.where(F.col("final_year").isNull() & ~ignored)


def _as_date(day) -> Column:
    return F.lit(str(day)).cast("date")
