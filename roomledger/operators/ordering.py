"""The place of each row in one order over all rows, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roomledger.operators.reports import in_order
from roomledger.plans.staging import Staging

#: Bits of a generated row number that count the rows of a partition; the others hold the partition.
_IN_PARTITION = 33


def with_position(rows: DataFrame, order: tuple[str, ...], staging: Staging, name: str = "position") -> DataFrame:
    """``rows`` with their position, from 1, in ascending order with missing values last.

    Rows are dealt to partitions by ranges of the order, sorted in each and written with their place
    there.  Only the number of rows per partition is summed up in one task.  Columns that are not in
    ``order`` come after it, so that rows of one rank get a defined place and many rows that share
    a school or a day are spread over several partitions; only equal rows are interchangeable.
    """
    keys = in_order(*order, *(c for c in rows.columns if c not in order))
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    numbered = ordered.withColumn("_row", F.monotonically_increasing_id())
    part = F.shiftright("_row", _IN_PARTITION).cast("int").alias("_part")
    place = F.col("_row").bitwiseAND((1 << _IN_PARTITION) - 1).alias("_place")
    placed = staging.keep(numbered.select("*", part, place).drop("_row"), "ordered")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    position = (F.col("_before") + F.col("_place") + 1).alias(name)
    return placed.join(before, "_part").select(position, *rows.columns)
