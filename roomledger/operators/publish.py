"""What is published: per-school tables, and the manifest that lists them with their destinations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomledger.config import Rules
from roomledger.functions.calendar import school_year
from roomledger.operators.reports import (
    REPORT_ORDER,
    SCHOOL_REPORT_COLUMNS,
    in_order,
    school_rows,
    title_columns,
)

SCHOOL_TABS = ("room_report", "student_list", "student_errors")


def published_schools(rows: DataFrame, rules: Rules) -> DataFrame:
    return rows.where(~F.col("sch").isin(*rules.unpublished_schools))


def schools(enrolled: DataFrame, rules: Rules) -> DataFrame:
    """Schools that get a report of their own, per snapshot."""
    return published_schools(enrolled.select("snapshot_date", "sch"), rules).distinct()


def manifest(
    students: DataFrame, report: DataFrame, errors: DataFrame, base: str, rules: Rules, run: str | None = None
) -> DataFrame:
    """Where each school's report is, and how many rows each of its tabs has.

    The three tabs are counted per school before they meet, so the only rows
    shuffled are partial counts.  ``run`` names the run whose folders they are.
    """

    def counted(rows: DataFrame, tab: str) -> DataFrame:
        per_school = rows.groupBy("snapshot_date", "sch").agg(F.count(F.lit(1)).alias("n"))
        return per_school.select(
            "snapshot_date",
            "sch",
            *[
                (F.col("n") if name == tab else F.lit(0).cast("bigint")).alias(name)
                for name in ("students", "rooms", "errors")
            ],
        )

    tabs = counted(students, "students").unionByName(counted(report, "rooms"))
    tabs = tabs.unionByName(counted(errors, "errors"))
    location = F.concat(
        F.lit(f"{base}/{SCHOOL_TABS[0]}/{f'run={run}/' if run else ''}snapshot_date="),
        F.col("snapshot_date").cast("string"),
        F.lit("/school="),
        F.col("sch").cast("string"),
    )
    return (
        published_schools(tabs, rules)
        .groupBy("snapshot_date", "sch")
        .agg(
            F.sum("students").alias("students"),
            F.sum("rooms").alias("rooms"),
            F.sum("errors").alias("errors"),
        )
        .withColumn("location", location)
    )


def destinations(directory: DataFrame) -> DataFrame:
    """(sch, destination, folders): where each school's report goes, from the matched school directory.

    Of several folders that carry a school's name the first by id is taken; folders without a school are left out.
    """
    return (
        directory.where(F.col("sch").isNotNull())
        .groupBy("sch")
        .agg(F.min("folder_id").alias("destination"), F.count("folder_id").alias("folders"))
    )


def with_destinations(listing: DataFrame, directory: DataFrame) -> DataFrame:
    """The manifest with each school's folder and the name its report gets there.

    ``destination`` is missing for a school that no folder is named after.
    """
    placed = destinations(directory).withColumnRenamed("sch", "placed_school")
    title = F.concat(
        F.col("sch").cast("string"), F.lit(" - "), school_year(F.col("snapshot_date")), F.lit(" Homeroom Report")
    )
    found = listing.join(placed, F.col("sch") == F.col("placed_school"), "left").drop("placed_school")
    return found.withColumn("report_name", title)


def unplaced(listing: DataFrame) -> DataFrame:
    """Schools of the manifest whose report has nowhere to go."""
    return listing.where(F.col("destination").isNull()).select(
        "snapshot_date", "sch", "report_name", "students", "rooms", "errors"
    )


def school_tab(report: DataFrame, rules: Rules) -> tuple[DataFrame, tuple[str, ...]]:
    """The school report as published, with its sort keys kept apart as ``key_*`` columns."""
    keys = [F.col(c).alias(f"key_{c}") for c in REPORT_ORDER]
    rows = school_rows(report, rules).select(
        "snapshot_date", "sch", *title_columns(SCHOOL_REPORT_COLUMNS), *keys
    )
    return rows, tuple(f"key_{c}" for c in REPORT_ORDER)


def by_school(rows: DataFrame, order: tuple[str, ...], *dropped: str) -> DataFrame:
    """Rows with their ``school``, brought together and sorted for a write by day and school.

    Rows are brought together by school with a rebalance hint: Spark splits a
    school that holds far more rows than the others over several tasks and packs
    small schools together, using the sizes it has seen in the shuffle.
    """
    keyed = rows.withColumn("school", F.col("sch")).hint("rebalance", "snapshot_date", "school")
    ordered = keyed.sortWithinPartitions(F.col("snapshot_date"), F.col("school"), *in_order(*order))
    return ordered.drop(*dropped)
