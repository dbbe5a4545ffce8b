"""The published tables.

Sorted reports end in a range-partitioned sort.  Each order ends in a key that
tells rows apart, so a school or room holding much of the data is spread over
several sort partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomledger.config import Rules
from roomledger.functions.calendar import school_year
from roomledger.operators.rooms import with_school_name

# Published column titles.
REPORT_TITLES = {
    "sch": "School Code",
    "schname": "School Name",
    "grade": "Grade",
    "hrClasstype": "Class Type",
    "homeroom": "Homeroom",
    "homeroom_flag": "Homeroom Flag",
    "issueFlag": "Issue Flag",
    "tot_capacity": "Capacity",
    "totalStudents": "Total Students",
    "seats": "Available Seats",
    "noIEP": "No IEP",
    "inclusion": "Inclusion",
    "subsep": "Sub Seperate",
    "otherIEP": "Other IEPs",
    "snCount": "Total IEPs",
    "btu_max": "Pct of BTU Max",
    "btu_limit": "BTU Limit",
    "snPct": "Pct of Enrollment",
}
REPORT_COLUMNS = (*REPORT_TITLES, "dobMonthSpan", "eld1", "eld2", "eld3", "eld4")
# Published layouts of the capacity sheet and the student list.
CAPACITY_SHEET_COLUMNS = (
    "snapshot_date",
    "sch",
    "schname",
    "grade",
    "minGradenum",
    "maxGradenum",
    "hrClasstype",
    "homeroom",
    "capacity",
    "totalStudents",
    "seats",
    "gened",
    "inclusion",
    "subsep",
    "sei",
    "bilingual",
    "eld1",
    "eld2",
    "eld3",
    "eld4",
    "genedCap",
    "spedCap",
    "snCount",
    "snPct",
    "dobDaySpan",
    "dobMonthSpan",
)
STUDENT_LIST_COLUMNS = (
    "snapshot_date",
    "sch",
    "schname",
    "homeroom",
    "studentno",
    "studentname",
    "grade",
    "programcode",
    "lepstatus",
    "eld",
    "firstlang",
    "sncode",
)
STUDENT_LIST_ORDER = ("snapshot_date", "sch", "homeroom", "programcode", "gradenum", "studentno")
CAPACITY_SHEET_ORDER = ("snapshot_date", "schname", "minGradenum", "maxGradenum", "homeroom", "sch")
REPORT_ORDER = ("snapshot_date", "sch", "schname", "groups", "minGradenum", "homeroom")
ERROR_ORDER = ("snapshot_date", "homeroom", "sch", "studentno")


def in_order(*columns: str) -> list[Column]:
    """Ascending with missing values last."""
    return [F.col(c).asc_nulls_last() for c in columns]


def sorted_globally(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """``rows`` in one order over all partitions.

    A global sort reads its input twice, first for a sample.  Rebalanced rows lie
    finished in a shuffle by then, so what made them runs once.
    """
    return rows.hint("rebalance").orderBy(*in_order(*order))


def student_list(enrolled: DataFrame, school_names: DataFrame) -> DataFrame:
    """Every student with school name, unsorted; keeps ``gradenum`` for the sort."""
    return with_school_name(enrolled, school_names).select(*STUDENT_LIST_COLUMNS, "gradenum")


def sorted_student_list(enrolled: DataFrame, school_names: DataFrame) -> DataFrame:
    rows = student_list(enrolled, school_names)
    return rows.orderBy(*in_order(*STUDENT_LIST_ORDER)).drop("gradenum")


def capacity_sheet(rooms: DataFrame) -> DataFrame:
    """Rooms with rule-based capacity, for placing students with special-education plans."""
    return sorted_globally(rooms.select(*CAPACITY_SHEET_COLUMNS), CAPACITY_SHEET_ORDER)


def with_listed_capacity(rooms: DataFrame, capacities: DataFrame) -> DataFrame:
    """Swap the rule-based capacity for the capacity on record for the homeroom code.

    Matched on code and school year only: a code used in several schools takes
    every capacity on record for it.  The code is never missing in a report room.
    """
    recorded = capacities.select(
        F.col("homeroom").alias("listed_room"), F.col("sch_year").alias("listed_year"), "tot_capacity"
    )
    match = (F.col("homeroom") == F.col("listed_room")) & (
        school_year(F.col("snapshot_date")) == F.col("listed_year")
    )
    return (
        rooms.drop("capacity", "seats")
        .join(recorded, match, "left")
        .withColumn("seats", F.col("tot_capacity") - F.col("totalStudents"))
        .drop("listed_room", "listed_year")
    )


def report_rows(rooms: DataFrame, capacities: DataFrame) -> DataFrame:
    """Unsorted rows of the district report under their internal names, with the sort keys."""
    listed = with_listed_capacity(rooms, capacities)
    return listed.select("snapshot_date", *REPORT_COLUMNS, "groups", "minGradenum")


def title_columns(columns: tuple[str, ...]) -> list[Column]:
    """Published titles, led by the day the report is of."""
    updated = F.date_format("snapshot_date", "yyyy-MM-dd").alias("report_updated")
    return [updated, *[F.col(c).alias(REPORT_TITLES.get(c, c)) for c in columns]]


def titled(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return rows.select(*title_columns(columns))


def district_report(rooms: DataFrame, capacities: DataFrame) -> DataFrame:
    rows = sorted_globally(report_rows(rooms, capacities), REPORT_ORDER)
    return titled(rows, REPORT_COLUMNS)


def school_rows(rows: DataFrame, rules: Rules) -> DataFrame:
    """The school version calls a room of the youngest grades a homeroom."""
    young = F.col("grade") == rules.young_grades
    return rows.withColumn(
        "hrClasstype", F.when(young, "Homeroom").otherwise(F.col("hrClasstype"))
    )


SCHOOL_REPORT_COLUMNS = tuple(c for c in REPORT_COLUMNS if not c.startswith("eld"))


def school_report(rooms: DataFrame, capacities: DataFrame, rules: Rules) -> DataFrame:
    rows = sorted_globally(school_rows(report_rows(rooms, capacities), rules), REPORT_ORDER)
    return titled(rows, SCHOOL_REPORT_COLUMNS)


def student_errors(flagged: DataFrame) -> DataFrame:
    return sorted_globally(flagged, ERROR_ORDER)
