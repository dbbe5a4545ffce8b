"""Student rows rolled up to cells, and the measures cells share within a room or code.

The student table is shuffled once, as partial aggregates (one row per room and
program code), so a room or an "unassigned" code that holds a large part of all
students arrives as a handful of rows.  The decoded cells are then placed by
snapshot and homeroom code.  Every later grouping - campus, room, class type,
homeroom code - contains those two keys, so it runs in place without a further
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomledger.config import ELD_LEVELS, Rules
from roomledger.functions.calendar import birth_date
from roomledger.functions.nulls import has_pattern, not_blank, one_of
from roomledger.operators.enrollment import (
    decode_program,
    in_scope,
    merge_campuses,
    with_program_code,
)

CODE = ("snapshot_date", "homeroom")
ROOM = (*CODE, "sch")
COUNTS = (*(f"eld{n}" for n in ELD_LEVELS), "snCount", "otherIEP")


def iep_level(sncode: Column) -> Column:
    """Level digit of a special-education code; NULL when it is not a digit.

    Tested first: a tolerant cast would raise and catch an exception per blank code.
    """
    digit = F.substring(sncode, 2, 1)
    return F.when(digit.between("0", "9"), digit.cast("int"))


def program_type_key(prgmtype: Column) -> Column:
    """Program type without punctuation and case, e.g. ``Sub-Sep`` -> ``subsep``."""
    return F.lower(F.regexp_replace(prgmtype, r"(?U)[^\p{Alnum}]", ""))


def student_cells(students: DataFrame, rules: Rules, *extra_keys: str) -> DataFrame:
    """Counts and extremes per room as enrolled (before campus merging) and program code."""
    born, eld = F.col("born"), F.trim("mostrecenteld")
    return (
        with_program_code(in_scope(students, rules), rules)
        .withColumn("born", birth_date(F.col("dob")))
        .groupBy("snapshot_date", "sch", "homeroom", "programcode", *extra_keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(not_blank(F.col("sncode"))).alias("snCount"),
            F.count_if(one_of(iep_level(F.col("sncode")), (1, 2))).alias("otherIEP"),
            *[F.count_if(eld == level).alias(f"eld{level}") for level in ELD_LEVELS],
            F.count("gradenum").alias("grades_known"),
            F.min("gradenum").alias("low"),
            F.max("gradenum").alias("high"),
            F.count(born).alias("births_known"),
            F.min(born).alias("first_birth"),
            F.max(born).alias("last_birth"),
            F.min("studentno").alias("first_seen"),
        )
    )


def decoded_cells(
    own_cells: DataFrame, split_schools: DataFrame, codes: DataFrame, rules: Rules
) -> DataFrame:
    """Student cells with merged campus and decoded program, placed by snapshot and homeroom code."""
    cells = merge_campuses(own_cells, split_schools, rules)
    sei = has_pattern(F.col("projection_group"), rules.sei_group_pattern)
    return (
        decode_program(cells, codes)
        .select(
            *cells.columns,
            "classtype",
            sei.cast("int").alias("seiFlag"),
            program_type_key(F.col("prgmtype")).alias("program_type"),
        )
        .repartition(*CODE)
    )


def with_campus_span(cells: DataFrame) -> DataFrame:
    """Age spread in days of the room on its own campus; NULL if any birth date is unreadable."""
    campus = Window.partitionBy(*CODE, "campus")
    complete = F.sum("births_known").over(campus) == F.sum("n").over(campus)
    days = F.datediff(F.max("last_birth").over(campus), F.min("first_birth").over(campus))
    return cells.withColumn("dobDaySpan", F.when(complete, days))


def with_mode_grade(cells: DataFrame) -> DataFrame:
    """Most frequent grade of a homeroom code; the one seen first wins a tie, and a
    missing grade can win.  Needs cells split by ``grade``."""
    by_grade = Window.partitionBy(*CODE, "grade")
    rank = F.struct(F.col("grade_n"), -F.col("grade_seen"))
    return (
        cells.withColumn("grade_n", F.sum("n").over(by_grade))
        .withColumn("grade_seen", F.min("first_seen").over(by_grade))
        .withColumn("mode_grade", F.max_by("grade", rank).over(Window.partitionBy(*CODE)))
        .drop("grade_n", "grade_seen")
    )


def type_counts(cells: DataFrame) -> DataFrame:
    """Students per room, class type and SEI flag."""
    return cells.groupBy(*ROOM, "classtype", "seiFlag").agg(F.sum("n").alias("totalStudents"))


def with_type_total(cells: DataFrame) -> DataFrame:
    """Put on each cell the number of students in its room with its class type and SEI flag."""
    group = Window.partitionBy(*ROOM, "classtype", "seiFlag")
    return cells.withColumn("type_n", F.sum("n").over(group))
