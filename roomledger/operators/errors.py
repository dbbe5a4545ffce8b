"""Rooms that look wrong and the students who look misplaced in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomledger.config import Rules
from roomledger.functions.nulls import has_pattern, one_of, same
from roomledger.operators.cells import CODE
from roomledger.operators.enrollment import decode_program
from roomledger.operators.metrics import with_real_code
from roomledger.operators.rooms import with_school_name


def known_types(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Class types seen in each snapshot (a missing type counts as seen), from students or cells.

    Codes are made distinct before they are decoded, so a few rows per task are shuffled.
    """
    used = rows.select("snapshot_date", "programcode").distinct()
    return decode_program(used, codes).select("snapshot_date", "classtype").distinct()


def error_rooms(rooms: DataFrame, types: DataFrame, rules: Rules) -> DataFrame:
    """Rooms of an unknown type, and regular rooms that span grades, with their exceptions."""
    seen = types.select(
        F.col("snapshot_date").alias("seen_date"),
        F.col("classtype").alias("seen_type"),
        F.lit(True).alias("seen"),
    )
    match = (F.col("snapshot_date") == F.col("seen_date")) & same(
        F.col("hrClasstype"), F.col("seen_type")
    )
    room_type = F.col("hrClasstype")
    known = F.col("seen").isNotNull() | one_of(room_type, rules.renamed_types)
    spans_grades = (
        one_of(room_type, rules.regular_types)
        & (F.col("minGradenum") != F.col("maxGradenum"))
        & (F.col("grade") != rules.young_grades)
        & (F.col("sch") != rules.multigrade_school)
    )
    mixed_slife = has_pattern(room_type, rules.mixed_slife_pattern)
    error = F.when(mixed_slife, 0).when(spans_grades, 1).when(known, 0).otherwise(1)
    return (
        rooms.join(seen, match, "left")
        .withColumn("error", error)
        .where(F.col("error") == 1)
        .drop("seen_date", "seen_type", "seen")
    )


def error_codes(rooms_in_error: DataFrame) -> DataFrame:
    """Homeroom codes to check: usual grade and dominant types, ties counted in ``copies``."""
    codes = rooms_in_error.groupBy(*CODE).agg(
        F.first("mode_grade").alias("mode_grade"), F.first("dominant").alias("dominant")
    )
    return codes.select(*CODE, "mode_grade", F.inline("dominant")).withColumnRenamed(
        "classtype", "dominant_type"
    )


def misplaced_students(
    enrolled: DataFrame, codes: DataFrame, school_names: DataFrame, rules: Rules
) -> DataFrame:
    """Students who differ from the dominant type or usual grade of their homeroom code.

    A student appears once per tied dominant group, as many times as the group
    occurs; those repeats are made after the filter, not carried through the join.
    Students without a real code are left out at the scan.
    """
    own, dominant = F.col("classtype"), F.col("dominant_type")
    regular_guest = (dominant == "Gen Ed") & (own == "Inclusion")
    wrong_grade = one_of(dominant, rules.regular_types) & (F.col("grade") != F.col("mode_grade"))
    flag = (
        F.when(own == dominant, F.when(wrong_grade, "Check Grade"))
        .when(regular_guest, None)
        .otherwise("Program or School Error")
    )
    flagged = (
        with_real_code(enrolled)
        .join(codes, [*CODE], "inner")
        .where(F.col("sch") != rules.multigrade_school)
        .withColumn("error_flag", flag)
        .where(F.col("error_flag").isNotNull())
    )
    repeated = flagged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return with_school_name(repeated, school_names).select(
        "snapshot_date",
        "sch",
        "schname",
        "studentno",
        "error_flag",
        "studentname",
        "grade",
        "homeroom",
        "programcode",
        "lepstatus",
        "eld",
        "sncode",
    )
