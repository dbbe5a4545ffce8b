"""Cleaning and decoding of student rows.

Every step works as well on student rows as on pre-aggregated rows that still
carry the columns it reads, so the room reports can aggregate first and decode
the much smaller result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomledger.config import Rules
from roomledger.functions.calendar import birth_date, school_year
from roomledger.functions.measures import round2
from roomledger.functions.nulls import same
from roomledger.sources.inputs import active_split_schools


def in_scope(students: DataFrame, rules: Rules) -> DataFrame:
    """Students of the schools reported on; a student without a school is out as well."""
    return students.where(F.col("sch") != rules.excluded_school)


def missing_program(students: DataFrame) -> DataFrame:
    """How many students of each snapshot have no program code."""
    code = F.col("projection_group")
    return students.groupBy("snapshot_date").agg(
        F.count_if(code.isNull() | (code == "")).alias("students_without_program"),
        F.count(F.lit(1)).alias("students"),
    )


def dob_span(students: DataFrame, rules: Rules) -> DataFrame:
    """Age spread of each room as it was before campuses were merged.

    A room with any unreadable birth date has no spread.
    """
    born = students.select(
        "snapshot_date", "sch", "homeroom", birth_date(F.col("dob")).alias("born")
    )
    days = F.datediff(F.max("born"), F.min("born"))
    spans = born.groupBy("snapshot_date", "sch", "homeroom").agg(
        F.when(F.count("born") == F.count(F.lit(1)), days).alias("dobDaySpan")
    )
    return with_month_span(spans, rules)


def with_month_span(rooms: DataFrame, rules: Rules) -> DataFrame:
    months = round2(F.col("dobDaySpan") / F.lit(rules.days_per_month))
    return rooms.withColumn("dobMonthSpan", months)


def with_program_code(students: DataFrame, rules: Rules) -> DataFrame:
    """Every inclusion variant (a code ending in 3) counts under the one inclusion group."""
    code = F.col("projection_group")
    merged = F.when(code.endswith("3"), rules.inclusion_group).otherwise(code)
    return students.withColumn("programcode", merged).drop("projection_group")


def merge_campuses(students: DataFrame, split_schools: DataFrame, rules: Rules) -> DataFrame:
    """Replace the code of a merged campus; the old one stays as ``campus``.

    ``sch`` is never NULL here (see :func:`in_scope`), so plain equality is enough.
    """
    merges = active_split_schools(split_schools, rules).select(
        F.col("sch").alias("campus"), "new_sch"
    )
    return (
        students.withColumnRenamed("sch", "campus")
        .join(merges, "campus", "left")
        .withColumn("sch", F.coalesce("new_sch", "campus"))
        .drop("new_sch")
    )


def decode_program(students: DataFrame, codes: DataFrame) -> DataFrame:
    """Look up group, class type and program type of each program code."""
    decode = codes.select(
        F.col("programcode").alias("listed_code"), "projection_group", "classtype", "prgmtype"
    )
    return students.join(
        decode, same(F.col("programcode"), F.col("listed_code")), "left"
    ).drop("listed_code")


def enrollment(students: DataFrame, split_schools: DataFrame, codes: DataFrame, rules: Rules):
    """Clean student rows: one per student and snapshot unless a lookup table repeats a key."""
    named = in_scope(students, rules).withColumnRenamed("mostrecenteld", "eld")
    merged = merge_campuses(named, split_schools, rules)
    decoded = decode_program(with_program_code(merged, rules), codes)
    return decoded.withColumn("sch_year", school_year(F.col("snapshot_date")))


def with_dob_span(enrolled: DataFrame, students: DataFrame, rules: Rules) -> DataFrame:
    """Attach each student's room spread, computed per room rather than over student windows."""
    spans = dob_span(in_scope(students, rules), rules).select(
        F.col("snapshot_date").alias("span_date"),
        F.col("sch").alias("span_campus"),
        F.col("homeroom").alias("span_room"),
        "dobDaySpan",
        "dobMonthSpan",
    )
    match = (
        (F.col("snapshot_date") == F.col("span_date"))
        & (F.col("campus") == F.col("span_campus"))
        & same(F.col("homeroom"), F.col("span_room"))
    )
    return enrolled.join(spans, match, "left").drop("span_date", "span_campus", "span_room")
