"""Rooms: dominant class type, totals, classification, size limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomledger.config import PROGRAM_TYPES, Rules
from roomledger.functions.grades import grade_label, grade_range
from roomledger.functions.nulls import has_text, same
from roomledger.operators.cells import (
    CODE,
    COUNTS,
    ROOM,
    with_campus_span,
    with_type_total,
)
from roomledger.operators.enrollment import with_month_span


LIMITS = ("room_limit", "limit_with_para", "inclusion_limit")
GRADES = ("grade", "minGradenum", "maxGradenum")


def with_leading_groups(cells: DataFrame) -> DataFrame:
    """Mark the cells whose class type leads their room and counts under their homeroom code.

    The largest groups of a room lead it.  Where one homeroom code has several
    leading groups (in one room, or in rooms of several schools) Gen Ed and
    undecoded groups give way.  Everything put on a cell is a number: ``leads``,
    ``in_code`` (the group is as large as any under the code) and ``first_cell``
    (one cell of each group).
    """
    room, code = Window.partitionBy(*ROOM), Window.partitionBy(*CODE)
    group = Window.partitionBy(*ROOM, "classtype", "seiFlag")
    counted = with_type_total(cells).withColumns(
        {
            "room_n": F.max("type_n").over(room),
            "spans": F.collect_set(F.struct("dobDaySpan")).over(room),
            "first_cell": (F.row_number().over(group.orderBy("programcode")) == 1).cast("int"),
        }
    )
    largest = F.col("type_n") == F.col("room_n")
    leaders = F.sum(F.when(largest, F.col("first_cell"))).over(code)
    in_code = F.col("type_n") == F.max("type_n").over(code)
    leads = largest & ((F.col("leaders") == 1) | (F.col("classtype") != "Gen Ed"))
    return (
        counted.withColumns({"leaders": leaders, "in_code": in_code})
        .withColumn("leads", leads.cast("int"))
        .drop("leaders", "room_n")
    )


def with_code_type(marked: DataFrame) -> DataFrame:
    """Put the leading types of the homeroom code on all cells of each room it names.

    All rooms of a code that still have a leading group share the text
    ``code_type``, their types joined with ``+``; other rooms have none.  The list
    of leading groups is made among their cells only, joined once per code and
    dropped before the text is handed on, so the work grows with what is published.
    """
    leaders = Window.partitionBy(*CODE, "leads")
    is_leader = F.col("leads") == 1
    group = F.when(
        is_leader & (F.col("first_cell") == 1), F.struct("sch", "classtype", "seiFlag")
    )
    names = F.transform(F.sort_array("listed"), lambda g: F.coalesce(g["classtype"], F.lit("NA")))
    first = is_leader & (F.row_number().over(leaders.orderBy("sch")) == 1)
    return (
        marked.withColumns({"listed": F.collect_list(group).over(leaders), "first": first})
        .withColumn("text", F.when(F.col("first"), F.array_join(names, " + ")))
        .drop("listed", "first")
        .withColumn("text", F.max("text").over(leaders))
        .withColumn("code_type", F.max("text").over(Window.partitionBy(*ROOM)))
        .drop("text")
    )


def with_dominant_types(marked: DataFrame) -> DataFrame:
    """Class types of the largest groups under a homeroom code, over all its schools.

    ``dominant`` pairs each type with the number of groups of that size, so it is
    no longer than the list of class types.
    """
    of_type, code = Window.partitionBy(*CODE, "classtype"), Window.partitionBy(*CODE)
    largest = F.when(F.col("in_code"), F.col("first_cell"))
    pair = F.struct("classtype", F.col("copies").cast("int").alias("copies"))
    return (
        marked.withColumn("copies", F.sum(largest).over(of_type))
        .withColumn("dominant", F.collect_set(F.when(F.col("copies") > 0, pair)).over(code))
        .drop("copies")
    )


def class_type_max(rooms: DataFrame) -> DataFrame:
    """The leading class type of each room that has one."""
    return rooms.where(F.col("leading_type").isNotNull()).select(*ROOM, "leading_type")


def sei_max(counts: DataFrame, rules: Rules) -> DataFrame:
    """Largest SEI group of each room; a tie is named as mixed."""
    room = Window.partitionBy(*ROOM)
    largest = F.col("totalStudents") == F.max("totalStudents").over(room)
    return (
        counts.where(F.col("seiFlag") == 1)
        .withColumn("largest", largest)
        .where("largest")
        .groupBy(*ROOM)
        .agg(F.count(F.lit(1)).alias("ties"), F.max("classtype").alias("only_type"))
        .select(
            *ROOM,
            F.when(F.col("ties") > 1, rules.mixed_sei_label)
            .otherwise(F.col("only_type"))
            .alias("leading_sei"),
        )
    )


def room_totals(cells: DataFrame) -> DataFrame:
    """One row per room: counts, grade range and leading type.

    ``spans`` holds the room's distinct age spreads, several only for merged
    campuses.  Texts and lists that are the same for all cells of a room are
    grouping keys, so only numbers are aggregated and the hash aggregate stays in
    generated code.
    """
    named = with_code_type(with_leading_groups(with_campus_span(cells)))
    shared = ["code_type", "spans"]
    if "mode_grade" in cells.columns:
        named = with_dominant_types(named)
        shared += ["mode_grade", "dominant"]

    def of_type(name: str) -> Column:
        return F.sum(F.when(F.col("program_type") == name, F.col("n")).otherwise(0)).alias(name)

    all_known = F.sum("grades_known") == F.sum("n")
    rooms = named.groupBy(*ROOM, *shared).agg(
        F.sum("n").alias("totalStudents"),
        *[of_type(name) for name in PROGRAM_TYPES],
        *[F.sum(c).alias(c) for c in COUNTS],
        F.when(all_known, F.min("low")).alias("minGradenum"),
        F.when(all_known, F.max("high")).alias("maxGradenum"),
    )
    return rooms.withColumns(
        {
            "leading_type": F.col("code_type"),
            "noIEP": F.col("totalStudents") - F.col("snCount"),
            "minGrade": grade_label(F.col("minGradenum")),
            "maxGrade": grade_label(F.col("maxGradenum")),
            "grade": grade_range(F.col("minGradenum"), F.col("maxGradenum")),
        }
    ).drop("code_type")


def classified(rooms: DataFrame, rules: Rules) -> DataFrame:
    """Name each room's type.

    Inclusion when it mixes inclusion or sub-separate students with a larger
    general-education and SEI group; else SEI rooms with few
    general-education students go by their leading type (or Gen Ed if that is
    neither SEI nor SLIFE); else the leading type.
    """
    leading = F.col("leading_type")
    supported = F.col("inclusion") + F.col("subsep") > 0
    general = F.col("gened") + F.col("sei") > F.col("subsep")
    few_general = (F.col("gened") < rules.few_general) & (F.col("sei") > 0)
    room_type = (
        F.when(supported & general, "Inclusion")
        .when(few_general & has_text(leading, "SEI"), leading)
        .when(few_general & ~has_text(leading, "SLIFE"), "Gen Ed")
        .otherwise(leading)
    )
    return rooms.withColumn("hrClasstype", room_type)


def with_limits(rooms: DataFrame, limit_groups: DataFrame, limits: DataFrame) -> DataFrame:
    """Size limits of the room's type at its lowest grade; a room repeats per matching limit."""
    groups = limit_groups.select(F.col("classtype").alias("listed_type"), "limit_key")
    listed = limits.select(
        F.col("limit_key").alias("limit_group"),
        F.col("grade").alias("limit_grade"),
        "prgm",
        *LIMITS,
    ).distinct()
    at_grade = same(F.col("limit_key"), F.col("limit_group")) & same(
        F.col("minGrade"), F.col("limit_grade")
    )
    return (
        rooms.join(groups, same(F.col("hrClasstype"), F.col("listed_type")), "left")
        .join(listed, at_grade, "left")
        .drop("listed_type", "limit_group", "limit_grade", "limit_key")
    )


def with_school_name(rows: DataFrame, school_names: DataFrame) -> DataFrame:
    return rows.join(school_names.select("sch", "schname"), "sch", "left")


def room_base(
    rooms: DataFrame,
    limit_groups: DataFrame,
    limits: DataFrame,
    school_names: DataFrame,
    rules: Rules,
) -> DataFrame:
    """Classified rooms with limits, names and age spread.

    Rooms enter once each, so repeated lookup rows are removed before the joins
    instead of removing repeated report rows after them.
    """
    spread = classified(rooms, rules).select("*", F.inline("spans")).drop("spans")
    limited = with_limits(spread, limit_groups, limits)
    named = with_school_name(limited, school_names.select("sch", "schname").distinct())
    return with_month_span(named, rules)
