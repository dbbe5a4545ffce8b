"""Room metrics, limits, flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomledger.config import Rules
from roomledger.functions.measures import share
from roomledger.functions.nulls import has_text, if_known, one_of, same


def with_ratio_caps(rooms: DataFrame, ratios: DataFrame) -> DataFrame:
    """Schools with their own inclusion ratio override the limits of inclusion rooms."""
    own = ratios.select(
        F.col("sch").alias("ratio_sch"), F.col("gradenum").alias("ratio_grade"), "inc", "gen"
    )
    match = (F.col("sch") == F.col("ratio_sch")) & same(
        F.col("minGradenum"), F.col("ratio_grade")
    )
    inclusion = F.col("hrClasstype") == "Inclusion"
    overridden = inclusion & F.col("inc").isNotNull()
    return (
        rooms.join(own, match, "left")
        .withColumns(
            {
                "room_limit": if_known(
                    overridden, F.col("inc") + F.col("gen"), F.col("room_limit")
                ),
                "inclusion_limit": if_known(overridden, F.col("inc"), F.col("inclusion_limit")),
            }
        )
        .withColumn("genedCap", F.when(inclusion, F.col("room_limit") - F.col("inclusion_limit")))
        .withColumn("spedCap", F.when(inclusion, F.col("inclusion_limit")))
        .drop("ratio_sch", "ratio_grade", "inc", "gen")
    )


def with_capacity(rooms: DataFrame, rules: Rules) -> DataFrame:
    """Final rule-based limit and what follows from it.

    Seats and utilisation use the limit as looked up; only the published capacity
    shows zero where there is none.
    """
    room_type, total = F.col("hrClasstype"), F.col("totalStudents")
    para_allowed = has_text(room_type, "SEI") | (room_type == "Dual-Language")
    over = total > F.col("room_limit")
    return (
        rooms.withColumn(
            "room_limit", if_known(over & para_allowed, F.col("limit_with_para"), F.col("room_limit"))
        )
        .withColumn(
            "room_limit",
            F.when(has_text(room_type, "SLIFE"), rules.slife_limit).otherwise(F.col("room_limit")),
        )
        .withColumns(
            {
                "util": share(total, F.col("room_limit")),
                "seats": F.col("room_limit") - total,
                "overage": F.when(
                    F.col("room_limit").isNotNull(),
                    F.greatest(total - F.col("room_limit"), F.lit(0)),
                ),
                "capacity": F.coalesce(F.col("room_limit"), F.lit(0)),
            }
        )
        .drop("room_limit", "limit_with_para", "inclusion_limit")
    )


def with_sped_share(rooms: DataFrame, rules: Rules) -> DataFrame:
    """Share of students with a special-education plan, of the room and of the contract limit."""
    exempt = one_of(F.col("hrClasstype"), rules.exempt_types)
    limit = F.lit(None).cast("int")
    for below, students in reversed(rules.btu_limits):
        limit = F.when(F.col("minGradenum") < below, students).otherwise(limit)
    return (
        rooms.withColumn("snPct", F.when(~exempt, share(F.col("snCount"), F.col("totalStudents"))))
        .withColumn("btu_limit", F.when(~exempt, limit))
        .withColumn("btu_max", share(F.col("snCount"), F.col("btu_limit")))
    )


def with_real_code(rows: DataFrame) -> DataFrame:
    """Rows whose homeroom code stands for a room; unassigned students have none."""
    code = F.col("homeroom")
    return rows.where((code != "") & ~code.contains("000"))


def real_rooms(rooms: DataFrame, rules: Rules) -> DataFrame:
    """Leave out rooms that exist only on paper.

    The conditions on the homeroom code are pushed down to the snapshot scan, so
    unassigned students never reach a shuffle of the room reports.
    """
    total, program = F.col("totalStudents"), F.col("prgm")
    general = F.col("gened") + F.col("sei") + F.col("bilingual")
    tiny_regular = (general <= rules.tiny_regular) & one_of(program, ("Reg Ed", "ELL"))
    tiny_sped = (
        (total <= rules.tiny_sped) & (program == "SPED") & (F.col("sch") != rules.small_sped_school)
    )
    return (
        with_real_code(rooms)
        .where((total < rules.too_many) & (total != rules.single))
        .where(~tiny_regular & ~tiny_sped)
    )


def with_flags(rooms: DataFrame, rules: Rules) -> DataFrame:
    """Issue flag, display type, review flag and report group, in that order."""
    in_room, of_limit = F.col("snPct"), F.col("btu_max")
    issue = (
        F.when((in_room > rules.near_half) & (in_room < rules.half), "Nearing 50% - Enrollment")
        .when(
            (of_limit > rules.near_btu) & (of_limit <= rules.over_btu), "Nearing 40% - BTU Limit"
        )
        .when(of_limit > rules.over_btu, "Over 40% - BTU Limit")
        .when(in_room >= rules.half, "Over 50% - Enrollment")
    )
    room_type = F.col("hrClasstype")
    listed, shown = rules.shown_as
    general = (room_type == "Gen Ed") | (room_type == "Inclusion")
    shown_type = (
        F.when(has_text(room_type, listed), F.replace(room_type, F.lit(listed), F.lit(shown)))
        .when(general & one_of(F.col("minGradenum"), rules.homeroom_grades), "Homeroom")
        .otherwise(room_type)
    )
    several_grades = has_text(F.col("grade"), "to") & (F.col("maxGradenum") != -1)
    review = (
        F.when(room_type.isNull(), "Blank Classtype")
        .when(
            one_of(room_type, rules.regular_types) & several_grades, "Needs Review - Multigraded"
        )
        .when(has_text(room_type, "+"), "Needs Review")
    )
    reviewed = F.when(F.col("sch") != rules.multigrade_school, review)
    group = F.when(one_of(room_type, rules.regular_types), "Major").otherwise(room_type)
    return (
        rooms.withColumn("issueFlag", issue)
        .withColumn("hrClasstype", shown_type)
        .withColumn("homeroom_flag", reviewed)
        .withColumn("groups", group)
    )
