"""Preparation of the small reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomledger.config import Rules
from roomledger.functions.grades import pad2
from roomledger.functions.nulls import one_of, same


def capacity_crosswalk(
    crosswalk: DataFrame, structure: DataFrame, school_years: tuple[str, ...] | None = None
) -> DataFrame:
    """Room capacity with the class structure of the same school year.

    With ``school_years`` both tables are filtered where they are read.
    """
    if school_years is not None:
        wanted = F.col("sch_year").isin(*school_years)
        crosswalk, structure = crosswalk.where(wanted), structure.where(wanted)
    c, s = crosswalk.alias("c"), structure.alias("s")
    match = same(F.col("c.sch_year"), F.col("s.sch_year")) & same(
        F.col("c.classyearno"), F.col("s.classyearno")
    )
    return c.join(s, match, "left").select(
        "c.sch_year",
        "c.classyearno",
        "c.homeroom",
        "c.type",
        "c.tot_capacity",
        "s.program1",
        "s.program2",
        "s.cap_1",
        "s.cap_2",
    )


def limit_group_by_type(codes: DataFrame, rules: Rules) -> DataFrame:
    """The projection group whose size limits stand for each class type.

    The first row of the code table wins.  ``min_by`` merges partial results, so
    no class type's rows are ever gathered in one place.
    """
    group, class_type = F.col("projection_group"), F.col("classtype")
    other_inclusion = (class_type == "Inclusion") & (group != rules.inclusion_group)
    return (
        codes.where((group != rules.no_limit_group) & ~other_inclusion)
        .groupBy("classtype")
        .agg(F.min_by("projection_group", "row_id").alias("limit_key"))
    )


def class_limits(limits: DataFrame, codes: DataFrame, rules: Rules) -> DataFrame:
    """Size limits by projection group and two-character grade, with the program they belong to."""
    programs = codes.select(F.col("projection_group").alias("code_group"), "prgm").distinct()
    group = F.col("projection_group")
    no_para = F.when(
        one_of(group, rules.para_by_default_groups), F.col("sizelimit_with_para")
    ).otherwise(F.col("sizelimit_no_para"))
    return (
        limits.join(programs, same(group, F.col("code_group")), "left")
        .where(F.col("prgm").isNotNull())
        .select(
            group.alias("limit_key"),
            pad2(F.col("grade")).alias("grade"),
            no_para.alias("room_limit"),
            F.col("sizelimit_with_para").alias("limit_with_para"),
            F.col("program2_capacity").alias("inclusion_limit"),
            "prgm",
        )
    )


def school_directory(folders: DataFrame, school_names: DataFrame) -> DataFrame:
    """Report folders matched to schools by the name that follows the folder's fixed prefix."""
    named = folders.withColumn("new_schname", F.substring("name", 33, 38))
    names = school_names.withColumnRenamed("new_schname", "listed_name")
    return named.join(
        names, same(F.col("new_schname"), F.col("listed_name")), "left"
    ).select("folder_id", "name", "new_schname", "sch", "schname")
