"""Registered queries: one per operator family, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomledger import schemas
from roomledger.config import PROGRAM_TYPES, Rules
from roomledger.functions.calendar import school_year, school_years_of
from roomledger.functions.grades import grade_label, grade_number
from roomledger.operators import cells, enrollment, metrics, ordering, publish, refdata, reports, rooms
from roomledger.plans import job
from roomledger.plans.district import District
from roomledger.plans.staging import Staging, new_folder
from roomledger.sources import inputs, star

Query = Callable[[SparkSession, str], DataFrame]
RULES = Rules()
QUERIES: dict[str, Query] = {}
ROOM = ("snapshot_date", "sch", "homeroom")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _district(spark: SparkSession, sf_dir: str, days=(star.SNAPSHOT_DAY,)) -> District:
    years = school_years_of(date.fromisoformat(day) for day in days)
    return District(star.star_inputs(spark, sf_dir, days), RULES, school_years=years)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- sources and reference tables ---------------------------------------------


@query
def q_snapshot(spark, sf_dir):
    return enrollment.in_scope(_district(spark, sf_dir).inputs.students, RULES)


@query
def q_school_year(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    return _table(spark, sf_dir, "orders").select(
        "o_orderkey", day.alias("day"), school_year(day).alias("sch_year")
    )


@query
def q_capacity_crosswalk(spark, sf_dir):
    return _district(spark, sf_dir).capacities()


@query
def q_split_schools(spark, sf_dir):
    listing = star.merge_listing(_table(spark, sf_dir, "customer"))
    return inputs.active_split_schools(listing, RULES)


@query
def q_program_map(spark, sf_dir):
    codes = _district(spark, sf_dir).inputs.program_codes
    listing = star.code_listing(_table(spark, sf_dir, "part"), codes)
    return refdata.limit_group_by_type(listing, RULES)


@query
def q_limits(spark, sf_dir):
    codes, part = _district(spark, sf_dir).inputs.program_codes, _table(spark, sf_dir, "part")
    return refdata.class_limits(
        star.limit_listing(part, codes), star.code_listing(part, codes), RULES
    )


@query
def q_grade_parse(spark, sf_dir):
    label = grade_label(F.col("gradenum"))
    return _district(spark, sf_dir).inputs.students.select(
        "snapshot_date",
        "studentno",
        "gradenum",
        label.alias("grade_label"),
        grade_number(label).alias("grade_number"),
    )


@query
def q_school_directory(spark, sf_dir):
    given = _district(spark, sf_dir).inputs
    return refdata.school_directory(given.school_directory, given.school_names)


# -- students -----------------------------------------------------------------


@query
def q_missing_program(spark, sf_dir):
    students = enrollment.in_scope(_district(spark, sf_dir).inputs.students, RULES)
    return enrollment.missing_program(students)


@query
def q_enrollment(spark, sf_dir):
    return (
        _district(spark, sf_dir)
        .enrolled_with_span()
        .select(
            "snapshot_date",
            "studentno",
            "sch",
            "campus",
            "homeroom",
            "grade",
            "gradenum",
            "programcode",
            "projection_group",
            "classtype",
            "prgmtype",
            "eld",
            "sncode",
            "lepstatus",
            "firstlang",
            "sch_year",
            "dobDaySpan",
            "dobMonthSpan",
        )
    )


@query
def q_dob_span(spark, sf_dir):
    students = enrollment.in_scope(_district(spark, sf_dir).inputs.students, RULES)
    return enrollment.dob_span(students, RULES)


# -- rollups ------------------------------------------------------------------


@query
def q_prgmtype_counts(spark, sf_dir):
    return _district(spark, sf_dir).room_totals().select(*ROOM, *PROGRAM_TYPES)


@query
def q_cells(spark, sf_dir):
    return _district(spark, sf_dir).type_counts()


@query
def q_classtype_max(spark, sf_dir):
    return rooms.class_type_max(_district(spark, sf_dir).room_totals())


@query
def q_sei_max(spark, sf_dir):
    return rooms.sei_max(_district(spark, sf_dir).type_counts(), RULES)


@query
def q_eld_counts(spark, sf_dir):
    levels = [f"eld{n}" for n in range(1, 6)]
    return _district(spark, sf_dir).room_totals().select(*ROOM, *levels)


@query
def q_room_counts(spark, sf_dir):
    totals = _district(spark, sf_dir).room_totals()
    return totals.select(*ROOM, "totalStudents", "snCount", "otherIEP", "noIEP")


@query
def q_grade_range(spark, sf_dir):
    totals = _district(spark, sf_dir).room_totals()
    return totals.select(*ROOM, "minGradenum", "maxGradenum", "minGrade", "maxGrade", "grade")


@query
def q_class_types(spark, sf_dir):
    return _district(spark, sf_dir).known_types()


# -- rooms --------------------------------------------------------------------


@query
def q_classify(spark, sf_dir):
    named = rooms.classified(_district(spark, sf_dir).room_totals(), RULES)
    return named.select(
        *ROOM, "gened", "inclusion", "subsep", "sei", "leading_type", "hrClasstype"
    )


@query
def q_room_base(spark, sf_dir):
    base = _district(spark, sf_dir).room_base()
    counts = ("totalStudents", "noIEP", *PROGRAM_TYPES, *(c for c in cells.COUNTS if c != "eld5"))
    spread = ("dobDaySpan", "dobMonthSpan")
    return base.select(
        *ROOM, *spread, "hrClasstype", "prgm", *rooms.LIMITS, *rooms.GRADES, *counts, "schname"
    )


@query
def q_ratio_caps(spark, sf_dir):
    district = _district(spark, sf_dir)
    return metrics.with_ratio_caps(
        district.room_base(), district.inputs.inclusion_ratios
    ).select(
        *ROOM,
        "dobDaySpan",
        "hrClasstype",
        "room_limit",
        "limit_with_para",
        "inclusion_limit",
        "genedCap",
        "spedCap",
    )


@query
def q_limits_applied(spark, sf_dir):
    measured = _district(spark, sf_dir).measured_rooms()
    return measured.select(
        *ROOM,
        "dobDaySpan",
        "hrClasstype",
        "totalStudents",
        "util",
        "seats",
        "overage",
        "capacity",
    )


@query
def q_sped_share(spark, sf_dir):
    measured = _district(spark, sf_dir).measured_rooms()
    return measured.select(
        *ROOM, "dobDaySpan", "hrClasstype", "snCount", "snPct", "btu_limit", "btu_max"
    )


@query
def q_room_filter(spark, sf_dir):
    real = metrics.real_rooms(_district(spark, sf_dir).measured_rooms(), RULES)
    return real.select(*ROOM, "dobDaySpan", "hrClasstype", "prgm", "totalStudents")


@query
def q_flags(spark, sf_dir):
    flagged = _district(spark, sf_dir).report_rooms()
    return flagged.select(
        *ROOM, "dobDaySpan", "hrClasstype", "issueFlag", "homeroom_flag", "groups"
    )


# -- errors -------------------------------------------------------------------


@query
def q_error_rooms(spark, sf_dir):
    found = _district(spark, sf_dir).error_rooms()
    return found.select(*ROOM, "dobDaySpan", "hrClasstype", "grade", "homeroom_flag", "error")


@query
def q_dominant_types(spark, sf_dir):
    codes = _district(spark, sf_dir).error_codes()
    return codes.select(*cells.CODE, F.col("dominant_type").alias("classtype"), F.col("copies").cast("bigint").alias("copies"))


@query
def q_mode_grade(spark, sf_dir):
    found = _district(spark, sf_dir).error_rooms()
    return found.groupBy(*cells.CODE).agg(F.first("mode_grade").alias("mode_grade"))


@query
def q_student_errors(spark, sf_dir):
    return _district(spark, sf_dir).student_errors(Staging.of(spark))


# -- reports ------------------------------------------------------------------


@query
def q_all_students(spark, sf_dir):
    return _district(spark, sf_dir).student_list()


@query
def q_capacity_sheet(spark, sf_dir):
    return _district(spark, sf_dir).capacity_sheet()


@query
def q_district_report(spark, sf_dir):
    return _district(spark, sf_dir).district_report()


@query
def q_school_report(spark, sf_dir):
    district = _district(spark, sf_dir)
    own = publish.published_schools(district.report_rooms(), RULES)
    return reports.school_report(own, district.capacities(), RULES)


@query
def q_school_list(spark, sf_dir):
    return publish.schools(_district(spark, sf_dir).enrolled(), RULES)


@query
def q_manifest(spark, sf_dir):
    district, staging = _district(spark, sf_dir), Staging.of(spark)
    found = staging.keep(district.report_rooms(trace_errors=True), "rooms")
    types = staging.keep(district.known_types(), "known_types")
    codes = staging.keep(district.error_codes(found, types), "error_codes")
    report = reports.report_rows(found, district.capacities())
    students = reports.student_list(district.enrolled(), district.inputs.school_names)
    return publish.manifest(students, report, district.misplaced_students(codes), "schools", RULES)


@query
def q_history_report(spark, sf_dir):
    return _district(spark, sf_dir, star.HISTORY_DAYS).district_report()


@query
def q_history_errors(spark, sf_dir):
    return _district(spark, sf_dir, star.HISTORY_DAYS).student_errors(Staging.of(spark))


# -- text exports ---------------------------------------------------------------


def _read_back(listing: DataFrame, schema: str) -> DataFrame:
    """A listing written as a CSV export, as people type them, and read again."""
    path = new_folder(listing.sparkSession, "export.csv")
    inputs.write_csv_export(star.as_typed_by_hand(listing, schema), path, schema)
    return inputs.read_csv_export(listing.sparkSession, path, schema)


def _code_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = _district(spark, sf_dir).inputs.program_codes
    return _read_back(star.code_listing(_table(spark, sf_dir, "part"), codes), schemas.PROGRAM_CODES)


@query
def q_csv_program_codes(spark, sf_dir):
    return _code_export(spark, sf_dir).drop("row_id")


@query
def q_csv_program_map(spark, sf_dir):
    """The first line of the file wins, so lines have to keep their order."""
    return refdata.limit_group_by_type(_code_export(spark, sf_dir), RULES)


@query
def q_csv_class_limits(spark, sf_dir):
    codes = _district(spark, sf_dir).inputs.program_codes
    listing = star.limit_listing(_table(spark, sf_dir, "part"), codes)
    return _read_back(listing, schemas.CLASS_LIMITS).drop("row_id")


@query
def q_csv_inclusion_ratios(spark, sf_dir):
    listing = star.ratio_listing(_table(spark, sf_dir, "customer"))
    return _read_back(listing, schemas.INCLUSION_RATIOS).drop("row_id")


# -- snapshot history -------------------------------------------------------------


def _history(spark: SparkSession, sf_dir: str) -> str:
    """A snapshot history as it is kept: a directory per day."""
    path = new_folder(spark, "snapshots")
    students = star.student_snapshots(_table(spark, sf_dir, "orders"), star.HISTORY_DAYS)
    students.write.partitionBy("snapshot_date").parquet(path)
    return path


@query
def q_history_snapshot(spark, sf_dir):
    students = inputs.read_snapshots(spark, _history(spark, sf_dir), [star.SNAPSHOT_DAY])
    return enrollment.in_scope(students, RULES)


@query
def q_history_day_report(spark, sf_dir):
    students = inputs.read_snapshots(spark, _history(spark, sf_dir), [star.SNAPSHOT_DAY])
    given = replace(star.star_inputs(spark, sf_dir), students=students)
    years = school_years_of([date.fromisoformat(star.SNAPSHOT_DAY)])
    return District(given, RULES, school_years=years).district_report()


# -- published tables, read back --------------------------------------------------


_runs: dict[tuple[str, str], job.Published] = {}


def _published(spark: SparkSession, sf_dir: str) -> job.Published:
    """What one run of the whole job publishes; the queries of a session that read it back share the run."""
    key = (spark.sparkContext.applicationId, sf_dir)
    known = _runs.get(key)
    if known is None or job.published(spark, known.out_dir).record != known.record:
        known = job.run(spark, star.star_inputs(spark, sf_dir), new_folder(spark, "reports"), RULES)
        _runs[key] = known
    return known


@query
def q_published_students(spark, sf_dir):
    return _published(spark, sf_dir).table("student_list").drop("school")


@query
def q_published_errors(spark, sf_dir):
    return _published(spark, sf_dir).table("student_errors")


@query
def q_published_report(spark, sf_dir):
    return _published(spark, sf_dir).table("room_report")


@query
def q_published_csv(spark, sf_dir):
    return _published(spark, sf_dir).table("room_report_csv")


@query
def q_published_capacity(spark, sf_dir):
    return _published(spark, sf_dir).table("capacity_sheet")


@query
def q_published_school_report(spark, sf_dir):
    return _published(spark, sf_dir).table("school_room_report").drop("snapshot_date", "school")


@query
def q_published_school_students(spark, sf_dir):
    return _published(spark, sf_dir).table("school_student_list")


@query
def q_published_school_errors(spark, sf_dir):
    return _published(spark, sf_dir).table("school_student_errors")


@query
def q_published_manifest(spark, sf_dir):
    listing = _published(spark, sf_dir).table("manifest")
    in_run = F.regexp_replace("location", "^.*/(schools/[^/]+/)run=[^/]+/", "$1")
    return listing.withColumn("location", in_run)


@query
def q_report_positions(spark, sf_dir):
    district = _district(spark, sf_dir)
    rows = reports.report_rows(district.report_rooms(), district.capacities())
    staging = Staging(new_folder(spark, "positions"))
    placed = ordering.with_position(rows, reports.REPORT_ORDER, staging)
    return placed.select("position", "snapshot_date", "sch", "groups", "minGradenum", "homeroom", "totalStudents")
