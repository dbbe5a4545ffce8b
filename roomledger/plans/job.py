"""The whole job: every published table for a set of snapshot days.

Students are read three times: once as student cells, from which rooms, known
class types and the days come, once for the errors and once for the student list.
Cells, rooms, errors and the list are staged, and everything published is
made from them.  The staged tables hold student rows; they are removed at the end.
What is published changes in one step, when all tables of the run are written.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomledger.config import Rules
from roomledger.functions.calendar import school_years_of
from roomledger.operators import publish, refdata, reports
from roomledger.plans.district import District
from roomledger.plans.staging import Staging
from roomledger.plans.versions import Published, Run, Table
from roomledger.sources import Inputs


TABLES = {
    "student_list": Table("students/student_list"),
    "student_errors": Table("students/student_errors"),
    "room_report": Table("district/room_report", "report_updated"),
    "room_report_csv": Table("district/room_report_csv", "report_updated", "csv"),
    "capacity_sheet": Table("district/capacity_sheet"),
    "manifest": Table("district/manifest"),
    "unplaced_schools": Table("district/unplaced_schools"),
    **{f"school_{tab}": Table(f"schools/{tab}") for tab in publish.SCHOOL_TABS},
}


def run(
    spark: SparkSession,
    inputs: Inputs,
    out_dir: str,
    rules: Rules | None = None,
    days: Iterable[str] | None = None,
) -> Published:
    """Publish everything under ``out_dir`` in one commit; returns the tables as published.

    The days of the run are those named, or else those its students have.  With the commit every
    table loses all earlier rows of these days, also of schools that have none now, and keeps
    other days.  A run that fails publishes nothing and removes what it wrote.  Tables with
    student rows go under ``students/`` and ``schools/`` so access to them can be limited apart
    from ``district/``.
    """
    version = Run(spark, out_dir, TABLES)
    try:
        with Staging.during(spark) as staging:
            own_days = _written(inputs, version, rules or Rules(), days, staging)
        version.commit(own_days)
    except BaseException:
        version.discard()
        raise
    return published(spark, out_dir)


def published(spark: SparkSession, out_dir: str) -> Published:
    """The tables as the last commit has them."""
    return Published.latest(spark, out_dir, TABLES)


def _written(
    inputs: Inputs, version: Run, rules: Rules, named: Iterable[str] | None, staging: Staging
) -> list[str]:
    """Writes all tables of the run; returns its days."""
    own_cells = staging.keep(District(inputs, rules).student_cells("grade"), "cells")
    if named is None:  # a row per snapshot day
        found = own_cells.select("snapshot_date").distinct().collect()
        dates = sorted(row["snapshot_date"] for row in found)
    else:
        dates = sorted(date.fromisoformat(str(day)) for day in named)
    district = District(inputs, rules, own_cells, school_years_of(dates))

    rooms = staging.keep(district.report_rooms(trace_errors=True), "rooms")
    types = staging.keep(district.known_types(), "known_types")
    codes = staging.keep(district.error_codes(rooms, types), "error_codes")
    errors = staging.keep(district.misplaced_students(codes), "errors")
    report = staging.keep(reports.report_rows(rooms, district.capacities()), "report")
    listed = reports.student_list(district.enrolled(), inputs.school_names)
    students = staging.keep(listed, "students")

    version.write("capacity_sheet", reports.capacity_sheet(rooms))
    version.write("student_errors", reports.student_errors(errors))
    ordered = reports.sorted_globally(report, reports.REPORT_ORDER)
    titled = reports.titled(ordered, reports.REPORT_COLUMNS)
    version.write("room_report", titled)
    version.write("room_report_csv", titled)
    order = reports.STUDENT_LIST_ORDER
    version.write("student_list", publish.by_school(students, order, "gradenum"), "school")

    def own_schools(tab: str, rows: DataFrame, order: tuple[str, ...], *dropped: str) -> None:
        own = publish.published_schools(rows, rules)
        version.write(f"school_{tab}", publish.by_school(own, order, *dropped), "school")

    tab, keys = publish.school_tab(report, rules)
    own_schools("room_report", tab, keys, "sch", *keys)
    own_schools("student_list", students, order, "gradenum")
    own_schools("student_errors", errors, reports.ERROR_ORDER)

    base = f"{version.out_dir}/schools"
    listing = publish.manifest(students, report, errors, base, rules, version.id)
    if inputs.school_directory is not None:
        directory = refdata.school_directory(inputs.school_directory, inputs.school_names)
        listing = publish.with_destinations(listing, directory)
        listing = staging.keep(listing, "manifest")
        version.write("unplaced_schools", publish.unplaced(listing))
    version.write("manifest", listing)
    return [day.isoformat() for day in dates]


def run_days(
    spark: SparkSession,
    inputs: Inputs,
    out_dir: str,
    days: Iterable[str],
    rules: Rules | None = None,
) -> Published:
    """Run for some days of a snapshot history; the filter prunes day partitions."""
    days = [str(day) for day in days]
    wanted = F.col("snapshot_date").isin(*[F.lit(day).cast("date") for day in days])
    given = replace(inputs, students=inputs.students.where(wanted))
    return run(spark, given, out_dir, rules, days)

