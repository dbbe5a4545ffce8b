"""The whole job on files: layout, reruns, school tabs, manifest.

The published tables are compared with SQL by the queries that read them back.
"""

import re
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from roomledger.plans import job
from roomledger.sources.star import HISTORY_DAYS, star_inputs
from tests.conftest import comparable

SF_DIR = "/root/testdata/sf0.001"
TABS = ("room_report", "student_list", "student_errors")


@pytest.fixture(scope="module")
def published(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("reports"))
    return out, job.run(spark, star_inputs(spark, SF_DIR), out)


def test_district_tables(published):
    _, tables = published
    report, csv = tables.table("room_report"), tables.table("room_report_csv")
    assert report.count() == csv.count() > 0
    assert "School Code" in report.columns and report.columns == csv.columns
    assert tables.table("capacity_sheet").count() > 0


def test_student_tables_are_kept_apart(published):
    out, tables = published
    for name in ("student_list", "student_errors"):
        assert all(folder.startswith(f"{out}/students/") for folder in tables.folders(name))


def test_school_tabs(published):
    _, tables = published
    students, report = tables.table("school_student_list"), tables.table("school_room_report")
    schools = {r["school"] for r in students.select("school").distinct().collect()}
    assert 1290 not in schools and len(schools) > 10
    assert report.where("school <> `School Code`").count() == 0
    assert not [c for c in report.columns if c.startswith(("key_", "eld"))]
    everyone = tables.table("student_list")
    assert students.count() == everyone.where("sch <> 1290").count()


def test_school_files_are_sorted(spark, published):
    _, tables = published
    (folder,) = tables.folders("school_student_list")
    files = list(Path(folder).glob("school=*/*.parquet"))
    assert files
    for file in files:
        rooms = [r[0] for r in spark.read.parquet(str(file)).select("homeroom").collect()]
        assert rooms == sorted(rooms, key=lambda code: (code is None, code or ""))


def test_manifest_lists_what_was_written(published):
    _, tables = published
    listing = tables.table("manifest").collect()
    counts = {
        tab: {r["school"]: r["count"] for r in tables.table(f"school_{tab}").groupBy("school").count().collect()}
        for tab in TABS
    }
    assert len(listing) == len(counts["student_list"])
    for row in listing:
        assert row["students"] == counts["student_list"][row["sch"]]
        assert row["rooms"] == counts["room_report"].get(row["sch"], 0)
        assert row["errors"] == counts["student_errors"].get(row["sch"], 0)
        if row["rooms"]:
            assert Path(row["location"]).is_dir()


def test_school_without_errors_has_no_error_tab(published):
    _, tables = published
    clean = [r["sch"] for r in tables.table("manifest").collect() if r["errors"] == 0]
    assert clean
    (day,) = tables.folders("school_student_errors")
    for school in clean:
        assert not (Path(day) / f"school={school}").exists()


def test_schools_without_a_folder_are_reported(spark, tmp_path):
    given = star_inputs(spark, SF_DIR)
    some = given.school_directory.where("name NOT LIKE '%Campus 7' AND name NOT LIKE '%Campus 11'")
    tables = job.run(spark, replace(given, school_directory=some), str(tmp_path / "out"))
    listing = {r["sch"]: r for r in tables.table("manifest").collect()}
    names = {r["sch"]: r["new_schname"] for r in given.school_names.collect()}
    without = {s for s in listing if names.get(s) in ("Campus 7", "Campus 11")}
    assert without and {r["sch"] for r in tables.table("unplaced_schools").collect()} == without
    folders = {r["folder_id"]: r["name"][32:] for r in some.collect()}
    for sch, row in listing.items():
        assert row["report_name"] == f"{sch} - SY2526 Homeroom Report"
        assert (sch in without) == (row["destination"] is None)
        if sch not in without:
            assert folders[row["destination"]] == names[sch]
            assert row["folders"] == list(folders.values()).count(names[sch])


def test_a_job_without_a_directory_of_folders(spark, tmp_path):
    given = replace(star_inputs(spark, SF_DIR), school_directory=None)
    tables = job.run(spark, given, str(tmp_path / "out"))
    assert "destination" not in tables.table("manifest").columns
    with pytest.raises(ValueError, match="unplaced_schools has never been published"):
        tables.table("unplaced_schools")


def test_rerun_replaces_only_its_days(spark, tmp_path):
    inputs = star_inputs(spark, SF_DIR, HISTORY_DAYS)
    out = str(tmp_path / "reports")
    job.run_days(spark, inputs, out, HISTORY_DAYS[:2])

    def report():
        df = job.published(spark, out).table("room_report")
        return {str(r[0]): r[1] for r in df.groupBy("report_updated").count().collect()}

    before = report()
    assert set(before) == set(HISTORY_DAYS[:2])
    job.run_days(spark, inputs, out, HISTORY_DAYS[1:])
    after = report()
    assert set(after) == set(HISTORY_DAYS)
    assert {d: after[d] for d in before} == before


def written(tables):
    """Every published table, as comparable rows, and the folders of each day and school."""
    rows = {}
    for name in tables.record.schemas:
        df = tables.table(name)
        rows[name] = comparable(df.columns, df.collect())
    folders = {
        f"{tab}/{Path(day).name}/{school.name}"
        for tab in TABS
        for day in tables.folders(f"school_{tab}")
        for school in Path(day).glob("school=*")
    }
    return rows, folders


def test_rerun_leaves_nothing_of_schools_and_errors_that_are_gone(spark, tmp_path):
    inputs = star_inputs(spark, SF_DIR, HISTORY_DAYS[:2])
    day = HISTORY_DAYS[0]
    out, fresh = str(tmp_path / "reports"), str(tmp_path / "fresh")
    tables = job.run(spark, inputs, out)
    errors = tables.table("school_student_errors").where(f"snapshot_date = '{day}'")
    fixed, gone = (r["school"] for r in errors.select("school").distinct().orderBy("school").limit(2).collect())
    wrong = [r["studentno"] for r in errors.where(f"school = {fixed}").collect()]
    stay = (F.col("snapshot_date") != F.lit(day)) | (
        (F.col("sch") != gone) & ~F.col("studentno").isin(wrong)
    )
    corrected = replace(inputs, students=inputs.students.where(stay | F.col("sch").isNull()))
    again, folders = written(job.run_days(spark, corrected, out, [day]))
    want, want_folders = written(job.run(spark, corrected, fresh))
    assert folders == want_folders
    assert f"student_errors/snapshot_date={day}/school={fixed}" not in folders
    assert not [f for f in folders if f"snapshot_date={day}/school={gone}" in f]
    again["manifest"], want["manifest"] = (
        sorted(tuple(re.sub(r"^'.*/schools/(.*/)run=[^/]+/", r"\1", cell) for cell in row) for row in rows)
        for rows in (again["manifest"], want["manifest"])
    )
    assert again == want


def test_a_day_without_students_loses_its_rows(spark, tmp_path):
    inputs = star_inputs(spark, SF_DIR, HISTORY_DAYS[:2])
    out = str(tmp_path / "reports")
    job.run(spark, inputs, out)
    none = replace(inputs, students=inputs.students.where(f"snapshot_date <> '{HISTORY_DAYS[0]}'"))
    tables = job.run_days(spark, none, out, [HISTORY_DAYS[0]])
    left = tables.table("student_list").select("snapshot_date").distinct().collect()
    assert [str(r[0]) for r in left] == [HISTORY_DAYS[1]]


def test_a_job_leaves_no_staged_table(spark, tmp_path):
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.glob("roomledger-*"))
    job.run(spark, star_inputs(spark, SF_DIR), str(tmp_path / "out"))
    with pytest.raises(Exception, match="no_such"):
        job.run(spark, star_inputs(spark, SF_DIR).__class__(**{
            **star_inputs(spark, SF_DIR).__dict__, "school_names": spark.range(1).withColumnRenamed("id", "no_such"),
        }), str(tmp_path / "bad"))
    assert set(shared.glob("roomledger-*")) == before


def test_history_equals_single_days(spark):
    from roomledger.plans.district import District

    together = District(star_inputs(spark, SF_DIR, HISTORY_DAYS)).district_report()
    rows = comparable(together.columns, together.collect())
    apart = []
    whole = star_inputs(spark, SF_DIR, HISTORY_DAYS)
    for day in HISTORY_DAYS:
        one_day = replace(whole, students=whole.students.where(f"snapshot_date = DATE '{day}'"))
        apart += District(one_day).district_report().collect()
    assert rows == comparable(together.columns, apart)
