"""Publication in one step: what readers see when runs fail, overlap or follow each other."""

from datetime import datetime
from pathlib import Path

import pytest

from roomledger.plans import job, versions
from roomledger.plans.versions import Published, Run, Table
from roomledger.sources.star import HISTORY_DAYS, star_inputs
from tests.conftest import comparable

SF_DIR = "/root/testdata/sf0.001"
TABLES = {
    "list": Table("students/list"),
    "report": Table("district/report", "day"),
    "text": Table("district/text", "day", "csv"),
}


def rows(spark, days, value, column="snapshot_date"):
    return spark.createDataFrame([(day, i, f"{value} {i}") for day in days for i in range(3)], f"{column} string, n int, v string")


def run_of(spark, out, days, value):
    run = Run(spark, out, TABLES)
    run.write("list", rows(spark, days, value), "n")
    run.write("report", rows(spark, days, value, "day"))
    run.write("text", rows(spark, days, value, "day"))
    return run


def seen(spark, out, number=None):
    tables = Published(spark, out, TABLES, versions.read_record(spark, out, number))
    return {name: sorted((r[0], r[-1]) for r in tables.table(name).select(t.day, "v").collect()) for name, t in TABLES.items()}


def want(**values):
    pairs = sorted((day.replace("_", "-"), f"{value} {i}") for day, value in values.items() for i in range(3))
    return dict.fromkeys(TABLES, pairs)


def test_a_run_replaces_its_days_in_all_tables_at_once(spark, tmp_path):
    out = str(tmp_path)
    run_of(spark, out, ["a", "b"], "old").commit(["a", "b"])
    assert seen(spark, out) == want(a="old", b="old")
    run = run_of(spark, out, ["b", "c"], "new")
    assert seen(spark, out) == want(a="old", b="old")  # written, not yet published
    run.commit(["b", "c"])
    assert seen(spark, out) == want(a="old", b="new", c="new")
    Run(spark, out, TABLES).commit(["a"])  # a day without rows now
    assert seen(spark, out) == want(b="new", c="new")
    assert seen(spark, out, 1) == want(a="old", b="old")  # who reads an older record goes on with it


def test_rows_of_other_days_are_not_published(spark, tmp_path):
    run = run_of(spark, str(tmp_path), ["a", "b"], "x")
    with pytest.raises(ValueError, match="days that are not published: \\['b'\\]"):
        run.commit(["a"])
    assert versions.record_numbers(spark, str(tmp_path)) == []


def test_a_number_that_is_taken_is_not_overwritten(spark, tmp_path, monkeypatch):
    """Two runs that read the same record: the later one goes on top of the earlier."""
    out = str(tmp_path)
    run_of(spark, out, ["a", "b"], "first").commit(["a", "b"])
    one, other = run_of(spark, out, ["a"], "one"), run_of(spark, out, ["b"], "other")
    stale, read = [versions.read_record(spark, out)], versions.read_record
    one.commit(["a"])
    monkeypatch.setattr(versions, "read_record", lambda *given: stale.pop() if stale else read(*given))
    record = other.commit(["b"])
    monkeypatch.undo()
    assert record.number == 3 and seen(spark, out) == want(a="one", b="other")
    assert not versions._put_new(spark, versions._record_path(out, 2), "{}")
    assert versions.read_record(spark, out, 2).days == {"a": one.id, "b": read(spark, out, 1).days["b"]}


def test_a_reader_never_sees_half_a_record(spark, tmp_path, monkeypatch):
    """A record is written under another name first; a failed rename leaves nothing."""
    path = f"{tmp_path}/_published/{1:020d}.json"
    before = spark._sc._gateway.new_array

    def broken(*given):
        raise RuntimeError("lost connection")

    monkeypatch.setattr(spark._sc._gateway, "new_array", broken)
    with pytest.raises(RuntimeError):
        versions._put_new(spark, path, "{}")
    monkeypatch.setattr(spark._sc._gateway, "new_array", before)
    assert versions.record_numbers(spark, str(tmp_path)) == []
    assert versions._put_new(spark, path, "{}") and Path(path).read_text() == "{}"


def test_old_versions_are_removed_when_no_record_names_them(spark, tmp_path):
    out = str(tmp_path)
    for value, days in (("one", "ab"), ("two", "bc"), ("three", "c")):
        run_of(spark, out, list(days), value).commit(list(days))
    failed = run_of(spark, out, ["a"], "failed")
    assert versions.remove_old(spark, out, TABLES, records=1) == []  # all runs are young
    removed = versions.remove_old(spark, out, TABLES, records=2, hours=-1)
    assert {Path(p).name for p in removed} == {"snapshot_date=b", "day=b", f"run={failed.id}"}
    assert seen(spark, out) == want(a="one", b="two", c="three")
    assert seen(spark, out, 2) == want(a="one", b="two", c="two")
    versions.remove_old(spark, out, TABLES, records=1, hours=-1)
    assert seen(spark, out) == want(a="one", b="two", c="three")
    assert len(list(Path(out).glob("*/*/run=*/*=c"))) == len(TABLES)


def test_text_tables_read_back_as_they_were(spark, tmp_path):
    odd = ["", None, ' a "quoted", text ', "NA", "\\", '"', " "]
    frame = spark.createDataFrame(
        [("d", i, v, 0.5 * i if i else None, float("inf")) for i, v in enumerate(odd)],
        "day string, n bigint, v string, x double, y double",
    )
    run = Run(spark, str(tmp_path), {"text": TABLES["text"]})
    run.write("text", frame)
    run.commit(["d"])
    back = Published.latest(spark, str(tmp_path), {"text": TABLES["text"]}).table("text")
    assert back.schema.simpleString() == frame.schema.simpleString()
    assert comparable(back.columns, back.collect()) == comparable(frame.columns, frame.collect())


def everything(tables):
    return {n: comparable((df := tables.table(n)).columns, df.collect()) for n in tables.record.schemas}


@pytest.mark.parametrize("fails_at", (4, "commit"))
def test_a_job_that_fails_leaves_the_published_day(spark, tmp_path, monkeypatch, fails_at):
    """Between two writes, or after all of them: readers see the old rows, and all of them."""
    given, out, day = star_inputs(spark, SF_DIR, HISTORY_DAYS[:2]), str(tmp_path), HISTORY_DAYS[1]
    before = everything(job.run(spark, given, out))
    write, calls = Run.write, []

    def failing(self, *args):
        if len(calls) == fails_at:
            raise OSError("disk full")
        calls.append(args[0])
        write(self, *args)

    def no_commit(*given):
        raise OSError("no space for the record")

    monkeypatch.setattr(Run, "write", failing)
    if fails_at == "commit":
        monkeypatch.setattr(versions, "_put_new", no_commit)
    with pytest.raises(OSError):
        job.run_days(spark, given, out, [day])
    monkeypatch.undo()
    assert everything(job.published(spark, out)) == before
    assert len({p.name for p in Path(out).glob("*/*/run=*")}) == 1  # the failed run's folders are gone


def test_all_tables_are_of_one_run(spark, tmp_path):
    given, out = star_inputs(spark, SF_DIR), str(tmp_path)
    job.run(spark, given, out)
    tables = job.run(spark, given, out)
    (run,) = set(tables.record.days.values())
    folders = [f for name in job.TABLES for f in tables.folders(name)]
    assert len(folders) >= 9 and all(f"/run={run}/" in f for f in folders)
    locations = {r["location"].split("/run=")[1].split("/")[0] for r in tables.table("manifest").collect()}
    assert locations == {run}
    assert datetime.strptime(run.split("-")[0], "%Y%m%dT%H%M%S").year >= 2024
