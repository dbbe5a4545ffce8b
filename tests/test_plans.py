"""Shape of the physical plans: what is read, shuffled and broadcast."""

import re

import pytest

import registry
from roomledger.operators import cells
from roomledger.plans.district import District
from roomledger.sources import inputs, star

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan(df)


@pytest.fixture(scope="module")
def snapshots(spark, tmp_path_factory):
    """The adapted students as a real day-partitioned table."""
    path = str(tmp_path_factory.mktemp("snapshots") / "students")
    orders = spark.read.parquet(f"{SF_DIR}/orders.parquet")
    star.student_snapshots(orders, star.HISTORY_DAYS).write.partitionBy("snapshot_date").parquet(
        path
    )
    return path


@pytest.fixture
def district(spark, snapshots):
    from dataclasses import replace

    given = star.star_inputs(spark, SF_DIR)
    students = inputs.read_snapshots(spark, snapshots, ["2026-05-05"])
    return District(replace(given, students=students))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_no_python_no_products_no_broadcast_hints(spark, name):
    df = registry.QUERIES[name](spark, SF_DIR)
    assert "ResolvedHint (strategy=broadcast" not in df._jdf.queryExecution().logical().toString()
    text = plan(df)
    assert not re.search(r"Python|Pandas|Arrow", text)
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", text)


def moved(df):
    """The hash exchanges that ran; one used twice is one."""
    final = final_plan(df).split("== Initial Plan ==")[0]
    return [
        line for line in final.split("\n")
        if "Exchange hashpartitioning" in line and "ReusedExchange" not in line
    ]


@pytest.mark.parametrize("traced", (False, True))
def test_rooms_shuffle_students_once_and_cells_once(district, traced):
    exchanges = moved(district.room_totals(trace_errors=traced))
    assert len(exchanges) == 2
    assert sum("programcode" in line for line in exchanges) == 1


def test_room_aggregate_is_a_hash_aggregate(district):
    text = plan(district.room_totals())
    rooms = [line for line in text.split("\n") if "Aggregate(" in line and "sum(eld1" in line]
    assert rooms and all(re.search(r"[- ]HashAggregate\(", line) for line in rooms)


def test_lists_of_groups_are_made_among_leading_cells_only(district):
    """Lists over a whole homeroom code hold class types; spans are those of one room."""
    lines = plan(district.room_totals(trace_errors=True)).split("\n")
    over = [line.rsplit("], [", 1)[1] for line in lines if " Window [collect_list" in line]
    assert over and all("leads" in keys for keys in over)


def test_paper_codes_are_dropped_at_the_scan(district):
    text = plan(district.report_rooms())
    scan = next(line for line in text.split("\n") if "FileScan parquet" in line)
    assert "Not(EqualTo(homeroom,))" in scan
    lowest = [line for line in text.split("\n") if "+- Filter" in line and "sch" in line][-1]
    assert re.search(r"NOT Contains\(homeroom#\d+, 000\)", lowest)
    assert "Not(EqualTo(sch,3003))" in scan
    assert "PartitionFilters: [isnotnull(snapshot_date" in scan


def test_rooms_read_only_the_columns_they_need(district):
    text = plan(district.district_report())
    scans = [line for line in text.split("\n") if "FileScan parquet" in line and "students" in line]
    for scan in scans:
        assert "studentname" not in scan.split("ReadSchema")[1]
        assert "firstlang" not in scan.split("ReadSchema")[1]


@pytest.fixture(scope="module")
def logged(events_of):
    """Runs code in a session with an event log; returns the records read by each stage's scans."""

    def run(code):
        read, windows = {}, {}
        for event in events_of(code):
            if event["Event"] == "SparkListenerTaskEnd":
                stage = event["Stage ID"]
                records = event["Task Metrics"]["Input Metrics"]["Records Read"]
                read[stage] = read.get(stage, 0) + records
            elif event["Event"] == "SparkListenerStageCompleted":
                scopes = str([r.get("Scope") for r in event["Stage Info"]["RDD Info"]])
                windows[event["Stage Info"]["Stage ID"]] = "Window" in scopes
        return read, windows

    return run


def test_a_global_sort_does_not_run_the_windows_twice(logged):
    read, windows = logged(
        f"import registry; registry.QUERIES['q_district_report'](spark, {SF_DIR!r}).collect()"
    )
    assert sum(windows.values()) == 1
    assert sum(n == 1500 for n in read.values()) == 1


def test_job_reads_students_three_times(logged):
    read, _ = logged(
        "from roomledger.plans import job; from roomledger.sources import star; "
        f"job.run(spark, star.star_inputs(spark, {SF_DIR!r}), out)"
    )
    assert sum(n == 1500 for n in read.values()) == 3


def test_a_day_of_a_partitioned_history_reads_that_day_only(logged):
    """1500 students of each of three days are there; the scan reads one directory."""
    read, _ = logged(f"import registry; registry.QUERIES['q_history_snapshot'](spark, {SF_DIR!r}).collect()")
    assert sorted(n for n in read.values() if n)[-2:] == [1500, 1500]  # the orders to write from, and the day


def test_school_years_reach_the_scans(spark, tmp_path):
    from roomledger import schemas
    from roomledger.operators import refdata

    for name, schema in (("c", schemas.HOMEROOM_CROSSWALK), ("s", schemas.STRUCTURE_DATA)):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))
    c, s = (spark.read.parquet(str(tmp_path / name)) for name in "cs")
    text = plan(refdata.capacity_crosswalk(c, s, ("SY2526",)))
    assert text.count("EqualTo(sch_year,SY2526)") == 2


def test_unread_report_columns_are_not_computed(district):
    text = plan(district.report_rooms().select("sch", "homeroom", "hrClasstype"))
    aggregates = [line for line in text.split("\n") if "Aggregate(" in line]
    assert aggregates and not any("eld1" in line for line in aggregates)


def test_staged_error_codes_reach_students_without_a_shuffle(spark, district, tmp_path):
    from roomledger.plans.staging import Staging

    codes = Staging(str(tmp_path / "stage")).keep(district.error_codes(), "codes")
    text = plan(district.misplaced_students(codes))
    assert "Exchange hashpartitioning" not in text
    assert "BroadcastHashJoin" in text


def test_large_error_codes_are_shuffled_not_broadcast(spark, district, tmp_path):
    from roomledger.plans.staging import Staging

    codes = Staging(str(tmp_path / "stage")).keep(district.error_codes(), "codes")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        text = plan(district.misplaced_students(codes))
        assert "BroadcastHashJoin" not in text
        assert "SortMergeJoin" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_results_do_not_depend_on_partitions_or_input_order(spark, district):
    from dataclasses import replace

    from tests.conftest import comparable

    base = district.district_report()
    want = comparable(base.columns, base.collect())
    given = district.inputs
    for partitions in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            mixed = given.students.repartition(7).orderBy("dob", "studentno")
            got = District(replace(given, students=mixed)).district_report()
            assert comparable(got.columns, got.collect()) == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_cells_are_far_fewer_than_students(district):
    students = district.inputs.students.count()
    assert district.cells().count() < students / 4
    assert set(cells.CODE) <= set(district.cells().columns)
