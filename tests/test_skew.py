"""One key holding a third of all rows, checked against SQL on the whole tables."""

import duckdb
import pytest

import registry
from oracle import statements
from tests.conftest import assert_same_as_sql

SOURCE = "/root/testdata/sf0.001"
SKEWED = {
    # One customer (one room) places a third of all orders.
    "one_room": "CASE WHEN o_orderkey % 3 = 0 THEN 8 ELSE o_custkey END",
    # One homeroom code shared by two schools: customers 55 and 54 both map to code H54.
    "one_code": "CASE WHEN o_orderkey % 6 = 0 THEN 55 WHEN o_orderkey % 6 = 3 THEN 54 "
    "ELSE o_custkey END",
    # One error room with 30 students next to one room of the same code with a third of all rows.
    "big_neighbour": "CASE WHEN o_orderkey < 1500 AND o_orderkey % 50 = 1 THEN 15 "
    "WHEN o_orderkey % 3 = 0 THEN 14 ELSE o_custkey END",
}


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    made = {}
    for name, customer in SKEWED.items():
        folder = tmp_path_factory.mktemp(name)
        for table in ("customer", "part"):
            duckdb.execute(
                f"COPY (FROM '{SOURCE}/{table}.parquet') TO '{folder}/{table}.parquet' "
                "(FORMAT parquet)"
            )
        duckdb.execute(
            f"COPY (SELECT * REPLACE ({customer} AS o_custkey) FROM '{SOURCE}/orders.parquet') "
            f"TO '{folder}/orders.parquet' (FORMAT parquet)"
        )
        made[name] = str(folder)
    return made


@pytest.mark.parametrize("shape", sorted(SKEWED))
@pytest.mark.parametrize(
    "name",
    ["q_room_base", "q_classtype_max", "q_dob_span", "q_enrollment", "q_student_errors",
     "q_district_report", "q_manifest"],
)
@pytest.mark.parametrize("broadcast", [True, False])
def test_skewed_key(spark, skewed, shape, name, broadcast):
    """With joins shuffled as well as broadcast, as they are beyond the size limit."""
    if not broadcast:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        df = registry.QUERIES[name](spark, skewed[shape])
        assert_same_as_sql(df, skewed[shape], statements()[name])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def one_code(spark, schools, codes):
    """Every school has one room under the same homeroom code, of 8 students in one program."""
    from dataclasses import replace

    from roomledger.plans.district import District
    from tests.cases import inputs

    students = spark.range(schools * 8).selectExpr(
        "DATE '2026-05-05' AS snapshot_date",
        "id AS studentno",
        "'Somebody' AS studentname",
        "CAST(100000 + id DIV 8 AS INT) AS sch",
        "'04' AS grade",
        "4 AS gradenum",
        "'H1' AS homeroom",
        f"element_at(array{codes}, CAST(id DIV 8 % {len(codes)} + 1 AS INT)) AS projection_group",
        "CAST(NULL AS STRING) AS lepstatus",
        "CAST(NULL AS STRING) AS mostrecenteld",
        "CAST(NULL AS STRING) AS sncode",
        "'English' AS firstlang",
        "'9/3/2016' AS dob",
    )
    return District(replace(inputs(spark, []), students=students))


def test_code_shared_by_many_schools(spark):
    """Every school uses the same homeroom code; ties are named over all of them."""
    from roomledger.plans.staging import Staging

    schools, codes = 600, ("GE", "SA4", "SL4", "BLS")
    district = one_code(spark, schools, codes)
    names = {"SA4": "Autism", "SL4": "Specific Learning Disability", "BLS": "Spanish SEI"}
    joined = " + ".join(names[codes[n % 4]] for n in range(schools) if codes[n % 4] != "GE")
    got = {r["sch"]: r["leading_type"] for r in district.room_totals().collect()}
    assert got == {
        100000 + n: None if codes[n % 4] == "GE" else joined for n in range(schools)
    }

    # All four types lead the code, 150 groups each; each student differs from three of them.
    errors = district.student_errors(Staging.of(spark))
    assert errors.count() == schools * 8 * 3 * (schools // 4)


def test_work_grows_in_step_with_the_schools_of_a_code(events_of):
    """Twice the schools under one code: twice the bytes that tasks shuffle, spill and hold, give or take."""

    def moved(schools):
        events = events_of(
            "from tests.test_skew import one_code\n"
            f"traced = one_code(spark, {schools}, ('GE', 'GE')).room_totals(trace_errors=True)\n"
            f"assert traced.where('leading_type IS NULL').count() == {schools}"
        )
        tasks = [e["Task Metrics"] for e in events if e["Event"] == "SparkListenerTaskEnd"]
        shuffled = sum(t["Shuffle Write Metrics"]["Shuffle Bytes Written"] for t in tasks)
        spilled = sum(t["Memory Bytes Spilled"] for t in tasks)
        return shuffled, spilled, max(t["Peak Execution Memory"] for t in tasks)

    one, two = moved(8_000), moved(16_000)
    assert two[0] < 2.5 * one[0] and two[1] <= 2.5 * one[1] and two[2] < 2.5 * one[2]
