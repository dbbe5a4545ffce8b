import pytest

from roomledger import schemas
from roomledger.plans.staging import Staging
from roomledger.sources import inputs, star


def test_snapshots_read_only_the_days_and_columns_asked_for(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    days = star.student_snapshots(
        spark.read.parquet("/root/testdata/sf0.001/orders.parquet"), star.HISTORY_DAYS
    )
    days.write.partitionBy("snapshot_date").parquet(path)
    df = inputs.read_snapshots(spark, path, [star.HISTORY_DAYS[1]])
    assert df.count() == 1500
    assert df.columns == list(schemas.STUDENT_COLUMNS)
    plan = df.select("studentno")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot_date" in plan
    assert "ReadSchema: struct<studentno:bigint>" in plan
    assert inputs.read_snapshots(spark, path).count() == 4500


def test_csv_export_tells_missing_from_empty(spark, tmp_path):
    file = tmp_path / "codes.csv"
    file.write_text(
        "programcode,projection_group,prgm,classtype,prgmtype\n"
        "A,GE,Reg Ed,Gen Ed,Gen Ed\n"
        ',NA,"SPED",,"Sub-Sep, mixed"\n'
    )
    rows = inputs.read_csv_export(spark, str(file), schemas.PROGRAM_CODES).orderBy("row_id")
    got = [tuple(r)[1:] for r in rows.collect()]
    assert got == [
        ("A", "GE", "Reg Ed", "Gen Ed", "Gen Ed"),
        ("", None, "SPED", "", "Sub-Sep, mixed"),
    ]


def test_csv_export_numbers(spark, tmp_path):
    file = tmp_path / "ratios.csv"
    file.write_text("sch,schname,gradenum,inc,gen\n4006,A,-1,5,15\n4007,B,NA,, 20 \n4008,C, 1,20.0,0\n")
    rows = inputs.read_csv_export(spark, str(file), schemas.INCLUSION_RATIOS).orderBy("row_id")
    assert [tuple(r)[1:] for r in rows.collect()] == [
        (4006, "A", -1, 5, 15),
        (4007, "B", None, None, 20),
        (4008, "C", 1, 20, 0),
    ]


@pytest.mark.parametrize("text", ["x", "20.5", "1e", "99999999999"])
def test_unreadable_csv_numbers_fail_loudly(spark, tmp_path, text):
    file = tmp_path / "bad_ratios.csv"
    file.write_text(f"sch,schname,gradenum,inc,gen\n4006,A,-1,{text},15\n")
    with pytest.raises(Exception, match=rf"inc: no whole number: '{text}' in .*bad_ratios.csv"):
        inputs.read_csv_export(spark, str(file), schemas.INCLUSION_RATIOS).collect()


def test_limits_and_ratios_from_csv_give_the_same_rooms(spark, tmp_path):
    """With numbers as exports write them."""
    from dataclasses import replace

    import registry
    from oracle import statements
    from roomledger.plans.district import District
    from tests.conftest import comparable, sql_rows

    given = star.star_inputs(spark, "/root/testdata/sf0.001")

    def exported(frame, schema):
        columns = [f.split()[0] for f in schema.split(",")]
        name = f"{columns[0]}.csv"
        lines = [",".join(columns)]
        for row in frame.select(*columns).collect():
            cells = ["NA" if v is None else f"{v}.0" if isinstance(v, int) else str(v) for v in row]
            lines.append(",".join(cells))
        (tmp_path / name).write_text("\n".join(lines))
        return inputs.read_csv_export(spark, str(tmp_path / name), schema)

    ratios = exported(given.inclusion_ratios, schemas.INCLUSION_RATIOS)
    limits = exported(given.class_limits, " ".join(schemas.CLASS_LIMITS.split()))
    district = District(replace(given, inclusion_ratios=ratios, class_limits=limits))
    columns, rows = sql_rows("/root/testdata/sf0.001", statements()["q_limits_applied"])
    got = district.measured_rooms().select(*registry.QUERIES["q_limits_applied"](spark, "/root/testdata/sf0.001").columns)
    assert comparable(got.columns, got.collect()) == comparable(columns, rows)


def test_first_csv_line_wins_per_class_type(spark, tmp_path):
    from roomledger.config import Rules
    from roomledger.operators import refdata

    file = tmp_path / "codes.csv"
    lines = [f"C{i},G{i},Reg Ed,Gen Ed,Gen Ed" for i in range(50, 0, -1)]
    file.write_text("\n".join(["programcode,projection_group,prgm,classtype,prgmtype", *lines]))
    codes = inputs.read_csv_export(spark, str(file), schemas.PROGRAM_CODES)
    assert [tuple(r) for r in refdata.limit_group_by_type(codes, Rules()).collect()] == [
        ("Gen Ed", "G50")
    ]


def test_staging_uses_the_folder_the_cluster_names(spark):
    assert Staging.of(spark).folder.startswith(spark.conf.get("spark.checkpoint.dir"))


def test_without_a_shared_folder_nothing_is_staged(spark):
    rows = spark.range(3)
    assert Staging(None).keep(rows, "t") is rows


def test_staged_table_reads_back_the_same(spark):
    rows = spark.sql("SELECT 1 AS a, array(struct('x' AS s)) AS l UNION ALL SELECT 2, NULL")
    kept = Staging.of(spark).keep(rows, "t")
    assert kept.schema.simpleString() == rows.schema.simpleString()
    assert sorted(kept.collect()) == sorted(rows.collect())


@pytest.mark.parametrize("day, days", [("2026-05-05", 1), ("2020-01-01", 0)])
def test_snapshot_filter(spark, tmp_path, day, days):
    path = str(tmp_path / "s")
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    star.student_snapshots(orders).write.partitionBy("snapshot_date").parquet(path)
    df = inputs.read_snapshots(spark, path, [day])
    assert df.select("snapshot_date").distinct().count() == days
