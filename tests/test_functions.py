from datetime import date

import pytest
from pyspark.sql import functions as F

from roomledger.functions.calendar import birth_date, school_year
from roomledger.functions.grades import grade_label, grade_number, grade_range, pad2
from roomledger.functions.measures import round2, share
from roomledger.functions.nulls import has_text, if_known, one_of
from roomledger.operators.cells import iep_level, program_type_key


def values(spark, expression, given, type_):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], f"i INT, v {type_}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_grade_label(spark):
    given = [-2, -1, 0, 1, 8, 9, 10, 12, None]
    want = ["K0", "K1", "K2", "01", "08", "09", "10", "12", None]
    assert values(spark, grade_label, given, "INT") == want


def test_grade_number_reads_labels_back(spark):
    given = ["K0", "K1", "K2", "01", "08", "12", "??", "", None]
    assert values(spark, grade_number, given, "STRING") == [-2, -1, 0, 1, 8, 12, None, None, None]


def test_pad_never_cuts(spark):
    assert values(spark, pad2, ["1", "12", "100", "", None], "STRING") == [
        "01", "12", "100", "00", None,
    ]


@pytest.mark.parametrize(
    "low, high, text",
    [(3, 3, "03"), (-2, -1, "K0 to K1"), (0, 4, "K2 to 04"), (None, 3, None), (3, None, None)],
)
def test_grade_range(spark, low, high, text):
    df = spark.createDataFrame([(low, high)], "a INT, b INT")
    assert df.select(grade_range(F.col("a"), F.col("b"))).first()[0] == text


def test_school_year_turns_in_july(spark):
    days = [date(2026, 5, 5), date(2026, 6, 30), date(2026, 7, 1), date(2025, 12, 31), None]
    want = ["SY2526", "SY2526", "SY2627", "SY2526", None]
    assert values(spark, school_year, days, "DATE") == want


def test_school_year_at_the_turn_of_the_century(spark):
    days = [date(2000, 1, 1), date(2000, 8, 1)]
    assert values(spark, school_year, days, "DATE") == ["SY9900", "SY0001"]


def test_birth_date_forms(spark):
    given = ["9/3/2016", "09/03/2016", " 9/3/2016 00:00:00", "9/3/16", "9/3/20161",
             "", "bad", "02/30/2016", "13/1/2016", "9-3-2016", None]
    day = date(2016, 9, 3)
    want = [day, day, day, date(16, 9, 3), day, None, None, None, None, None, None]
    assert values(spark, birth_date, given, "STRING") == want


def test_rounding_takes_exact_ties_to_even(spark):
    assert values(spark, round2, [1 / 8, 3 / 8, 5 / 8, 7 / 8], "DOUBLE") == [
        0.12, 0.38, 0.62, 0.88,
    ]


def test_share_of_zero_is_infinite(spark):
    df = spark.createDataFrame([(3, 0), (3, 4), (3, None)], "a INT, b INT")
    got = [r[0] for r in df.select(share(F.col("a"), F.col("b"))).collect()]
    assert got == [float("inf"), 0.75, None]


def test_unknown_conditions(spark):
    unknown = F.lit(None).cast("boolean")
    missing = F.lit(None).cast("string")
    row = spark.range(1).select(
        if_known(unknown, F.lit(1), F.lit(2)),
        one_of(missing, ("a",)),
        has_text(missing, "a"),
        ~one_of(missing, ("a",)),
    ).first()
    assert tuple(row) == (None, False, False, True)


def test_iep_level(spark):
    given = ["S1", "S2", "S3", "S", "", "SX", None]
    assert values(spark, iep_level, given, "STRING") == [1, 2, 3, None, None, None, None]


def test_program_type_key_keeps_accented_letters(spark):
    given = ["Sub-Sep", "Gen Ed", "SEI", "Bilingüe", None]
    want = ["subsep", "gened", "sei", "bilingüe", None]
    assert values(spark, program_type_key, given, "STRING") == want
