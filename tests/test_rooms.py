"""Rules on hand-written rooms, one behaviour each."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from roomledger import schemas
from roomledger.config import Rules
from roomledger.operators import errors, metrics, refdata, rooms
from roomledger.plans.district import District
from roomledger.plans.staging import Staging
from tests.cases import inputs, students_of, table


@pytest.fixture(autouse=True, scope="module")
def small_plans(spark):
    """A handful of rows needs neither partitions nor replanning."""
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def one(df, **where):
    for name, value in where.items():
        df = df.where(F.col(name).eqNullSafe(value))
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]


def district(spark, *groups, **tables):
    return District(inputs(spark, students_of(*groups), **tables))


# -- keys that may be missing ---------------------------------------------------


def test_room_without_code_keeps_its_own_counts(spark):
    d = district(spark, (3, {"homeroom": None}), (2, {"homeroom": ""}), (4, {}))
    totals = d.room_totals()
    assert one(totals, homeroom=None)["totalStudents"] == 3
    assert one(totals, homeroom="")["totalStudents"] == 2


def test_students_without_school_and_of_the_excluded_school_are_out(spark):
    d = district(spark, (2, {"sch": None}), (2, {"sch": 3003}), (1, {}))
    assert d.enrolled().count() == 1


def test_blank_and_missing_program_codes(spark):
    d = district(spark, (2, {"projection_group": ""}), (3, {"projection_group": None}), (1, {}))
    types = {r["classtype"]: r["totalStudents"] for r in d.type_counts().collect()}
    assert types == {None: 5, "Gen Ed": 1}


def test_program_code_missing_on_both_sides_matches(spark):
    codes = table(
        spark,
        [{"programcode": None, "projection_group": "NP", "prgm": "X", "classtype": "No Program",
          "prgmtype": "Gen Ed"}],
        schemas.PROGRAM_CODES,
    ).withColumn("row_id", F.lit(1))
    d = district(spark, (2, {"projection_group": None}), program_codes=codes)
    assert one(d.type_counts())["classtype"] == "No Program"


# -- leading class type ---------------------------------------------------------


def leading(spark, *groups):
    d = district(spark, *groups)
    return {(r["sch"], r["homeroom"]): r["leading_type"]
            for r in rooms.class_type_max(d.room_totals()).collect()}


def test_general_education_gives_way_in_a_tie(spark):
    got = leading(spark, (3, {}), (3, {"projection_group": "SA4"}))
    assert got == {(4006, "H1"): "Autism"}


def test_other_ties_are_joined_in_order(spark):
    got = leading(spark, (3, {"projection_group": "SL4"}), (3, {"projection_group": "SA4"}))
    assert got == {(4006, "H1"): "Autism + Specific Learning Disability"}


def test_code_shared_by_schools_shares_the_text(spark):
    got = leading(
        spark,
        (3, {"projection_group": "SL4", "sch": 4007}),
        (5, {"projection_group": "SA4", "sch": 4006}),
        (9, {"sch": 4008}),
    )
    joined = "Autism + Specific Learning Disability"
    assert got == {(4006, "H1"): joined, (4007, "H1"): joined}


def test_undecoded_group_is_named_as_text_when_alone(spark):
    assert leading(spark, (3, {"projection_group": ""})) == {(4006, "H1"): "NA"}


def test_undecoded_group_vanishes_in_a_tie(spark):
    got = leading(spark, (3, {"projection_group": ""}), (3, {"projection_group": "SA4"}))
    assert got == {(4006, "H1"): "Autism"}
    assert leading(spark, (3, {"projection_group": ""}), (3, {})) == {}


def test_room_without_leading_type_is_classified_from_its_mix(spark):
    d = district(spark, (3, {"projection_group": ""}), (3, {}))
    room = one(rooms.classified(d.room_totals(), d.rules))
    assert room["leading_type"] is None and room["hrClasstype"] is None


def test_largest_sei_group(spark):
    d = district(
        spark,
        (3, {"projection_group": "BLS"}),
        (3, {"projection_group": "BLH"}),
        (9, {}),
        (2, {"projection_group": "BLH", "homeroom": "H2"}),
    )
    got = {r["homeroom"]: r["leading_sei"]
           for r in rooms.sei_max(d.type_counts(), Rules()).collect()}
    assert got == {"H1": "Multiligual SEI", "H2": "Haitian SEI"}


# -- classification -------------------------------------------------------------


@pytest.mark.parametrize(
    "mix, want",
    [
        ({"GE": 5, "SI4": 1}, "Inclusion"),
        ({"GE": 5, "SI3": 1}, "Inclusion"),
        ({"GE": 5, "SA4": 4}, "Inclusion"),
        ({"GE": 4, "SA4": 5}, "Autism"),
        ({"GE": 2, "BLS": 5}, "Spanish SEI"),
        ({"GE": 3, "BLS": 5}, "Spanish SEI"),
        ({"GE": 2, "BLS": 3, "DL": 4}, "Gen Ed"),
        ({"BLS": 3, "ML1": 4}, "Spanish SLIFE"),
        ({"GE": 6}, "Gen Ed"),
        ({"BLS": 2, "BLH": 2}, "Haitian SEI + Spanish SEI"),
    ],
)
def test_room_type(spark, mix, want):
    d = district(spark, *[(n, {"projection_group": code}) for code, n in mix.items()])
    assert one(rooms.classified(d.room_totals(), d.rules))["hrClasstype"] == want


# -- extremes over missing values -----------------------------------------------


def test_one_missing_grade_hides_the_range(spark):
    d = district(spark, (3, {}), (1, {"gradenum": None}))
    room = one(d.room_totals())
    assert (room["minGradenum"], room["maxGradenum"], room["grade"]) == (None, None, None)


def test_one_unreadable_birth_date_hides_the_spread(spark):
    d = district(spark, (3, {}), (1, {"dob": "bad"}), (1, {"homeroom": "H2"}),
                 (1, {"homeroom": "H2", "dob": "10/3/2016"}))
    base = d.room_base()
    assert one(base, homeroom="H1")["dobDaySpan"] is None
    assert one(base, homeroom="H2")["dobDaySpan"] == 30
    assert one(base, homeroom="H2")["dobMonthSpan"] == 0.99


def test_merged_campuses_give_one_row_per_spread(spark):
    d = district(
        spark,
        (6, {"sch": 5001}),
        (1, {"sch": 5001, "dob": "9/4/2016"}),
        (4, {"sch": 5002}),
        (1, {"sch": 5002, "dob": "9/8/2016"}),
    )
    rows = d.report_rooms().collect()
    assert {r["sch"] for r in rows} == {5000}
    assert sorted(r["dobDaySpan"] for r in rows) == [1, 5]
    assert {r["totalStudents"] for r in rows} == {12}


def test_merged_campuses_with_one_spread_stay_one_row(spark):
    d = district(spark, (6, {"sch": 5001}), (6, {"sch": 5002}))
    assert one(d.report_rooms())["totalStudents"] == 12


def test_ignored_and_ended_merges(spark):
    d = district(spark, (1, {"sch": 4171}), (1, {"sch": 4006}))
    assert {r["sch"] for r in d.enrolled().collect()} == {4171, 4006}


# -- limits ---------------------------------------------------------------------


def limits(spark, *rows):
    return table(spark, rows, schemas.CLASS_LIMITS)


def test_limits_are_of_the_lowest_grade(spark):
    d = district(
        spark,
        (5, {"gradenum": 1}),
        (5, {"gradenum": 2}),
        class_limits=limits(spark, ("GE", "1", 20, 22, 3), ("GE", "2", 25, 27, 3)),
    )
    room = one(d.report_rooms())
    assert (room["capacity"], room["seats"], room["util"], room["overage"]) == (20, 10, 0.5, 0)


def test_repeated_limit_with_other_values_repeats_the_room(spark):
    two = limits(spark, ("GE", "03", 20, 22, 3), ("GE", "3", 21, 23, 3), ("GE", "3", 21, 23, 3))
    rows = district(spark, (8, {}), class_limits=two).report_rooms().collect()
    assert sorted(r["capacity"] for r in rows) == [20, 21]


def test_para_limit_for_full_sei_rooms(spark):
    given = limits(spark, ("BLS", "3", 6, 9, 3))
    small = district(spark, (6, {"projection_group": "BLS"}), class_limits=given)
    full = district(spark, (7, {"projection_group": "BLS"}), class_limits=given)
    assert one(small.report_rooms())["capacity"] == 6
    assert one(full.report_rooms())["capacity"] == 9


def test_para_limit_by_default_groups_and_slife(spark):
    given = limits(spark, ("SL4", "3", 6, 9, 3), ("ML1", "3", 20, 22, 3))
    d = district(
        spark,
        (7, {"projection_group": "SL4"}),
        (7, {"projection_group": "ML1", "homeroom": "H2"}),
        class_limits=given,
    )
    assert one(d.report_rooms(), homeroom="H1")["capacity"] == 9
    assert one(d.report_rooms(), homeroom="H2")["capacity"] == 15


def test_room_without_limit_shows_zero_capacity_and_no_seats(spark):
    d = district(spark, (8, {}), class_limits=limits(spark, ("GE", "5", 20, 22, 3)))
    room = one(d.measured_rooms())
    assert (room["capacity"], room["seats"], room["util"], room["overage"]) == (0, None, None, None)


def test_own_inclusion_ratio(spark):
    ratios = table(spark, [(4006, "x", 3, 5, 15)], schemas.INCLUSION_RATIOS)
    groups = ((8, {}), (2, {"projection_group": "SI4"}))
    own = one(district(spark, *groups, inclusion_ratios=ratios).report_rooms())
    assert (own["capacity"], own["genedCap"], own["spedCap"]) == (20, 15, 5)
    general = one(district(spark, (8, {}), inclusion_ratios=ratios).report_rooms())
    assert (general["genedCap"], general["spedCap"]) == (None, None)


def test_limit_group_is_the_first_listed_row(spark):
    rows = [
        ("A", "AIM", "SPED", "AIM", "x"),
        ("B", "SI2", "SPED", "Inclusion", "x"),
        ("C", "SI4", "SPED", "Inclusion", "x"),
        ("D", "G2", "Reg Ed", "Gen Ed", "x"),
        ("E", "G1", "Reg Ed", "Gen Ed", "x"),
        ("F", None, "Reg Ed", "Lost", "x"),
        ("G", "SI4", "SPED", None, "x"),
        ("H", "GE", "SPED", None, "x"),
    ]
    codes = table(spark, rows, schemas.PROGRAM_CODES).withColumn(
        "row_id", F.ascii("programcode")
    )
    got = {r[0]: r[1] for r in refdata.limit_group_by_type(codes, Rules()).collect()}
    assert got == {"Inclusion": "SI4", "Gen Ed": "G2", None: "SI4"}


# -- paper rooms ----------------------------------------------------------------


@pytest.mark.parametrize(
    "count, fields, kept",
    [
        (1, {}, False),
        (5, {}, False),
        (6, {}, True),
        (39, {}, True),
        (40, {}, False),
        (8, {"homeroom": ""}, False),
        (8, {"homeroom": None}, False),
        (8, {"homeroom": "A0001"}, False),
        (2, {"projection_group": "SA4"}, False),
        (3, {"projection_group": "SA4"}, True),
        (2, {"projection_group": "SA4", "sch": 4610}, True),
        (1, {"projection_group": "SA4", "sch": 4610}, False),
        (2, {"projection_group": ""}, False),
        (2, {"projection_group": "", "sch": 4610}, True),
    ],
)
def test_which_rooms_are_real(spark, count, fields, kept):
    rooms_left = district(spark, (count, {"gradenum": 4, **fields})).report_rooms()
    assert rooms_left.count() == int(kept)


# -- shares and flags -----------------------------------------------------------

FLAG_COLUMNS = """
    snPct DOUBLE, btu_max DOUBLE, hrClasstype STRING, minGradenum INT, maxGradenum INT,
    grade STRING, sch INT
"""


def flags(spark, *row):
    return one(metrics.with_flags(spark.createDataFrame([row], FLAG_COLUMNS), Rules()))


@pytest.mark.parametrize(
    "share, of_limit, want",
    [
        (0.45, 0.35, None),
        (0.46, 0.41, "Nearing 50% - Enrollment"),
        (0.49, None, "Nearing 50% - Enrollment"),
        (0.50, 0.36, "Nearing 40% - BTU Limit"),
        (0.50, 0.40, "Nearing 40% - BTU Limit"),
        (0.50, 0.41, "Over 40% - BTU Limit"),
        (0.50, 0.35, "Over 50% - Enrollment"),
        (None, None, None),
    ],
)
def test_issue_flag(spark, share, of_limit, want):
    assert flags(spark, share, of_limit, "Gen Ed", 3, 3, "03", 4006)["issueFlag"] == want


@pytest.mark.parametrize(
    "room_type, low, high, grade, sch, shown, flag, group",
    [
        ("Gen Ed", 1, 1, "01", 4006, "Homeroom", None, "Major"),
        ("Inclusion", 7, 7, "07", 4006, "Homeroom", None, "Major"),
        ("Gen Ed", 3, 4, "03 to 04", 4006, "Gen Ed", "Needs Review - Multigraded", "Major"),
        ("Gen Ed", 3, 4, "03 to 04", 4321, "Gen Ed", None, "Major"),
        ("Gen Ed", -2, -1, "K0 to K1", 4006, "Gen Ed", None, "Major"),
        ("Autism", 3, 3, "03", 4006, "ABA", None, "ABA"),
        ("Autism + X", 3, 3, "03", 4006, "ABA + X", "Needs Review", "ABA + X"),
        (None, 3, 3, "03", 4006, None, "Blank Classtype", None),
        ("NA", 3, 3, "03", 4006, "NA", None, "NA"),
        ("Gen Ed", None, None, None, 4006, "Gen Ed", None, "Major"),
    ],
)
def test_display_type_and_review_flag(spark, room_type, low, high, grade, sch, shown, flag, group):
    got = flags(spark, 0.1, 0.1, room_type, low, high, grade, sch)
    assert (got["hrClasstype"], got["homeroom_flag"], got["groups"]) == (shown, flag, group)


@pytest.mark.parametrize(
    "grade, limit", [(-2, 20), (-1, 20), (0, 22), (2, 22), (3, 23), (6, 25), (8, 25), (9, None)]
)
def test_contract_limit_by_lowest_grade(spark, grade, limit):
    d = district(spark, (6, {"gradenum": grade}), (2, {"gradenum": grade, "sncode": "S1"}))
    room = one(d.measured_rooms())
    assert room["btu_limit"] == limit
    assert room["snPct"] == 0.25
    assert room["btu_max"] == (round(2 / limit, 2) if limit else None)


def test_exempt_types_have_no_shares(spark):
    d = district(spark, (8, {"projection_group": "SA4", "sncode": "S1"}))
    room = one(d.measured_rooms())
    assert (room["snPct"], room["btu_limit"], room["btu_max"]) == (None, None, None)


def test_plan_and_language_counts(spark):
    d = district(
        spark,
        (2, {"sncode": "S1", "mostrecenteld": "1"}),
        (1, {"sncode": "S2", "mostrecenteld": "5"}),
        (1, {"sncode": "S3", "mostrecenteld": ""}),
        (1, {"sncode": ""}),
        (2, {}),
    )
    room = one(d.room_totals())
    counts = ("totalStudents", "snCount", "otherIEP", "noIEP", "eld1", "eld2", "eld5")
    assert [room[c] for c in counts] == [7, 4, 3, 3, 2, 0, 1]


# -- misplaced students ---------------------------------------------------------


def flagged(spark, *groups, **tables):
    d = district(spark, *groups, **tables)
    return d.student_errors(Staging.of(spark)).collect()


def test_wrong_grade_in_a_regular_room(spark):
    rows = flagged(spark, (6, {"gradenum": 3}), (2, {"gradenum": 4}))
    assert [(r["studentno"], r["error_flag"]) for r in rows] == [
        (7, "Check Grade"), (8, "Check Grade"),
    ]


def test_multigrade_school_is_never_flagged(spark):
    assert flagged(spark, (6, {"gradenum": 3, "sch": 4321}), (2, {"gradenum": 4, "sch": 4321})) == []


def test_inclusion_student_among_general_students_is_fine(spark):
    rows = flagged(spark, (6, {"gradenum": 3}), (2, {"gradenum": 4, "projection_group": "SI4"}),
                   (1, {"gradenum": 4, "projection_group": "BLS"}))
    assert [(r["studentno"], r["error_flag"]) for r in rows] == [(9, "Program or School Error")]


def test_student_repeats_per_tied_dominant_type(spark):
    rows = flagged(
        spark, (4, {"projection_group": "SL4"}), (4, {"projection_group": "SF4"}),
        (1, {"projection_group": "DL"}),
    )
    per_student = {}
    for r in rows:
        per_student[r["studentno"]] = per_student.get(r["studentno"], 0) + 1
    assert per_student == {**{n: 1 for n in range(1, 9)}, 9: 2}


def test_same_dominant_type_in_two_schools_counts_twice(spark):
    rows = flagged(
        spark,
        (5, {"projection_group": "SL4"}),
        (2, {"projection_group": "SF4"}),
        (5, {"projection_group": "SL4", "sch": 4007}),
        (2, {"projection_group": "DL", "sch": 4007}),
    )
    assert sorted(r["studentno"] for r in rows) == [6, 6, 7, 7, 13, 13, 14, 14]


def test_two_slife_types_are_no_error(spark):
    mixed = ((4, {"projection_group": "ML1"}), (4, {"projection_group": "ML2"}))
    assert flagged(spark, *mixed) == []


def test_room_of_unnamed_type_is_an_error_room(spark):
    d = district(spark, (8, {"projection_group": ""}))
    room = one(d.error_rooms())
    assert (room["hrClasstype"], room["homeroom_flag"]) == ("NA", None)
    assert {r["error_flag"] for r in d.student_errors(Staging.of(spark)).collect()} == {
        "Program or School Error"
    }


def test_missing_type_is_known_when_some_student_has_none(spark):
    """A room with no type at all is no error room if the snapshot has undecoded students."""
    d = district(spark, (7, {"projection_group": ""}), (7, {}))
    assert one(d.report_rooms())["homeroom_flag"] == "Blank Classtype"
    assert d.error_rooms().count() == 0


@pytest.mark.parametrize(
    "grades, want",
    [([3, 4, 4, 3], "03"), ([4, 3, 3, 4], "04"), ([None, 3, None], None), ([3, 4, 4], "04")],
)
def test_usual_grade_takes_the_first_seen_in_a_tie(spark, grades, want):
    d = district(spark, *[(1, {"gradenum": g}) for g in grades])
    assert one(d.room_totals(trace_errors=True))["mode_grade"] == want


# -- reports --------------------------------------------------------------------


def capacities(spark, *rows):
    return table(spark, rows, schemas.HOMEROOM_CROSSWALK)


def test_report_takes_every_recorded_capacity_of_its_year(spark):
    d = district(
        spark,
        (10, {}),
        homeroom_crosswalk=capacities(
            spark,
            ("SY2526", 1, "H1", "HR", 20),
            ("SY2526", 2, "H1", "HR", 24),
            ("SY2425", 1, "H1", "HR", 99),
        ),
    )
    rows = d.district_report().collect()
    assert sorted((r["Capacity"], r["Available Seats"]) for r in rows) == [(20, 10), (24, 14)]
    assert {r["report_updated"] for r in rows} == {"2026-05-05"}


def test_room_without_recorded_capacity_stays(spark):
    row = one(district(spark, (10, {})).district_report())
    assert (row["Capacity"], row["Available Seats"]) == (None, None)


def test_school_report_calls_young_rooms_homerooms(spark):
    d = district(spark, (4, {"gradenum": -2, "projection_group": "DL"}),
                 (6, {"gradenum": -1, "projection_group": "DL"}))
    assert one(d.district_report())["Class Type"] == "Dual-Language"
    school = one(d.school_report())
    assert school["Class Type"] == "Homeroom"
    assert not [c for c in school.asDict() if c.startswith("eld")]


def test_report_orders(spark):
    d = district(
        spark,
        (8, {"sch": 4009, "homeroom": "B"}),
        (8, {"sch": 4008, "homeroom": "A", "gradenum": 5}),
        (8, {"sch": 4008, "homeroom": "C", "gradenum": 4}),
        (8, {"sch": 4008, "homeroom": "D", "projection_group": "BLS"}),
    )
    report = d.district_report().collect()
    assert [r["Homeroom"] for r in report] == ["C", "A", "D", "B"]
    listing = d.student_list().collect()
    assert [r["homeroom"] for r in listing[::8]] == ["A", "C", "D", "B"]
    sheet = d.capacity_sheet().collect()
    assert [r["homeroom"] for r in sheet] == ["D", "C", "A", "B"]


def test_lists_put_missing_values_last(spark):
    d = district(spark, (1, {"homeroom": None}), (1, {"homeroom": "Z"}), (1, {"homeroom": ""}))
    assert [r["homeroom"] for r in d.student_list().collect()] == ["", "Z", None]


def test_dates_do_not_mix(spark):
    later = {"snapshot_date": "2026-09-15"}
    d = district(spark, (8, {}), (4, {**later, "projection_group": "SA4"}),
                 (4, {**later, "projection_group": "SL4"}))
    got = {r["snapshot_date"]: r["hrClasstype"] for r in d.report_rooms().collect()}
    assert got == {
        date(2026, 5, 5): "Gen Ed",
        date(2026, 9, 15): "ABA + Specific Learning Disability",
    }
    assert {r["sch_year"] for r in d.enrolled().collect()} == {"SY2526", "SY2627"}


def test_error_codes_count_ties(spark):
    d = district(spark, (4, {"projection_group": "SL4"}), (4, {"projection_group": "SF4"}))
    got = {r["dominant_type"]: r["copies"] for r in errors.error_codes(d.error_rooms()).collect()}
    assert got == {"Specific Learning Disability": 1, "Emotional Impairment": 1}


CHANGES = {
    "young_grades": "K1 to K2",
    "mixed_slife_pattern": "SLIFE.*never",
    "shown_as": ("Specific Learning Disability", "SLD"),
    "few_general": 1,
    "too_many": 9,
    "single": 8,
    "tiny_regular": 9,
    "tiny_sped": 8,
    "near_half": 0.1,
    "half": 0.2,
    "near_btu": 0.05,
    "over_btu": 0.1,
}


@pytest.fixture(scope="module")
def varied(spark):
    """Rooms made so that each rule matters to one of them; and what a report of them shows."""
    given = inputs(spark, students_of(
        (4, {"homeroom": "Y", "gradenum": -2}), (4, {"homeroom": "Y", "gradenum": -1}),
        (4, {"homeroom": "K", "gradenum": -1}), (4, {"homeroom": "K", "gradenum": 0}),
        (4, {"homeroom": "M", "projection_group": "ML1"}), (4, {"homeroom": "M", "projection_group": "ML2"}),
        (8, {"homeroom": "L", "projection_group": "SL4"}), (8, {"homeroom": "A", "projection_group": "SA4"}),
        (2, {"homeroom": "S"}), (8, {"homeroom": "S", "projection_group": "BLS"}),
        (8, {"homeroom": "G"}), (9, {"homeroom": "N"}),
        (1, {"homeroom": "P", "sncode": "S1"}), (7, {"homeroom": "P"}),
        (3, {"homeroom": "Q", "sncode": "S1"}), (20, {"homeroom": "Q"}),
        (2, {"homeroom": "R", "sncode": "S1"}), (6, {"homeroom": "R"}),
        (2, {"homeroom": "T"}), (3, {"homeroom": "T", "projection_group": "BLS"}),
        (6, {"homeroom": "T", "projection_group": "DL"}),
    ))

    def shown(rules):
        found = District(given, rules).error_rooms(
            types=District(given, rules).known_types().where("classtype <> 'Multilingual SLIFE'")
        )
        kept = ("homeroom", "hrClasstype", "homeroom_flag", "issueFlag", "totalStudents")
        rooms_shown = District(given, rules).report_rooms().select(*kept).collect()
        return sorted(map(str, rooms_shown)), sorted(r["homeroom"] for r in found.collect())

    return shown, shown(Rules())


@pytest.mark.parametrize("name", sorted(CHANGES))
def test_a_changed_rule_changes_the_report(varied, name):
    from dataclasses import replace

    shown, as_usual = varied
    assert shown(replace(Rules(), **{name: CHANGES[name]})) != as_usual
