"""One SQL statement per registered query, assembled from named steps."""

from __future__ import annotations

import re

from oracle.tables import TABLES, grade_label, school_year, student_snapshots
from roomledger.sources.star import HISTORY_DAYS, SNAPSHOT_DAY

# Fixed values, written out here as well so that the engine's lists are checked against them.
_EXEMPT = """
    'Autism', 'Early Childhood Center-Based', 'Emotional Impairment', 'Hearing Impairment',
    'Mild Intellectual Impairment', 'Moderate Intellectual Impairment', 'Multiple Disabilities',
    'Severe Intellectual Impairment', 'Specific Learning Disability',
    'Hatian SLIFE', 'Cape Verdean SLIFE', 'Spanish SLIFE', 'Multilingual SLIFE'"""
_SCHOOL_COLUMNS = """
    sch AS "School Code", schname AS "School Name", grade AS "Grade", hrClasstype AS "Class Type",
    homeroom AS "Homeroom", homeroom_flag AS "Homeroom Flag", issueFlag AS "Issue Flag",
    tot_capacity AS "Capacity", totalStudents AS "Total Students", seats AS "Available Seats",
    noIEP AS "No IEP", inclusion AS "Inclusion", subsep AS "Sub Seperate", otherIEP AS "Other IEPs",
    snCount AS "Total IEPs", btu_max AS "Pct of BTU Max", btu_limit AS "BTU Limit",
    snPct AS "Pct of Enrollment", dobMonthSpan"""
_DISTRICT_COLUMNS = f"{_SCHOOL_COLUMNS}, eld1, eld2, eld3, eld4"
_ROOM = "snapshot_date, sch, homeroom"
_COUNTED = """gened, inclusion, subsep, sei, bilingual, eld1, eld2, eld3, eld4,
       dobDaySpan, dobMonthSpan, noIEP, snCount, otherIEP"""


def _on_room(a: str, b: str) -> str:
    return (
        f"{a}.snapshot_date = {b}.snapshot_date AND {a}.sch IS NOT DISTINCT FROM {b}.sch "
        f"AND {a}.homeroom IS NOT DISTINCT FROM {b}.homeroom"
    )


STEPS = {
    # -- students -----------------------------------------------------------
    "snapshot": "SELECT * FROM student_snapshots WHERE sch <> 3003",
    "born": r"""
SELECT *, CAST(try_strptime(
    nullif(regexp_extract(dob, '^ *([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})', 1), ''), '%m/%d/%Y'
    ) AS DATE) AS birth
FROM snapshot""",
    "spanned": f"""
SELECT *, round_even(dobDaySpan / 30.416666::DOUBLE, 2) AS dobMonthSpan
FROM (SELECT *, CAST(CASE WHEN bool_and(birth IS NOT NULL) OVER w
                     THEN date_diff('day', min(birth) OVER w, max(birth) OVER w) END AS INTEGER)
             AS dobDaySpan
      FROM born WINDOW w AS (PARTITION BY {_ROOM})) AS s""",
    "enrollment": f"""
SELECT s.snapshot_date, s.studentno, s.studentname, coalesce(m.new_sch, s.sch) AS sch,
       s.sch AS campus, s.grade, s.gradenum, s.homeroom, s.lepstatus, s.mostrecenteld AS eld,
       s.sncode, s.firstlang, s.dobDaySpan, s.dobMonthSpan, {school_year("s.snapshot_date")} AS sch_year,
       s.code AS programcode, c.projection_group, c.classtype, c.prgmtype
FROM (SELECT *, CASE WHEN projection_group LIKE '%3' THEN 'SI4' ELSE projection_group END AS code
      FROM spanned) AS s
LEFT JOIN (SELECT * FROM split_schools
           WHERE final_year IS NULL AND sch NOT IN (4171, 4650, 4391)) AS m ON s.sch = m.sch
LEFT JOIN program_codes c ON s.code IS NOT DISTINCT FROM c.programcode""",
    # -- rollups ------------------------------------------------------------
    "program_counts": f"""
SELECT {_ROOM}, {", ".join(
    f"count(*) FILTER (WHERE lower(regexp_replace(prgmtype, '[^a-zA-Z0-9]', '', 'g')) = '{p}') AS {p}"
    for p in ("gened", "inclusion", "subsep", "sei", "bilingual"))}
FROM enrollment GROUP BY ALL""",
    "cells": f"""
SELECT {_ROOM}, classtype,
       CASE WHEN projection_group IS NOT NULL AND regexp_matches(projection_group, 'BL[A-Z]')
            THEN 1 ELSE 0 END AS seiFlag,
       count(*) AS totalStudents
FROM enrollment GROUP BY ALL""",
    "top_cells": f"""
SELECT *, count(*) OVER (PARTITION BY snapshot_date, homeroom) AS dup
FROM (SELECT *, max(totalStudents) OVER (PARTITION BY {_ROOM}) AS top FROM cells) AS t
WHERE totalStudents = top""",
    "kept_cells": "SELECT * FROM top_cells WHERE dup = 1 OR (dup > 1 AND classtype <> 'Gen Ed')",
    "classtype_max": """
SELECT DISTINCT k.snapshot_date, k.sch, k.homeroom, j.leading_type
FROM kept_cells k
JOIN (SELECT snapshot_date, homeroom,
             string_agg(coalesce(classtype, 'NA'), ' + '
                        ORDER BY sch, classtype NULLS LAST, seiFlag) AS leading_type
      FROM kept_cells GROUP BY snapshot_date, homeroom) AS j
  ON k.snapshot_date = j.snapshot_date AND k.homeroom IS NOT DISTINCT FROM j.homeroom""",
    "sei_max": f"""
SELECT DISTINCT {_ROOM}, CASE WHEN ties > 1 THEN 'Multiligual SEI' ELSE classtype END AS leading_sei
FROM (SELECT *, count(*) OVER (PARTITION BY {_ROOM}) AS ties
      FROM (SELECT *, max(totalStudents) OVER (PARTITION BY {_ROOM}) AS top
            FROM cells WHERE seiFlag = 1) AS t
      WHERE totalStudents = top) AS t""",
    "eld_counts": f"""
SELECT {_ROOM}, {", ".join(f"count(*) FILTER (WHERE eld = '{n}') AS eld{n}" for n in range(1, 6))}
FROM enrollment WHERE eld IS NOT NULL AND eld <> '' GROUP BY ALL""",
    "counted": f"""
SELECT *, count(*) FILTER (WHERE sncode IS NOT NULL AND sncode <> '') OVER w AS sn,
       count(*) FILTER (WHERE try_cast(substr(sncode, 2, 1) AS INTEGER) IN (1, 2)) OVER w
           AS other,
       count(*) OVER w AS total,
       CASE WHEN count(gradenum) OVER w = count(*) OVER w THEN min(gradenum) OVER w END AS lowest,
       CASE WHEN count(gradenum) OVER w = count(*) OVER w THEN max(gradenum) OVER w END AS highest
FROM enrollment WINDOW w AS (PARTITION BY {_ROOM})""",
    "graded": f"""
SELECT *, {grade_label("lowest")} AS minGrade, {grade_label("highest")} AS maxGrade,
       CASE WHEN lowest = highest THEN {grade_label("lowest")}
            WHEN lowest <> highest
            THEN ({grade_label("lowest")}) || ' to ' || ({grade_label("highest")}) END AS gradeRange
FROM counted""",
    "identified": f"""
SELECT *, CASE WHEN step2 = '' THEN leading_type ELSE step2 END AS hrClasstype
FROM (SELECT *, CASE WHEN gened < 3 AND sei > 0 AND step1 <> 'Inclusion'
                          AND leading_type IS NOT NULL AND contains(leading_type, 'SEI')
                     THEN leading_type
                     WHEN gened < 3 AND sei > 0 AND step1 <> 'Inclusion'
                          AND NOT coalesce(contains(leading_type, 'SLIFE'), false)
                     THEN 'Gen Ed' ELSE step1 END AS step2
      FROM (SELECT g.*, p.gened, p.inclusion, p.subsep, p.sei, p.bilingual, m.leading_type,
                   coalesce(e.eld1, 0) AS eld1, coalesce(e.eld2, 0) AS eld2,
                   coalesce(e.eld3, 0) AS eld3, coalesce(e.eld4, 0) AS eld4,
                   coalesce(e.eld5, 0) AS eld5,
                   CASE WHEN p.inclusion + p.subsep > 0 AND p.gened + p.sei > p.subsep
                        THEN 'Inclusion' ELSE '' END AS step1
            FROM graded g
            LEFT JOIN program_counts p ON {_on_room("g", "p")}
            LEFT JOIN classtype_max m ON {_on_room("g", "m")}
            LEFT JOIN eld_counts e ON {_on_room("g", "e")}) AS a) AS b""",
    # -- reference tables ---------------------------------------------------
    "type_map": """
SELECT classtype, projection_group AS limit_key
FROM (SELECT *, row_number() OVER (PARTITION BY classtype ORDER BY row_id) AS rn
      FROM program_codes
      WHERE projection_group <> 'AIM'
        AND NOT (classtype = 'Inclusion' AND projection_group <> 'SI4')) AS t
WHERE rn = 1""",
    "limits": """
SELECT l.projection_group AS limit_key,
       CASE WHEN length(l.grade) < 2 THEN lpad(l.grade, 2, '0') ELSE l.grade END AS grade,
       CASE WHEN l.projection_group IN ('SL4', 'SF4', 'SA4') THEN l.sizelimit_with_para
            ELSE l.sizelimit_no_para END AS room_limit,
       l.sizelimit_with_para AS limit_with_para, l.program2_capacity AS inclusion_limit, p.prgm
FROM class_limits l
LEFT JOIN (SELECT DISTINCT projection_group, prgm FROM program_codes) AS p
  ON l.projection_group IS NOT DISTINCT FROM p.projection_group
WHERE p.prgm IS NOT NULL""",
    "capacity": """
SELECT c.sch_year, c.classyearno, c.homeroom, c.type, c.tot_capacity,
       s.program1, s.program2, s.cap_1, s.cap_2
FROM homeroom_crosswalk c
LEFT JOIN structure_data s ON c.sch_year IS NOT DISTINCT FROM s.sch_year
     AND c.classyearno IS NOT DISTINCT FROM s.classyearno""",
    # -- rooms --------------------------------------------------------------
    "room_base": """
SELECT DISTINCT i.snapshot_date, i.sch, n.schname, i.homeroom, i.hrClasstype,
       i.gradeRange AS grade, i.lowest AS minGradenum, i.highest AS maxGradenum,
       i.total AS totalStudents, i.gened, i.inclusion, i.subsep, i.sei, i.bilingual,
       i.eld1, i.eld2, i.eld3, i.eld4, i.dobDaySpan, i.dobMonthSpan,
       i.total - i.sn AS noIEP, i.sn AS snCount, i.other AS otherIEP,
       l.prgm, l.room_limit, l.limit_with_para, l.inclusion_limit
FROM identified i
LEFT JOIN type_map t ON i.hrClasstype IS NOT DISTINCT FROM t.classtype
LEFT JOIN limits l ON t.limit_key IS NOT DISTINCT FROM l.limit_key
     AND i.minGrade IS NOT DISTINCT FROM l.grade
LEFT JOIN school_names n ON i.sch = n.sch""",
    "ratio_caps": f"""
SELECT snapshot_date, sch, schname, homeroom, hrClasstype, grade, minGradenum, maxGradenum,
       totalStudents, {_COUNTED}, prgm, limit_with_para, limit1 AS room_limit, inc1 AS inclusion_limit,
       CASE WHEN hrClasstype = 'Inclusion' THEN limit1 - inc1 END AS genedCap,
       CASE WHEN hrClasstype = 'Inclusion' THEN inc1 END AS spedCap
FROM (SELECT b.*,
             CASE WHEN hrClasstype IS NULL AND r.inc IS NOT NULL THEN NULL
                  WHEN hrClasstype = 'Inclusion' AND r.inc IS NOT NULL THEN r.inc + r.gen
                  ELSE room_limit END AS limit1,
             CASE WHEN hrClasstype IS NULL AND r.inc IS NOT NULL THEN NULL
                  WHEN hrClasstype = 'Inclusion' AND r.inc IS NOT NULL THEN r.inc
                  ELSE inclusion_limit END AS inc1
      FROM room_base b
      LEFT JOIN inclusion_ratios r ON b.sch = r.sch
           AND b.minGradenum IS NOT DISTINCT FROM r.gradenum) AS x""",
    "limits_applied": f"""
SELECT snapshot_date, sch, schname, homeroom, hrClasstype, grade, minGradenum, maxGradenum,
       totalStudents, {_COUNTED}, prgm, genedCap, spedCap,
       CASE WHEN limit3 = 0 THEN 'infinity'::DOUBLE
            ELSE round_even(totalStudents::DOUBLE / limit3::DOUBLE, 2) END AS util,
       limit3 - totalStudents AS seats,
       CASE WHEN totalStudents > limit3 THEN totalStudents - limit3
            WHEN totalStudents <= limit3 THEN 0 END AS overage,
       coalesce(limit3, 0) AS capacity
FROM (SELECT *, CASE WHEN coalesce(contains(hrClasstype, 'SLIFE'), false) THEN 15 ELSE limit2 END
             AS limit3
      FROM (SELECT *,
                   CASE WHEN room_limit IS NULL THEN NULL
                        WHEN totalStudents > room_limit AND hrClasstype IS NULL THEN NULL
                        WHEN totalStudents > room_limit
                             AND (contains(hrClasstype, 'SEI') OR hrClasstype = 'Dual-Language')
                        THEN limit_with_para ELSE room_limit END AS limit2
            FROM ratio_caps) AS a) AS b""",
    "sped_share": f"""
SELECT *, round_even(snCount::DOUBLE / btu_limit, 2) AS btu_max
FROM (SELECT *,
             CASE WHEN coalesce(hrClasstype IN ({_EXEMPT}), false) THEN NULL
                  ELSE round_even(snCount::DOUBLE / totalStudents, 2) END AS snPct,
             CAST(CASE WHEN coalesce(hrClasstype IN ({_EXEMPT}), false) THEN NULL
                  WHEN minGradenum < 0 THEN 20 WHEN minGradenum < 3 THEN 22
                  WHEN minGradenum < 6 THEN 23 WHEN minGradenum < 9 THEN 25 END AS INTEGER)
                  AS btu_limit
      FROM limits_applied) AS a""",
    "real_rooms": """
SELECT * FROM sped_share
WHERE totalStudents < 40 AND homeroom <> '' AND NOT contains(homeroom, '000')
  AND totalStudents <> 1
  AND NOT (gened + sei + bilingual <= 5 AND coalesce(prgm IN ('Reg Ed', 'ELL'), false))
  AND NOT (totalStudents <= 2 AND prgm = 'SPED' AND sch <> 4610)""",
    "flagged_rooms": """
SELECT *, CASE WHEN hrClasstype IN ('Homeroom', 'Inclusion', 'Gen Ed') THEN 'Major'
               ELSE hrClasstype END AS groups,
       CASE WHEN sch = 4321 THEN NULL
            WHEN hrClasstype IS NULL THEN 'Blank Classtype'
            WHEN hrClasstype IN ('Homeroom', 'Gen Ed', 'Inclusion') AND contains(grade, 'to')
                 AND maxGradenum <> -1 THEN 'Needs Review - Multigraded'
            WHEN contains(hrClasstype, '+') THEN 'Needs Review' END AS homeroom_flag
FROM (SELECT * REPLACE (
             CASE WHEN contains(hrClasstype, 'Autism') THEN replace(hrClasstype, 'Autism', 'ABA')
                  WHEN hrClasstype IN ('Gen Ed', 'Inclusion')
                       AND coalesce(minGradenum IN (0, 1, 2, 7, 8), false) THEN 'Homeroom'
                  ELSE hrClasstype END AS hrClasstype),
             CASE WHEN snPct > 0.45 AND snPct < 0.50 THEN 'Nearing 50% - Enrollment'
                  WHEN btu_max > 0.35 AND btu_max <= 0.40 THEN 'Nearing 40% - BTU Limit'
                  WHEN btu_max > 0.40 THEN 'Over 40% - BTU Limit'
                  WHEN snPct >= 0.5 THEN 'Over 50% - Enrollment' END AS issueFlag
      FROM real_rooms) AS a""",
    # -- errors -------------------------------------------------------------
    "error_rooms": """
SELECT * FROM (
  SELECT r.*,
         CASE WHEN coalesce(regexp_matches(r.hrClasstype, 'SLIFE.*SLIFE'), false) THEN 0
              WHEN r.hrClasstype IN ('Homeroom', 'Gen Ed', 'Inclusion')
                   AND r.minGradenum <> r.maxGradenum AND r.grade <> 'K0 to K1' AND r.sch <> 4321
              THEN 1
              WHEN t.snapshot_date IS NOT NULL OR r.hrClasstype IN ('Homeroom', 'ABA') THEN 0
              ELSE 1 END AS error
  FROM flagged_rooms r
  LEFT JOIN (SELECT DISTINCT snapshot_date, classtype FROM cells) AS t
    ON r.snapshot_date = t.snapshot_date AND r.hrClasstype IS NOT DISTINCT FROM t.classtype) AS e
WHERE error = 1""",
    "error_codes": "SELECT DISTINCT snapshot_date, homeroom FROM error_rooms",
    "dominant": """
SELECT snapshot_date, homeroom, classtype, seiFlag, totalStudents
FROM (SELECT c.*, max(totalStudents) OVER (PARTITION BY c.snapshot_date, c.homeroom) AS top
      FROM cells c SEMI JOIN error_codes e
        ON c.snapshot_date = e.snapshot_date AND c.homeroom = e.homeroom) AS t
WHERE totalStudents = top""",
    "mode_grade": """
SELECT snapshot_date, homeroom, grade AS mode_grade
FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_date, homeroom
                                   ORDER BY n DESC, first_seen) AS rn
      FROM (SELECT s.snapshot_date, s.homeroom, s.grade, count(*) AS n,
                   min(s.studentno) AS first_seen
            FROM enrollment s SEMI JOIN error_codes e
              ON s.snapshot_date = e.snapshot_date AND s.homeroom = e.homeroom
            GROUP BY ALL) AS g) AS r
WHERE rn = 1""",
    "student_errors": """
SELECT snapshot_date, sch, schname, studentno, error_flag, studentname, grade, homeroom,
       programcode, lepstatus, eld, sncode
FROM (SELECT *, CASE WHEN sch = 4321 THEN NULL
                     WHEN dominant_type IN ('Homeroom', 'Gen Ed', 'Inclusion')
                          AND grade <> mode_grade AND flag IS NULL THEN 'Check Grade'
                     ELSE flag END AS error_flag
      FROM (SELECT s.*, n.schname, d.classtype AS dominant_type, g.mode_grade,
                   CASE WHEN d.classtype = s.classtype THEN NULL
                        WHEN d.classtype = 'Gen Ed' AND s.classtype = 'Inclusion' THEN 'NA'
                        ELSE 'Program or School Error' END AS flag
            FROM enrollment s
            SEMI JOIN error_codes e
              ON s.snapshot_date = e.snapshot_date AND s.homeroom = e.homeroom
            LEFT JOIN school_names n ON s.sch = n.sch
            LEFT JOIN dominant d
              ON s.snapshot_date = d.snapshot_date AND s.homeroom = d.homeroom
            LEFT JOIN mode_grade g
              ON s.snapshot_date = g.snapshot_date AND s.homeroom = g.homeroom) AS a) AS b
WHERE error_flag IN ('Program or School Error', 'Check Grade')""",
    # -- reports ------------------------------------------------------------
    "student_list": """
SELECT s.snapshot_date, s.sch, n.schname, s.homeroom, s.studentno, s.studentname, s.grade,
       s.programcode, s.lepstatus, s.eld, s.firstlang, s.sncode
FROM enrollment s LEFT JOIN school_names n ON s.sch = n.sch""",
    "report_rows": f"""
SELECT r.* EXCLUDE (seats, capacity), c.tot_capacity, c.tot_capacity - r.totalStudents AS seats,
       strftime(r.snapshot_date, '%Y-%m-%d') AS report_updated
FROM flagged_rooms r
LEFT JOIN capacity c ON r.homeroom IS NOT DISTINCT FROM c.homeroom
     AND {school_year("r.snapshot_date")} = c.sch_year""",
}

_DISTRICT = f"SELECT report_updated, {_DISTRICT_COLUMNS} FROM report_rows"

QUERIES = {
    "q_snapshot": """SELECT snapshot_date, studentno, studentname, sch, grade, gradenum, homeroom,
        projection_group, lepstatus, mostrecenteld, sncode, firstlang, dob FROM snapshot""",
    "q_school_year": f"""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day,
        {school_year("o_orderdate")} AS sch_year FROM orders""",
    "q_capacity_crosswalk": "SELECT * FROM capacity WHERE sch_year = 'SY2526'",
    "q_split_schools": """SELECT final_year, sch, new_schname, new_sch FROM merge_listing
        WHERE final_year IS NULL
          AND (sch IS NULL OR (sch <> 4171 AND sch <> 4650 AND sch <> 4391))""",
    "q_program_map": """
        SELECT classtype, projection_group AS limit_key
        FROM (SELECT *, row_number() OVER (PARTITION BY classtype ORDER BY row_id) AS rn
              FROM code_listing
              WHERE projection_group <> 'AIM'
                AND NOT (classtype = 'Inclusion' AND projection_group <> 'SI4')) AS t
        WHERE rn = 1""",
    "q_limits": STEPS["limits"]
    .replace("FROM class_limits l", "FROM limit_listing l")
    .replace("FROM program_codes", "FROM code_listing"),
    "q_grade_parse": """SELECT snapshot_date, studentno, gradenum, grade AS grade_label,
        CASE WHEN contains(grade, 'K') THEN CAST(right(grade, 1) AS INTEGER) - 2
             ELSE CAST(grade AS INTEGER) END AS grade_number
        FROM student_snapshots""",
    "q_missing_program": """SELECT snapshot_date, count(*) AS students,
        count(*) FILTER (WHERE projection_group IS NULL OR projection_group = '')
            AS students_without_program
        FROM snapshot GROUP BY snapshot_date""",
    "q_enrollment": """SELECT snapshot_date, studentno, sch, campus, homeroom, grade, gradenum,
        programcode, projection_group, classtype, prgmtype, eld, sncode, lepstatus, firstlang,
        sch_year, dobDaySpan, dobMonthSpan FROM enrollment""",
    "q_dob_span": f"SELECT DISTINCT {_ROOM}, dobDaySpan, dobMonthSpan FROM spanned",
    "q_prgmtype_counts": "SELECT * FROM program_counts",
    "q_cells": "SELECT * FROM cells",
    "q_classtype_max": "SELECT * FROM classtype_max",
    "q_sei_max": "SELECT * FROM sei_max",
    "q_eld_counts": f"SELECT DISTINCT {_ROOM}, eld1, eld2, eld3, eld4, eld5 FROM identified",
    "q_room_counts": f"""SELECT DISTINCT {_ROOM}, total AS totalStudents, sn AS snCount,
        other AS otherIEP, total - sn AS noIEP FROM counted""",
    "q_grade_range": f"""SELECT DISTINCT {_ROOM}, lowest AS minGradenum, highest AS maxGradenum,
        minGrade, maxGrade, gradeRange AS grade FROM graded""",
    "q_classify": f"""SELECT DISTINCT {_ROOM}, gened, inclusion, subsep, sei, leading_type,
        hrClasstype FROM identified""",
    "q_room_base": "SELECT * FROM room_base",
    "q_ratio_caps": f"""SELECT {_ROOM}, dobDaySpan, hrClasstype, room_limit, limit_with_para,
        inclusion_limit, genedCap, spedCap FROM ratio_caps""",
    "q_limits_applied": f"""SELECT {_ROOM}, dobDaySpan, hrClasstype, totalStudents, util, seats,
        overage, capacity FROM limits_applied""",
    "q_sped_share": f"""SELECT {_ROOM}, dobDaySpan, hrClasstype, snCount, snPct, btu_limit, btu_max
        FROM sped_share""",
    "q_room_filter": f"SELECT {_ROOM}, dobDaySpan, hrClasstype, prgm, totalStudents FROM real_rooms",
    "q_flags": f"""SELECT {_ROOM}, dobDaySpan, hrClasstype, issueFlag, homeroom_flag, groups
        FROM flagged_rooms""",
    "q_error_rooms": f"""SELECT {_ROOM}, dobDaySpan, hrClasstype, grade, homeroom_flag, error
        FROM error_rooms""",
    "q_dominant_types": """SELECT snapshot_date, homeroom, classtype, count(*) AS copies
        FROM dominant GROUP BY ALL""",
    "q_mode_grade": "SELECT * FROM mode_grade",
    "q_student_errors": "SELECT * FROM student_errors",
    "q_all_students": "SELECT * FROM student_list",
    "q_capacity_sheet": """SELECT snapshot_date, sch, schname, grade, minGradenum, maxGradenum,
        hrClasstype, homeroom, capacity, totalStudents, seats, gened, inclusion, subsep, sei,
        bilingual, eld1, eld2, eld3, eld4, genedCap, spedCap, snCount, snPct, dobDaySpan,
        dobMonthSpan FROM flagged_rooms""",
    "q_district_report": _DISTRICT,
    "q_school_report": f"""
        SELECT report_updated, {_SCHOOL_COLUMNS}
        FROM (SELECT * REPLACE (CASE WHEN grade = 'K0 to K1' THEN 'Homeroom' ELSE hrClasstype END
                                AS hrClasstype) FROM report_rows) AS r
        WHERE sch <> 1290""",
    "q_school_directory": """SELECT f.folder_id, f.name, substr(f.name, 33, 38) AS new_schname,
        n.sch, n.schname FROM folder_listing f
        LEFT JOIN school_names n ON substr(f.name, 33, 38) = n.new_schname""",
    "q_class_types": "SELECT DISTINCT snapshot_date, classtype FROM enrollment",
    "q_school_list": "SELECT DISTINCT snapshot_date, sch FROM enrollment WHERE sch <> 1290",
    "q_manifest": """
        SELECT s.snapshot_date, s.sch, s.students, coalesce(r.rooms, 0) AS rooms,
               coalesce(e.errors, 0) AS errors,
               'schools/room_report/snapshot_date=' || s.snapshot_date || '/school=' || s.sch
                   AS location
        FROM (SELECT snapshot_date, sch, count(*) AS students FROM student_list
              WHERE sch <> 1290 GROUP BY ALL) AS s
        LEFT JOIN (SELECT snapshot_date, sch, count(*) AS rooms FROM report_rows GROUP BY ALL) AS r
          ON s.snapshot_date = r.snapshot_date AND s.sch = r.sch
        LEFT JOIN (SELECT snapshot_date, sch, count(*) AS errors FROM student_errors
                   GROUP BY ALL) AS e
          ON s.snapshot_date = e.snapshot_date AND s.sch = e.sch""",
    "q_history_report": _DISTRICT,
    "q_history_errors": "SELECT * FROM student_errors",
    "q_csv_program_codes": """SELECT programcode, projection_group, prgm, classtype, prgmtype
        FROM code_listing""",
    "q_csv_class_limits": """SELECT projection_group, grade, sizelimit_no_para, sizelimit_with_para,
        program2_capacity FROM limit_listing""",
    "q_csv_inclusion_ratios": "SELECT sch, schname, gradenum, inc, gen FROM ratio_listing",
    "q_history_day_report": f"{_DISTRICT} WHERE report_updated = '{SNAPSHOT_DAY}'",
    "q_published_school_students": "SELECT *, sch AS school FROM student_list WHERE sch <> 1290",
    "q_published_school_errors": "SELECT *, sch AS school FROM student_errors WHERE sch <> 1290",
    "q_report_positions": f"""SELECT row_number() OVER (ORDER BY {", ".join(
        f"{c} NULLS LAST" for c in (
            "snapshot_date", "sch", "schname", "groups", "minGradenum", "homeroom", "grade", "hrClasstype",
            "homeroom_flag", "issueFlag", "tot_capacity", "totalStudents", "seats", "noIEP", "inclusion", "subsep",
            "otherIEP", "snCount", "btu_max", "btu_limit", "snPct", "dobMonthSpan", "eld1", "eld2", "eld3", "eld4"))
        }) AS position, snapshot_date, sch, groups, minGradenum, homeroom, totalStudents FROM report_rows""",
}
QUERIES |= {
    "q_csv_program_map": QUERIES["q_program_map"],
    "q_history_snapshot": f"{QUERIES['q_snapshot']} WHERE snapshot_date = DATE '{SNAPSHOT_DAY}'",
    "q_published_students": QUERIES["q_all_students"],
    "q_published_errors": QUERIES["q_student_errors"],
    "q_published_report": QUERIES["q_district_report"],
    "q_published_csv": QUERIES["q_district_report"],
    "q_published_capacity": QUERIES["q_capacity_sheet"],
    "q_published_school_report": QUERIES["q_school_report"],
    "q_published_manifest": f"""
        SELECT m.*, destination, folders,
               m.sch || ' - ' || {school_year("m.snapshot_date")} || ' Homeroom Report' AS report_name
        FROM ({QUERIES["q_manifest"]}) AS m
        LEFT JOIN (SELECT n.sch, min(f.folder_id) AS destination, count(*) AS folders
                   FROM folder_listing f JOIN school_names n ON substr(f.name, 33, 38) = n.new_schname
                   GROUP BY n.sch) AS d ON m.sch = d.sch""",
}


def _statement(name: str) -> str:
    days = HISTORY_DAYS if name.startswith("q_history") else (SNAPSHOT_DAY,)
    known = {"student_snapshots": student_snapshots(days), **TABLES, **STEPS}
    wanted: list[str] = []

    def need(sql: str) -> None:
        for step in known:
            if step not in wanted and re.search(rf"\b(FROM|JOIN)\s+{step}\b", sql):
                need(known[step])
                if step not in wanted:
                    wanted.append(step)

    need(QUERIES[name])
    steps = ",\n".join(f"{step} AS ({known[step].strip()})" for step in wanted)
    head = f"WITH {steps}\n" if steps else ""
    return head + QUERIES[name].strip()


def statements() -> dict[str, str]:
    return {name: _statement(name) for name in QUERIES}
