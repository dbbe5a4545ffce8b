"""Fixed schemas of the inputs; nothing is inferred from the data."""

from __future__ import annotations

STUDENT_SNAPSHOTS = """
    snapshot_date DATE, studentno BIGINT, studentname STRING, gender STRING, race STRING,
    sch INT, grade STRING, gradenum INT, homeroom STRING, projection_group STRING,
    lepstatus STRING, mostrecenteld STRING, sncode STRING, firstlang STRING,
    isDnr STRING, isDnrExc STRING, dob STRING, sch_year STRING
"""
STRUCTURE_DATA = """
    sch_year STRING, classyearno INT, program1 STRING, program2 STRING, cap_1 INT, cap_2 INT
"""
HOMEROOM_CROSSWALK = """
    sch_year STRING, classyearno INT, homeroom STRING, type STRING, tot_capacity INT
"""
SPLIT_SCHOOLS = "final_year STRING, sch INT, new_schname STRING, new_sch INT"
SCHOOL_NAMES = "sch INT, schname STRING, new_schname STRING"
PROGRAM_CODES = """
    programcode STRING, projection_group STRING, prgm STRING, classtype STRING, prgmtype STRING
"""
CLASS_LIMITS = """
    projection_group STRING, grade STRING,
    sizelimit_no_para INT, sizelimit_with_para INT, program2_capacity INT
"""
INCLUSION_RATIOS = "sch INT, schname STRING, gradenum INT, inc INT, gen INT"
SCHOOL_DIRECTORY = "folder_id STRING, name STRING"

# Student columns the reports use; the rest of the snapshot is never read.
STUDENT_COLUMNS = (
    "snapshot_date",
    "studentno",
    "studentname",
    "sch",
    "grade",
    "gradenum",
    "homeroom",
    "projection_group",
    "lepstatus",
    "mostrecenteld",
    "sncode",
    "firstlang",
    "dob",
)
