"""The adapted input tables in SQL, row for row as ``roomledger.sources.star`` defines them."""

from __future__ import annotations

from roomledger.sources.star import GRADES, LITERAL_TABLES, PROGRAMS, SCHOOL_YEARS

SCHOOL_CASE = """CASE {h} % 25 WHEN 0 THEN 3003 WHEN 1 THEN 4321 WHEN 2 THEN 4610 WHEN 3 THEN 1290
    WHEN 4 THEN 5001 WHEN 5 THEN 5002 WHEN 12 THEN 4171 ELSE 4000 + {h} % 25 END"""

PROGRAM_CASE = """CASE h % 12
    WHEN 0 THEN CASE WHEN d < 18 THEN 'GE' ELSE 'BLS' END
    WHEN 1 THEN CASE WHEN d < 15 THEN 'GE' ELSE 'SI3' END
    WHEN 2 THEN CASE WHEN d < 8 THEN 'GE' WHEN d < 15 THEN 'SI4' ELSE 'SA4' END
    WHEN 3 THEN CASE WHEN d < 2 THEN 'GE' ELSE 'SA4' END
    WHEN 4 THEN CASE WHEN d < 10 THEN 'SL4' ELSE 'SF4' END
    WHEN 5 THEN CASE WHEN d < 2 THEN 'GE' WHEN d < 11 THEN 'BLS' ELSE 'BLH' END
    WHEN 6 THEN CASE WHEN d < 1 THEN 'GE' ELSE 'BLS' END
    WHEN 7 THEN CASE WHEN d < 10 THEN 'ML1' ELSE 'ML2' END
    WHEN 8 THEN CASE WHEN d < 16 THEN 'DL' ELSE 'GE' END
    WHEN 9 THEN CASE WHEN d < 19 THEN 'GE' ELSE '' END
    WHEN 10 THEN CASE WHEN d < 12 THEN 'GE' WHEN d < 14 THEN 'AIM' ELSE 'SL4' END
    ELSE CASE WHEN d < 4 THEN 'GE' END END"""


def grade_label(n: str) -> str:
    """SQL for the label of a grade number."""
    return (
        f"CASE WHEN {n} < 1 THEN 'K' || CAST({n} + 2 AS VARCHAR) "
        f"WHEN {n} < 10 THEN '0' || CAST({n} AS VARCHAR) ELSE CAST({n} AS VARCHAR) END"
    )


def school_year(d: str) -> str:
    """SQL for the school-year label of a day: July opens the year."""
    start = f"(year({d}) - CASE WHEN month({d}) <= 6 THEN 1 ELSE 0 END)"
    return (
        f"'SY' || lpad(CAST({start} % 100 AS VARCHAR), 2, '0') "
        f"|| lpad(CAST(({start} + 1) % 100 AS VARCHAR), 2, '0')"
    )


def student_snapshots(days: tuple[str, ...]) -> str:
    listed = ", ".join(f"(DATE '{day}', {i})" for i, day in enumerate(days))
    return f"""
SELECT day AS snapshot_date, k AS studentno, 'Student#' || k AS studentname,
       CASE WHEN k % 1013 <> 7 THEN CAST({SCHOOL_CASE.format(h="h")} AS INTEGER) END AS sch,
       {grade_label("gradenum")} AS grade, gradenum,
       CASE WHEN k % 101 = 5 THEN NULL WHEN k % 97 = 1 THEN '' WHEN h % 89 = 2 THEN '000' || h
            WHEN h % 40 = 15 THEN 'H' || (h - 1) ELSE 'H' || h END AS homeroom,
       {PROGRAM_CASE} AS projection_group,
       CASE k % 6 WHEN 0 THEN 'L' WHEN 1 THEN 'F' END AS lepstatus,
       CASE WHEN k % 3 = 0 THEN CAST(k % 5 + 1 AS VARCHAR) WHEN k % 5 = 0 THEN '' END
           AS mostrecenteld,
       CASE WHEN k % 4 = 0 THEN 'S' || (k % 3 + 1) WHEN k % 7 = 0 THEN '' END AS sncode,
       CASE k % 4 WHEN 0 THEN 'Spanish' WHEN 1 THEN 'Haitian Creole' ELSE 'English' END
           AS firstlang,
       CASE WHEN k % 500 <> 3
            THEN CASE WHEN k % 11 = 0 THEN strftime(born, '%m/%d/%Y')
                      ELSE strftime(born, '%-m/%-d/%Y') END
                 || CASE WHEN k % 13 = 0 THEN ' 00:00:00' ELSE '' END
            ELSE '' END AS dob
FROM (SELECT *, CAST(CASE WHEN k % 700 = 11 THEN NULL
                     ELSE h % 10 - 2 + CASE WHEN h % 3 = 0 AND d % 2 = 0 THEN 1 ELSE 0 END
                     END AS INTEGER) AS gradenum
      FROM (SELECT o_orderkey AS k, day, (o_orderkey + i) % 20 AS d,
                   CASE WHEN o_custkey % 50 BETWEEN 20 AND 24
                        THEN o_custkey - o_custkey % 50 + 20 ELSE o_custkey END AS h,
                   CAST(o_orderdate AS DATE) AS born
            FROM orders CROSS JOIN (VALUES {listed}) AS days(day, i)) AS keyed) AS graded
"""


_YEARS = ", ".join(f"('{y}')" for y in SCHOOL_YEARS)
_GRADES = "[" + ", ".join(f"'{g}'" for g in (*GRADES, "100")) + "]"

TABLES = {
    **LITERAL_TABLES,
    "homeroom_crosswalk": f"""
SELECT sch_year, CAST(c_custkey + 1000000 * entry AS INTEGER) AS classyearno,
       'H' || c_custkey AS homeroom,
       CASE WHEN c_custkey % 2 = 0 THEN 'HR' ELSE 'SUB' END AS type,
       CAST(18 + (c_custkey + entry) % 8 AS INTEGER) AS tot_capacity
FROM customer CROSS JOIN (VALUES {_YEARS}) AS y(sch_year)
CROSS JOIN (VALUES (0), (1)) AS e(entry)
WHERE entry = 0 OR c_custkey % 10 = 3
""",
    "structure_data": f"""
SELECT sch_year, CAST(c_custkey AS INTEGER) AS classyearno, 'P' || (c_custkey % 9) AS program1,
       CASE WHEN c_custkey % 3 = 0 THEN 'Q' || (c_custkey % 4) END AS program2,
       CAST(10 + c_custkey % 6 AS INTEGER) AS cap_1,
       CAST(CASE WHEN c_custkey % 3 = 0 THEN 5 + c_custkey % 4 END AS INTEGER) AS cap_2
FROM customer CROSS JOIN (VALUES {_YEARS}) AS y(sch_year)
WHERE c_custkey % 4 <> 0
""",
    "code_listing": f"""
SELECT p_partkey AS row_id, c.programcode || '-' || p_partkey AS programcode,
       CASE WHEN p_partkey % 31 <> 4 THEN c.projection_group END AS projection_group,
       CASE WHEN p_partkey % {len(PROGRAMS)} <> 9 THEN c.prgm END AS prgm,
       CASE WHEN p_partkey % 29 = 1 THEN NULL
            WHEN p_partkey % 5 = 0 THEN c.classtype || ' ' || p_brand
            ELSE c.classtype END AS classtype, c.prgmtype
FROM part JOIN program_codes c ON p_partkey % {len(PROGRAMS)} = c.row_id
""",
    "limit_listing": f"""
SELECT CASE WHEN p_partkey % 17 = 3 THEN 'ZZ9'
            WHEN p_partkey % 37 <> 5 THEN c.projection_group END AS projection_group,
       CASE WHEN p_partkey % 41 <> 6
            THEN ({_GRADES})[CAST((p_partkey // {len(PROGRAMS)}) % {len(GRADES) + 1} + 1
                 AS INTEGER)] END AS grade,
       p_size AS sizelimit_no_para,
       CASE WHEN p_partkey % 5 <> 4 THEN p_size + 3 END AS sizelimit_with_para,
       CAST(p_partkey % 6 AS INTEGER) AS program2_capacity
FROM part JOIN program_codes c ON p_partkey % {len(PROGRAMS)} = c.row_id
""",
    "ratio_listing": """
SELECT CAST(CASE WHEN c_custkey % 43 <> 7 THEN 4000 + c_custkey % 25 END AS INTEGER) AS sch,
       CASE WHEN c_custkey % 19 = 4 THEN '' ELSE 'School, ' || c_custkey END AS schname,
       CAST(CASE WHEN c_custkey % 13 <> 5 THEN c_custkey % 11 - 2 END AS INTEGER) AS gradenum,
       CAST(CASE WHEN c_custkey % 17 <> 6 THEN 4 + c_custkey % 9 END AS INTEGER) AS inc,
       CAST(12 + c_custkey % 5 AS INTEGER) AS gen
FROM customer
""",
    "merge_listing": """
SELECT CASE WHEN c_custkey % 3 <> 0 THEN 'SY' || (1000 + c_custkey % 90) END AS final_year,
       CAST(CASE WHEN c_custkey % 71 = 6 THEN NULL
            ELSE CASE c_custkey % 25 WHEN 7 THEN 4171 WHEN 8 THEN 4650 WHEN 9 THEN 4391
                 ELSE 4000 + c_custkey % 25 END END AS INTEGER) AS sch,
       'Campus ' || (c_custkey % 10) AS new_schname,
       CAST(5000 + c_custkey % 10 AS INTEGER) AS new_sch
FROM customer
""",
    "folder_listing": """
SELECT 'folder-' || c_custkey AS folder_id,
       rpad('District report folder ', 32, '.') || 'Campus ' || (c_custkey % 40) AS name
FROM customer
""",
}
