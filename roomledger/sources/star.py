"""Input tables shaped out of a plain orders/customer/part star schema.

One order is one student, one customer (or block of customers) one room.  All
rules are integer arithmetic on keys, so any engine gives the same rows.  The
big tables grow with the star schema; the district's own short lists (program
codes, limits, ratios, names) are literal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomledger.sources.inputs import Inputs

SNAPSHOT_DAY = "2026-05-05"
HISTORY_DAYS = ("2025-05-05", "2026-05-05", "2026-09-15")
SCHOOL_YEARS = ("SY2425", "SY2526", "SY2627")

# Invented program codes (code and group are the same), in file order.
PROGRAMS = (
    ("GE", "Reg Ed", "Gen Ed", "Gen Ed"),
    ("SI4", "SPED", "Inclusion", "Inclusion"),
    ("SI2", "SPED", "Inclusion", "Inclusion"),
    ("SA4", "SPED", "Autism", "Sub-Sep"),
    ("SL4", "SPED", "Specific Learning Disability", "Sub-Sep"),
    ("SF4", "SPED", "Emotional Impairment", "Sub-Sep"),
    ("BLS", "ELL", "Spanish SEI", "SEI"),
    ("BLH", "ELL", "Haitian SEI", "SEI"),
    ("ML1", "ELL", "Spanish SLIFE", "Bilingual"),
    ("ML2", "ELL", "Multilingual SLIFE", "Bilingual"),
    ("DL", "ELL", "Dual-Language", "Bilingual"),
    ("AIM", "SPED", "AIM", "Sub-Sep"),
)
GRADES = ("K0", "K1", "K2", "1", "2", "3", "4", "5", "6", "7", "8")
GRADE_LABELS = (*GRADES[:3], *(g.zfill(2) for g in GRADES[3:]))

# Room kinds: each program with the position (out of 20) its share ends before.
PROGRAM_MIX = (
    (("GE", 18), ("BLS", 20)),
    (("GE", 15), ("SI3", 20)),
    (("GE", 8), ("SI4", 15), ("SA4", 20)),
    (("GE", 2), ("SA4", 20)),
    (("SL4", 10), ("SF4", 20)),
    (("GE", 2), ("BLS", 11), ("BLH", 20)),
    (("GE", 1), ("BLS", 20)),
    (("ML1", 10), ("ML2", 20)),
    (("DL", 16), ("GE", 20)),
    (("GE", 19), ("", 20)),
    (("GE", 12), ("AIM", 14), ("SL4", 20)),
    (("GE", 4), (None, 20)),
)
SCHOOLS = (3003, 4321, 4610, 1290, 5001, 5002, *range(4006, 4012), 4171, *range(4013, 4025))
SHARED_ROOM_OFFSETS = (*[0] * 20, 0, 1, 2, 3, 4, *[0] * 25)
LANGUAGES = ("Spanish", "Haitian Creole", "English", "English")
RATIO_SCHOOLS = (4008, 4011, 4014, 4017, 4020, 4023, 5000)
NAMED_SCHOOLS = (1290, 4321, 4610, 5000, 4171, *range(4006, 4012), *range(4013, 4025))
CAMPUS_MERGES = (
    (None, 5001, "Campus 5000", 5000),
    (None, 5002, "Campus 5000", 5000),
    (None, 4171, "Campus 4998", 4998),
    ("SY2324", 4006, "Campus 4999", 4999),
)


def _values(columns: str, rows) -> str:
    def text(cell) -> str:
        if cell is None:
            return "NULL"
        return f"'{cell}'" if isinstance(cell, str) else str(cell)

    lines = ", ".join("(" + ", ".join(map(text, row)) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {lines}) AS t({columns})"


def _limit_rows():
    for g, (group, *_) in enumerate(PROGRAMS):
        for n, grade in enumerate(GRADES):
            if (g + n) % 11 != 5:
                no_para = 8 + g + n % 7
                yield group, grade, no_para, None if n % 5 == 4 else no_para + 3, 2 + g % 5


LITERAL_TABLES = {
    "program_codes": _values(
        "row_id, programcode, projection_group, prgm, classtype, prgmtype",
        [(i, group, group, *rest) for i, (group, *rest) in enumerate(PROGRAMS)],
    ),
    "class_limits": _values(
        "projection_group, grade, sizelimit_no_para, sizelimit_with_para, program2_capacity",
        [*_limit_rows(), ("ZZ9", "K2", 10, 12, 3)],
    ),
    "inclusion_ratios": _values(
        "sch, schname, gradenum, inc, gen",
        [(s, f"School {s}", g, 4 + g, 12 + s % 5) for s in RATIO_SCHOOLS for g in range(4)],
    ),
    "split_schools": _values("final_year, sch, new_schname, new_sch", CAMPUS_MERGES),
    "school_names": _values(
        "sch, schname, new_schname",
        [(s, f"School {s}", f"Campus {i}") for i, s in enumerate(NAMED_SCHOOLS)],
    ),
}


def _array(values) -> str:
    """A SQL array literal."""
    cells = ("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"array({', '.join(cells)})"


def _lookup(key: str, values) -> str:
    """The value at a zero-based position: one read of the key, however long the list."""
    return f"element_at({_array(values)}, CAST({key} AS INT) + 1)"


def _mixed_programs() -> list[str | None]:
    """Program by room kind and position of the student, 20 positions per kind."""
    programs = []
    for mix in PROGRAM_MIX:
        for d in range(20):
            programs.append(next(code for code, below in mix if d < below))
    return programs


def student_snapshots(orders: DataFrame, days: tuple[str, ...] = (SNAPSHOT_DAY,)) -> DataFrame:
    """One row per order and snapshot day; programs shift a little from day to day.

    A customer is a room, except that five customers of every fifty share one
    (``h``); ``d`` is the student's position within the room's mix of programs.
    """
    listed = ", ".join(f"struct(DATE '{day}' AS day, {i} AS i)" for i, day in enumerate(days))
    return (
        orders.selectExpr(
            "o_orderkey AS k",
            f"o_custkey - {_lookup('o_custkey % 50', SHARED_ROOM_OFFSETS)} AS h",
            "CAST(o_orderdate AS DATE) AS born",
            f"inline(array({listed}))",
        )
        .selectExpr("*", "(k + i) % 20 AS d")
        .selectExpr(
            "*",
            "CASE WHEN k % 700 <> 11 THEN CAST(h % 10 - 2 +"
            " CASE WHEN h % 3 = 0 AND d % 2 = 0 THEN 1 ELSE 0 END AS INT) END AS gradenum",
        )
        .selectExpr(
            "day AS snapshot_date",
            "k AS studentno",
            "concat('Student#', k) AS studentname",
            f"CASE WHEN k % 1013 <> 7 THEN {_lookup('h % 25', SCHOOLS)} END AS sch",
            f"CASE WHEN gradenum IS NOT NULL THEN {_lookup('gradenum + 2', GRADE_LABELS)} END"
            " AS grade",
            "gradenum",
            "CASE WHEN k % 101 = 5 THEN NULL WHEN k % 97 = 1 THEN '' WHEN h % 89 = 2"
            " THEN concat('000', h) WHEN h % 40 = 15 THEN concat('H', h - 1)"
            " ELSE concat('H', h) END AS homeroom",
            f"{_lookup('h % 12 * 20 + d', _mixed_programs())} AS projection_group",
            f"{_lookup('k % 6', ('L', 'F', None, None, None, None))} AS lepstatus",
            "CASE WHEN k % 3 = 0 THEN CAST(k % 5 + 1 AS STRING) WHEN k % 5 = 0 THEN '' END"
            " AS mostrecenteld",
            "CASE WHEN k % 4 = 0 THEN concat('S', k % 3 + 1) WHEN k % 7 = 0 THEN '' END AS sncode",
            f"{_lookup('k % 4', LANGUAGES)} AS firstlang",
            "CASE WHEN k % 500 = 3 THEN '' ELSE concat("
            "CASE WHEN k % 11 = 0 AND month(born) < 10 THEN '0' ELSE '' END, month(born), '/', "
            "CASE WHEN k % 11 = 0 AND day(born) < 10 THEN '0' ELSE '' END, day(born), '/', "
            "year(born), CASE WHEN k % 13 = 0 THEN ' 00:00:00' ELSE '' END) END AS dob",
        )
    )


def homeroom_crosswalk(customer: DataFrame) -> DataFrame:
    """Capacity on record per homeroom code and school year; every tenth code has two entries."""
    c = F.col("c_custkey")
    entries = F.when(c % 10 == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    years = F.array(*[F.lit(y) for y in SCHOOL_YEARS])
    return (
        customer.select(c, F.explode(years).alias("sch_year"), entries.alias("entries"))
        .select(c, "sch_year", F.explode("entries").alias("entry"))
        .select(
            "sch_year",
            (c + 1000000 * F.col("entry")).cast("int").alias("classyearno"),
            F.concat(F.lit("H"), c.cast("string")).alias("homeroom"),
            F.when(c % 2 == 0, "HR").otherwise("SUB").alias("type"),
            (18 + (c + F.col("entry")) % 8).cast("int").alias("tot_capacity"),
        )
    )


def structure_data(customer: DataFrame) -> DataFrame:
    c = F.col("c_custkey")
    years = F.array(*[F.lit(y) for y in SCHOOL_YEARS])
    return customer.where(c % 4 != 0).select(
        F.explode(years).alias("sch_year"),
        c.cast("int").alias("classyearno"),
        F.concat(F.lit("P"), (c % 9).cast("string")).alias("program1"),
        F.when(c % 3 == 0, F.concat(F.lit("Q"), (c % 4).cast("string"))).alias("program2"),
        (10 + c % 6).cast("int").alias("cap_1"),
        F.when(c % 3 == 0, (5 + c % 4).cast("int")).alias("cap_2"),
    )


def code_listing(part: DataFrame, codes: DataFrame) -> DataFrame:
    """A long program-code file: one line per part, many lines per class type."""
    p = F.col("p_partkey")
    branded = F.concat(F.col("classtype"), F.lit(" "), F.col("p_brand"))
    return part.join(codes, p % len(PROGRAMS) == F.col("row_id")).select(
        p.alias("row_id"),
        F.concat_ws("-", "programcode", p.cast("string")).alias("programcode"),
        F.when(p % 31 != 4, F.col("projection_group")).alias("projection_group"),
        F.when(p % len(PROGRAMS) != 9, F.col("prgm")).alias("prgm"),
        F.when(p % 29 == 1, None)
        .when(p % 5 == 0, branded)
        .otherwise(F.col("classtype"))
        .alias("classtype"),
        "prgmtype",
    )


def limit_listing(part: DataFrame, codes: DataFrame) -> DataFrame:
    """A long class-limit file: one line per part, some for groups without a program."""
    p = F.col("p_partkey")
    n = F.floor(p / len(PROGRAMS)) % (len(GRADES) + 1)
    grades = F.array(*[F.lit(g) for g in (*GRADES, "100")])
    return part.join(codes, p % len(PROGRAMS) == F.col("row_id")).select(
        p.alias("row_id"),
        F.when(p % 17 == 3, "ZZ9").when(p % 37 != 5, F.col("projection_group"))
        .alias("projection_group"),
        F.when(p % 41 != 6, F.element_at(grades, (n + 1).cast("int"))).alias("grade"),
        F.col("p_size").alias("sizelimit_no_para"),
        F.when(p % 5 != 4, F.col("p_size") + 3).alias("sizelimit_with_para"),
        (p % 6).cast("int").alias("program2_capacity"),
    )


def ratio_listing(customer: DataFrame) -> DataFrame:
    """A long inclusion-ratio file: one line per customer, some without a grade or a count."""
    c = F.col("c_custkey")
    return customer.select(
        c.alias("row_id"),
        F.when(c % 43 != 7, (4000 + c % 25).cast("int")).alias("sch"),
        F.when(c % 19 == 4, "").otherwise(F.concat(F.lit("School, "), c.cast("string"))).alias("schname"),
        F.when(c % 13 != 5, (c % 11 - 2).cast("int")).alias("gradenum"),
        F.when(c % 17 != 6, (4 + c % 9).cast("int")).alias("inc"),
        (12 + c % 5).cast("int").alias("gen"),
    )


def as_typed_by_hand(listing: DataFrame, schema: str, key: str = "row_id") -> DataFrame:
    """A listing as text, in its order, with its numbers in the ways that spreadsheets write them.

    Whole decimals and blanks around numbers take turns, and so do ``NA``, blank and empty cells for missing
    ones.
    """
    way = F.col(key) % 4

    def cell(field: T.StructField):
        text = F.col(field.name).cast("string")
        if isinstance(field.dataType, T.StringType):
            return text.alias(field.name)
        number = F.when(way == 0, F.concat(text, F.lit(".0"))).when(way == 1, F.concat(F.lit(" "), text, F.lit("  ")))
        missing = F.when(way == 2, "").when(way == 3, "  ")
        return F.when(text.isNotNull(), F.coalesce(number, text)).otherwise(missing).alias(field.name)

    return listing.orderBy(key).select(*[cell(f) for f in T.StructType.fromDDL(schema).fields])


def merge_listing(customer: DataFrame) -> DataFrame:
    """A long campus-merge file, most of it no longer in force."""
    c = F.col("c_custkey")
    merged = (*range(4000, 4007), 4171, 4650, 4391, *range(4010, 4025))
    return customer.select(
        F.when(c % 3 != 0, F.concat(F.lit("SY"), (1000 + c % 90).cast("string"))).alias(
            "final_year"
        ),
        F.expr(f"CASE WHEN c_custkey % 71 <> 6 THEN {_lookup('c_custkey % 25', merged)} END").alias(
            "sch"
        ),
        F.concat(F.lit("Campus "), (c % 10).cast("string")).alias("new_schname"),
        (5000 + c % 10).cast("int").alias("new_sch"),
    )


def folder_listing(customer: DataFrame) -> DataFrame:
    """Report folders whose names carry a school name after a 32-character prefix."""
    c = F.col("c_custkey")
    prefix = F.rpad(F.lit("District report folder "), 32, ".")
    return customer.select(
        F.concat(F.lit("folder-"), c.cast("string")).alias("folder_id"),
        F.concat(prefix, F.lit("Campus "), (c % 40).cast("string")).alias("name"),
    )


def star_inputs(
    spark: SparkSession, sf_dir: str, days: tuple[str, ...] = (SNAPSHOT_DAY,)
) -> Inputs:
    """All job inputs from the star-schema tables under ``sf_dir``."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    customer = table("customer")
    # A dozen to a few hundred fixed rows: one partition needs no shuffle to be grouped.
    literal = {name: spark.sql(query).coalesce(1) for name, query in LITERAL_TABLES.items()}
    return Inputs(
        students=student_snapshots(table("orders"), days),
        homeroom_crosswalk=homeroom_crosswalk(customer),
        structure_data=structure_data(customer),
        school_directory=folder_listing(customer),
        **literal,
    )
