"""Small hand-written districts."""

from __future__ import annotations

from dataclasses import replace

from roomledger import schemas
from roomledger.sources import Inputs
from roomledger.sources.star import LITERAL_TABLES

STUDENTS = """
    snapshot_date DATE, studentno BIGINT, studentname STRING, sch INT, grade STRING,
    gradenum INT, homeroom STRING, projection_group STRING, lepstatus STRING,
    mostrecenteld STRING, sncode STRING, firstlang STRING, dob STRING
"""
LABELS = {-2: "K0", -1: "K1", 0: "K2", **{n: f"{n:02d}" for n in range(1, 13)}}


def students_of(*groups, start=1):
    """Student dicts from (count, fields) groups; unset fields take plain values."""
    rows = []
    for count, fields in groups:
        for _ in range(count):
            grade = fields.get("gradenum", 3)
            row = {
                "snapshot_date": "2026-05-05",
                "studentno": start + len(rows),
                "studentname": "Somebody",
                "sch": 4006,
                "grade": LABELS.get(grade),
                "gradenum": grade,
                "homeroom": "H1",
                "projection_group": "GE",
                "lepstatus": None,
                "mostrecenteld": None,
                "sncode": None,
                "firstlang": "English",
                "dob": "9/3/2016",
            }
            row.update(fields)
            rows.append(row)
    return rows


def table(spark, rows, schema):
    from datetime import date

    from pyspark.sql import types as T

    fields = T.StructType.fromDDL(schema)

    def cell(row, field):
        value = row.get(field.name) if isinstance(row, dict) else row[fields.names.index(field.name)]
        is_day = isinstance(field.dataType, T.DateType) and isinstance(value, str)
        return date.fromisoformat(value) if is_day else value

    return spark.createDataFrame([[cell(r, f) for f in fields] for r in rows], fields)


def inputs(spark, students, **tables):
    """Inputs around the given students, with the adapter's short lists by default."""
    literal = {name: spark.sql(query) for name, query in LITERAL_TABLES.items()}
    given = Inputs(
        students=table(spark, students, STUDENTS),
        homeroom_crosswalk=table(spark, [], schemas.HOMEROOM_CROSSWALK),
        structure_data=table(spark, [], schemas.STRUCTURE_DATA),
        **literal,
    )
    return replace(given, **tables)
