"""Every registered query of the reports against its SQL statement, on whole tables."""

import pytest

import __spark_entry__ as contract
import registry
from oracle import statements
from tests.conftest import assert_same_as_sql

SF_DIR = "/root/testdata/sf0.001"
STATEMENTS = statements()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, name):
    assert_same_as_sql(registry.QUERIES[name](spark, SF_DIR), SF_DIR, STATEMENTS[name])


def test_every_query_has_a_statement():
    assert set(registry.QUERIES) == set(STATEMENTS)
    assert set(registry.QUERIES) <= set(contract.queries())


def test_entry_is_the_district_report(spark):
    report = contract.entry(spark)
    assert report.columns[:3] == ["report_updated", "School Code", "School Name"]
    assert len(report.columns) == 24
    assert report.count() > 0
