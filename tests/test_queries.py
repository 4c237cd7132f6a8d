"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import pytest

import __spark_entry__ as entry
from attesta import plans
from tests.oracle import DATA, rows_of, rows_of_sql

plans.load()


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_matches_sql(spark, name):
    assert rows_of(entry.queries()[name](spark, DATA)) == rows_of_sql(plans.ORACLES[name])


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_queries_without_sql_run(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0


def test_library_does_not_need_the_optional_subpackage():
    from pathlib import Path

    for f in (Path(entry.__file__).parent / "attesta").rglob("*.py"):
        assert "llm" in f.parts or "attesta.llm" not in f.read_text()
