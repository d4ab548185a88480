"""Every registered query against DuckDB on the sample tables."""

import os
import subprocess
import sys

import pytest
from compare import compare, database

import __spark_entry__ as entry_points
from chronaudit import bindings

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
QUERIES = bindings.queries()
ORACLES = bindings.oracles()


@pytest.fixture(scope="module")
def db():
    return database(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_points_have_them_all():
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(ORACLES) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("hidden", ["zstandard", "tokenizers", "chronaudit.llm", "corpus_pipeline"])
def test_other_queries_work_without_the_corpus_side(hidden):
    """A library or package that is not there takes only the corpus queries with it."""
    code = (
        f"import sys; sys.modules[{hidden!r}] = None\n"
        "import __spark_entry__ as e, chronaudit.bindings as b\n"
        "assert set(b.queries()) <= set(e.queries()) and set(b.oracles()) <= set(e.oracle_sql())\n"
        f"assert {hidden!r} == 'tokenizers' or set(b.queries()) == set(e.queries())\n"
    )
    root = os.path.dirname(os.path.abspath(entry_points.__file__))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches(spark, db, name):
    assert compare(QUERIES[name](spark, FOLDER), db, ORACLES[name]) == []


def test_entry(spark):
    result = entry_points.entry(spark)
    assert result.columns == ["table_name", "group_value", "rdate", "missing_data"]
    assert result.count() > 0
