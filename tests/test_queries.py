"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import re
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from compare import compare, connect

FOLDER = entry.SMALL
SQL = entry.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(entry.queries())


def test_other_queries_work_without_the_corpus_operators():
    """A module that one of them needs cannot be imported: all other queries are there."""
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; print(len(e.queries()), sum(q[:2] == 'op' and q[2].isdigit() for q in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(entry.__file__).parent, capture_output=True, text=True, check=True)
    others = [q for q in entry.queries() if q != "pipeline" and not re.match(r"op\d+_", q)]
    assert out.stdout.split() == [str(len(others)), "0"]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    problem, _, _ = compare(spark, con, FOLDER, name, entry.queries()[name], SQL.get(name))
    assert problem == ""
