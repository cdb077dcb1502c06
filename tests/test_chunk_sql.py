"""The splitter's SQL against the splitter, on texts made to meet every separator."""

from __future__ import annotations

import random

import duckdb
import pytest

from tidewater.operators.corpus import split_text
from tidewater.plans.chunk_sql import chunks_sql


@pytest.mark.parametrize("size, overlap", [(20, 4), (7, 0), (50, 10), (512, 102), (3, 1)])
def test_sql_splits_as_the_operator_does(size, overlap):
    rng = random.Random(size)
    pieces = ["a", "bc", "defgh", " ", " ", "\n", "\n\n", "é", "x" * 29, "\t"]
    bodies = [(i, i % 2, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 80)))) for i in range(200)]
    con = duckdb.connect()
    con.execute("CREATE TABLE bodies (key BIGINT, part INT, body VARCHAR)")
    con.executemany("INSERT INTO bodies VALUES (?, ?, ?)", bodies)
    got = {}
    for key, part, pos, text in con.sql(f"SELECT key, part, pos, text FROM {chunks_sql('bodies', size, overlap)} ORDER BY key, start").fetchall():
        got.setdefault((key, part), []).append((pos, text))
    for key, part, body in bodies:
        assert got.get((key, part), []) == split_text(body, size, overlap)
