"""Cell-cut running sums and order statistics against plain computations."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions.ordered import order_statistics, ordinal, quantile, range_cells, running_sum


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    hot = [("hot", int(i), float(v)) for i, v in enumerate(rng.normal(0, 3, 900).round(2))]
    cold = [(f"c{i % 40}", int(i), float(v)) for i, v in enumerate(rng.normal(0, 3, 600).round(2))]
    return hot + cold


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, i long, v double")


def test_running_sum_is_a_plain_running_sum(df, rows):
    out = running_sum(df, ["k"], F.floor(F.col("i") / 50), [F.col("i")], F.col("v"), "s").collect()
    want: dict[str, float] = {}
    expected = {}
    for k, i, v in sorted(rows, key=lambda r: (r[0], r[1])):
        want[k] = want.get(k, 0.0) + v
        expected[k, i] = want[k]
    assert len(out) == len(rows)
    assert all(abs(r.s - expected[r.k, r.i]) < 1e-9 for r in out)


def test_running_sum_descending(df, rows):
    out = running_sum(
        df, ["k"], F.floor(F.col("i") / 50), [F.col("i").desc()], F.lit(1), "n", descending=True
    ).where("k = 'hot'").collect()
    assert {r.i: r.n for r in out} == {i: 900 - i for i in range(900)}


def test_ordinal_with_null_key_and_no_key(spark):
    some = spark.createDataFrame([(None, 3), (None, 1), ("a", 2)], "k string, i long")
    out = ordinal(some, ["k"], F.floor(F.col("i") / 2), [F.col("i")], "n").collect()
    assert {(r.k, r.i): r.n for r in out} == {(None, 1): 1, (None, 3): 2, ("a", 2): 1}
    out = ordinal(some, [], F.floor(F.col("i") / 2), [F.col("i")], "n").collect()
    assert {r.i: r.n for r in out} == {1: 1, 2: 2, 3: 3}


@pytest.mark.parametrize("step", [0.05, 1.0, 100.0])
def test_order_statistics_do_not_depend_on_the_cell_width(df, rows, step):
    at = {
        "low": lambda n: F.least(n - 1, F.floor(F.lit(0.05) * n)),
        "high": lambda n: F.least(n - 1, F.floor(F.lit(0.95) * n)),
    }
    out = {r.k: r for r in order_statistics(df, ["k"], F.col("v"), at, step).collect()}
    groups: dict[str, list[float]] = {}
    for k, _, v in rows:
        groups.setdefault(k, []).append(v)
    assert set(out) == set(groups)
    for k, values in groups.items():
        values.sort()
        n = len(values)
        assert out[k].n == n
        assert out[k].low == values[min(n - 1, int(0.05 * n))]
        assert out[k].high == values[min(n - 1, int(0.95 * n))]


def test_quantile_interpolates(df, rows):
    out = {r.k: r.m for r in quantile(df, ["k"], F.col("v"), 0.5, "m", 0.5).collect()}
    hot = [v for k, _, v in rows if k == "hot"]
    assert out["hot"] == pytest.approx(float(np.median(hot)))


def test_quantile_ignores_nulls(spark):
    some = spark.createDataFrame([("a", None), ("a", 2.0), ("b", None)], "k string, v double")
    out = quantile(some, ["k"], F.col("v"), 0.5, "m", 1.0).collect()
    assert [(r.k, r.m) for r in out] == [("a", 2.0)]


def test_cells_from_the_data_number_a_hot_key(spark):
    rows = [("hot", None if i % 3 else i // 50, i) for i in range(900)] + [(f"c{i % 7}", i, i) for i in range(90)]
    df = spark.createDataFrame(rows, "k string, day int, i long").repartition(5)
    order = [F.col("day").asc_nulls_last(), F.col("i")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged = range_cells(df, [F.col("k"), *order], "cell", "cells")
        cells = ranged.where("k = 'hot'").select("cell").distinct().count()
        out = ordinal(ranged, ["k"], F.col("cell"), order, "n").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert cells > 2
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is None, r[1] or 0, r[2]))
        assert [r.i for r in sorted((x for x in out if x.k == key), key=lambda r: r.n)] == [r[2] for r in own]
