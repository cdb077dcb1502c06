from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import negatives

ROWS = "id long, label int, vector array<long>"


def plain(rows, is_anchor, k=5, most=10, low=30, high=90):
    """All products of all rows, sorted."""
    best = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and None not in v:
            best[i] = min(best.get(i, (label, v)), (label, v))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (label, v) in best.items():
        if not is_anchor(a):
            continue
        others = sorted((-dot(v, w), i, own) for i, (own, w) in best.items() if i != a)
        for s, p, _ in [x for x in others if x[2] == label][:k]:
            fits = [(i, -n) for n, i, own in others if own != label and low * -s <= 100 * -n <= high * -s]
            out += [(a, p, rank, i, -s, n) for rank, (i, n) in enumerate(fits[:most], 1)]
    return sorted(out)


def run(spark, rows, **sizes):
    frame = spark.createDataFrame(rows, ROWS)
    out = negatives.mined(frame, F.col("id") % 10 == 0, **sizes)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("width, spread, labels, seed", [(16, 60, 4, 1), (3, 3, 2, 2), (1, 2, 3, 3), (24, 200, 60, 4)])
def test_random_vectors_match_all_products(spark, width, spread, labels, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(labels), [rng.randint(-spread, spread) for _ in range(width)]) for i in range(240)]
    rows += [(i + 1000, label, v) for i, label, v in rows[:40]]  # equal vectors: ties
    rng.shuffle(rows)
    want = plain(rows, lambda i: i % 10 == 0)
    assert run(spark, rows) == want
    assert run(spark, rows, anchor_rows=7, block_rows=50) == want


def test_one_label_for_a_third_and_odd_rows(spark):
    rng = random.Random(7)
    vector = lambda: [rng.randint(-9, 9) for _ in range(6)]
    rows = [(i, 0 if i < 60 else rng.randrange(1, 40), vector()) for i in range(180)]
    rows += [(10, 3, vector()), (10, 0, vector()), (None, 1, vector()), (500, None, vector()), (510, 2, None), (520, 2, [1, None, 2]),
             (530, 1, []), (540, 1, [0] * 6), (550, 1, [4, 5]), (560, 99, vector()), rows[20], rows[20]]
    want = plain([(i, label, v and None not in v and v + [0] * (6 - len(v)) or (v if v is None or None in v else [0] * 6)) for i, label, v in rows], lambda i: i % 10 == 0)
    assert run(spark, rows) == want and {a for a, *_ in want} >= {20}
    assert run(spark, []) == [] and run(spark, [(10, 1, [1, 2])]) == []


def test_large_numbers_stay_exact(spark):
    rng = random.Random(9)
    rows = [(i, i % 2, [rng.randint(1, 1 << 29) * 2 + 1 for _ in range(4)]) for i in range(60)]
    assert run(spark, rows) == plain(rows, lambda i: i % 10 == 0)


def test_infinite_and_null_components_take_no_part(spark):
    rows = [(1, [1.0, 0.5]), (2, [float("nan"), 0.0]), (3, [float("inf"), 0.0]), (4, [None, 0.0]), (5, None), (6, [-0.001, 0.999])]
    frame = spark.createDataFrame(rows, "id long, v array<float>")
    out = frame.where(negatives.usable(F.col("v"))).select("id", negatives.scaled(F.col("v")).alias("v")).orderBy("id").collect()
    assert [tuple(r) for r in out] == [(1, [256, 128]), (6, [-1, 255])]


def test_walk_stops_before_all_rows_where_values_concentrate():
    rng = np.random.default_rng(3)
    rows = rng.normal(0, 40, (8000, 4)).round()
    lists = negatives.Lists(rows)
    anchor = np.array([90.0, -70, 50, 20])
    (best,), scores, scored = lists.best(anchor, np.ones(8000, dtype=bool), [(None, None)], 5)
    order = np.lexsort((np.arange(8000), -(rows @ anchor)))
    assert (best == order[:5]).all() and scored < 2500
