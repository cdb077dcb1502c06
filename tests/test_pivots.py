from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import pivots, similarity

SMALL = pivots.Sizes(cell_rows=50, most_rings=4, block_rows=40, first=2)


def clustered(spark, n, seed=1, width=16, spread=0.05, clusters=40):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width))
    owner = rng.integers(0, clusters, n)
    vectors = centres[owner] + rng.normal(scale=spread, size=(n, width))
    rows = [(i, int(owner[i]) * 3 + i % 3, i % 2, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "image_id long, individual_id long, half int, embedding array<float>")


def asked(gallery, hide):
    return gallery.select(F.col("image_id").alias("query_id"), "embedding", "half", F.col(hide).alias("hide_id"))


def rows(found):
    return sorted(tuple(r[c] for c in ("query_id", "image_id", "individual_id", "score", "rank")) for r in found.collect())


@pytest.mark.parametrize(
    "by, hide, scope, spread",
    [("image", "image", None, 0.05), ("individual", "image", None, 0.3), ("individual", "individual", ["half"], 0.05), ("image", None, ["half"], 3.0)],
)
def test_same_rows_as_all_pairs(spark, by, hide, scope, spread):
    gallery = clustered(spark, 400, spread=spread)
    queries = asked(gallery, f"{hide or 'image'}_id").where("query_id % 3 = 0")
    given = dict(by=by, hide=hide, scope=scope)
    want = similarity.nearest(queries, gallery, 7, **given)
    assert rows(pivots.search(queries, gallery, 7, sizes=SMALL, **given).found) == rows(want)
    assert rows(similarity.nearest(queries, gallery, 7, direct_rows=100, **given)) == rows(want)


def test_zero_null_and_equal_vectors(spark):
    same = [1.0, 2.0, 3.0]
    data = [(i, i % 4, same) for i in range(120)] + [(200, 1, [0.0, 0.0, 0.0]), (201, 1, None), (202, 2, [-1.0, -2.0, -3.0]), (203, 2, [3.0, 0.0, -1.0])]
    gallery = spark.createDataFrame(data, "image_id long, individual_id long, embedding array<float>").withColumn("half", F.lit(0))
    queries = asked(gallery, "image_id")
    for top in (3, 130):
        found = pivots.search(queries, gallery, top, hide="image", sizes=SMALL).found
        assert rows(found) == rows(similarity.nearest(queries, gallery, top, hide="image"))
    assert rows(pivots.search(queries, gallery.limit(0), 3, sizes=SMALL).found) == []
    assert rows(pivots.search(queries.limit(0), gallery, 3, sizes=SMALL).found) == []


def test_scored_pairs_grow_far_less_than_all_pairs(spark):
    sizes = pivots.Sizes(cell_rows=10, block_rows=5000)
    pairs = {}
    for n in (400, 4000):
        gallery = clustered(spark, n, clusters=n // 10)
        search = pivots.search(asked(gallery, "image_id"), gallery, 5, hide="image", sizes=sizes)
        pairs[n] = search.asked.agg(F.sum("rows")).first()[0]
    assert pairs[4000] < 0.05 * 4000 * 4000
    assert pairs[4000] < 30 * pairs[400]


def test_queries_around_the_same_pivots_skip_rows_together(spark, monkeypatch):
    gallery = clustered(spark, 3000, clusters=60, spread=0.02)
    flags, join = [], pivots._block_join
    def seen(*args):
        flags.append(args[-1])
        return join(*args)
    monkeypatch.setattr(pivots, "_block_join", seen)
    sizes = pivots.Sizes(cell_rows=50, block_rows=5000)
    found = pivots.search(asked(gallery, "image_id"), gallery, 5, hide="image", sizes=sizes).found
    assert rows(found) == rows(similarity.nearest(asked(gallery, "image_id"), gallery, 5, hide="image"))
    held = gallery.withColumn("query_id", F.col("image_id")).withColumn("bound", F.lit(0.99).cast("double")).toArrow()
    order, needed = flags[0](held)  # of the one search over the bounds, after rows met by ring
    assert len(flags) == 1 and sorted(order.tolist()) == list(range(3000))
    assert needed.shape[0] == -(-3000 // similarity._CHUNK) and needed.mean() < 0.5
