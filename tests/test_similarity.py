"""Blocked search against plain search, and its edge cases."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.functions.ordered import keep_top
from tidewater.functions.vectors import cosine
from tidewater.operators import similarity as S
from tidewater.sources.scans import gallery
from tidewater.sources.sinks import write_gallery


@pytest.fixture(scope="module")
def images(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(60, 8)).astype(np.float32)
    vectors[11] = vectors[10]  # equal vectors tie
    rows = [(i, i % 7, v.tolist()) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "image_id long, individual_id long, embedding array<float>")


def as_queries(images):
    return images.select(
        F.col("image_id").alias("query_id"), F.col("image_id").alias("hide_id"), "embedding",
        F.col("individual_id").alias("true_id"),
    )


def ranks(df):
    return sorted((r.query_id, r["rank"], r.image_id, round(r.score, 6)) for r in df.collect())


def nearest_plain(queries, gallery, top):
    """The same result from SQL expressions over all pairs."""
    pairs = queries.join(
        gallery.withColumnRenamed("embedding", "_g"), F.col("hide_id") != F.col("image_id")
    )
    score = F.round(cosine(F.col("embedding"), F.col("_g")), S.SCORE_DIGITS)
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "image_id")
    scored = pairs.select("query_id", "image_id", "individual_id", score.alias("score"))
    return keep_top(scored, ranked, top)


@pytest.mark.parametrize("block_rows", [7, 25, 1000])
def test_blocks_equal_plain(images, block_rows):
    queries = as_queries(images)
    blocked = S.nearest(queries, images, 5, hide="image", block_rows=block_rows)
    assert ranks(blocked) == ranks(nearest_plain(queries, images, 5))


def test_copies_of_a_row_are_bounded(spark):
    one = lambda q, g: tuple(spark.range(1).select(*S._split(F.lit(q), F.lit(g), 1024)).first())
    assert one(600, 600) == (32, 4)
    assert one(5, 600) == (5, 25)
    assert one(1, 600) == (1, 128)
    assert one(6400, 6400) == (100, 4)  # no block holds more than 65,536 queries
    assert one(0, 3)[0] == 0


@pytest.mark.parametrize("by", ["image", "individual"])
def test_a_gallery_in_pieces_equals_the_whole(images, by):
    rows = images.orderBy("image_id").toArrow()
    asked = rows.select(["image_id", "image_id", "embedding"]).rename_columns(["query_id", "hide_id", "embedding"])
    found = []
    for step in (60, 7, 1):
        best = S._Best(asked, 4, by, "image", S.SCORE_DIGITS)
        for at in range(0, 60, step):
            best.add(rows.slice(at, step))
        schema = rows.select(["image_id", "image_id", "individual_id"]).rename_columns(["query_id", "image_id", "individual_id"]).schema
        found.append(best.table(schema.append(pa.field("score", pa.float64()))).to_pylist())
    assert len(found[0]) == 240 and found[0] == found[1] == found[2]


def test_vectors_of_several_widths_are_refused(spark, images):
    rows = [(100, 1, [1.0, 0.0]), (101, 2, [1.0, 0.0, 0.0, 0.0])]
    odd = spark.createDataFrame(rows, "image_id long, individual_id long, embedding array<float>")
    with pytest.raises(Exception, match="several widths"):
        S.nearest(as_queries(images), odd, 3).collect()


def test_by_individual_equals_collapsed_images(images):
    queries = as_queries(images)
    direct = S.nearest(queries, images, 4, by="individual", hide="image", block_rows=13)
    every = S.nearest(queries, images, 1000, hide="image")
    collapsed = S.best_per_individual(every, 4)
    key = lambda df: sorted(
        (r.query_id, r["rank"], r.individual_id, r.image_id, r.score) for r in df.collect()
    )
    assert key(direct) == key(collapsed)


def test_support_is_counted_from_the_gallery(images):
    queries = as_queries(images)
    every = S.best_per_individual(S.nearest(queries, images, 1000, hide="image"), 4)
    ranked = S.nearest(queries, images, 4, by="individual", hide="image")
    owners = queries.select("query_id", F.col("true_id").alias("own_individual"))
    out = S.with_support(ranked, owners, images)
    key = lambda df: sorted((r.query_id, r.individual_id, r.n_images) for r in df.collect())
    assert key(out) == key(every)


def test_scope_keeps_pairs_apart(images):
    scoped = images.withColumn("scope", F.col("individual_id") % 2)
    queries = as_queries(images).withColumn("scope", F.col("true_id") % 2)
    out = S.nearest(queries, scoped, 3, scope=["scope"], hide="image", block_rows=9)
    found = out.join(queries.select("query_id", "true_id"), "query_id").collect()
    assert len(found) == 180
    assert all(r.true_id % 2 == r.individual_id % 2 for r in found)


def test_own_row_is_found_without_hiding(images):
    out = S.nearest(as_queries(images).drop("hide_id"), images, 1).collect()
    assert all(r.score == pytest.approx(1.0) for r in out)
    assert {r.query_id: r.image_id for r in out}[11] == 10  # a tie goes to the smaller id


def test_string_ids(images):
    text = images.select(F.concat(F.lit("c"), "image_id").alias("image_id"), "individual_id", "embedding")
    out = S.nearest(as_queries(images).where("query_id = 4"), text, 2).collect()
    assert out[0].image_id == "c4"


def test_empty_gallery_abstains(images):
    queries = as_queries(images).where("query_id < 3")
    ranked = S.best_per_individual(S.nearest(queries, images.where("image_id < 0"), 50, hide="image"))
    out = S.photo_answers(queries, ranked).collect()
    assert len(out) == 3
    for row in out:
        assert (row.ok, row.abstain, row.margin, row.citations) == (False, True, None, [])


def test_answers_tell_candidates_margin_and_thumbnails(spark):
    ranked = spark.createDataFrame(
        [(1, 9, 0.81, 1, 3, 70), (1, 8, 0.6, 2, 1, 71), (2, 9, 0.3, 1, 1, 70), (3, 7, 0.9, 1, 1, 72)],
        "query_id long, individual_id long, score double, rank long, n_images long, image_id long",
    )
    cards = spark.createDataFrame([(70, "east", "t/70.jpg"), (71, "west", None)], "image_id long, catalog string, thumb_ref string")
    out = {r.query_id: r for r in S.photo_answers(ranked.select("query_id").distinct(), ranked, cards).collect()}
    assert out[1].summary == "Top match individual 9 (score=0.810, margin=0.210)" and out[1].threshold == 0.54
    assert [tuple(c) for c in out[1].citations] == [("catalog_image", "east", "t/70.jpg", "9"), ("catalog_image", "west", None, "8")]
    assert [(c.individual_id, c.n_images, c.image_id) for c in out[1].candidates] == [(9, 3, 70), (8, 1, 71)]
    assert out[2].abstain and out[2].summary == "No confident match (top=0.300 < 0.54) → likely NOVEL"
    assert out[3].summary == "Top match individual 7 (score=0.900, margin=n/a)" and out[3].candidates[0].catalog == "catalog"


def test_margin_is_null_with_one_individual(spark):
    ranked = spark.createDataFrame([(1, 9, 0.7, 1), (2, 9, 0.54, 1), (2, 8, 0.5, 2)],
                                   "query_id long, individual_id long, score double, rank int")
    out = {r.query_id: r for r in S.margin_abstain(ranked).collect()}
    assert out[1].margin is None and out[1].abstain is False
    assert out[2].abstain is False  # strictly below the threshold abstains
    assert out[2].margin == pytest.approx(0.04)


def test_null_vectors_are_skipped(spark, images):
    rows = images.unionByName(
        spark.createDataFrame([(99, 1, None)], "image_id long, individual_id long, embedding array<float>")
    )
    assert S.nearest(as_queries(rows), rows, 1).count() == 60


def test_cosine_separation_equals_all_pairs(images):
    rows = images.collect()
    m = np.array([r.embedding for r in rows], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    cos, lab = m @ m.T, np.array([r.individual_id for r in rows])
    same = (lab[:, None] == lab[None, :]) & ~np.eye(len(lab), dtype=bool)
    out = S.cosine_separation(images).first()
    assert out.same_mean == pytest.approx(cos[same].mean())
    assert out.diff_mean == pytest.approx(cos[lab[:, None] != lab[None, :]].mean())


def test_supcon_of_separated_batch_is_small(spark):
    rows = [(0, 1, [1.0, 0.0]), (0, 1, [1.0, 0.0]), (0, 2, [0.0, 1.0]), (0, 2, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "batch_id long, individual_id long, embedding array<float>")
    assert S.supcon_value(df, 0.1).first().loss == pytest.approx(math.log(1 + 2 * math.exp(-10)), abs=1e-6)


def test_region_prior_never_demotes_observed_or_other_species(spark):
    ranked = spark.createDataFrame(
        [(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query_id long, individual_id long, rank int"
    )
    seen = spark.createDataFrame(
        [(10, "humpback", "CA"), (11, "humpback", "SE-AK"), (12, "gray", "SE-AK")],
        "individual_id long, species string, region string",
    )
    asked = spark.createDataFrame([(1, "CA")], "query_id long, region string")
    links = spark.createDataFrame([("CA", "MX"), ("SE-AK", "HI")], "a string, b string")
    out = {r.individual_id: r for r in S.region_prior(ranked, seen, asked, links, "humpback").collect()}
    assert [out[i].demote for i in (10, 11, 12)] == [False, True, False]
    assert out[10].observed_here and out[10].separable


def test_only_versions_in_use_are_read(spark, images, tmp_path):
    """The settings decide while the job runs; folders of other versions are left out of the scan."""
    path, settings = str(tmp_path / "gallery"), str(tmp_path / "settings")
    for version, width in (("old", 2), ("new", 3)):
        rows = images.withColumns({"embedding": F.slice("embedding", 1, width), "embedder_ver": F.lit(version)})
        write_gallery(rows, path)
    spark.createDataFrame([("old", "retired"), ("new", "active")], "embedder_ver string, state string").write.parquet(settings)
    held = gallery(spark, path, spark.read.parquet(settings).where("state = 'active'"))
    assert "dynamicpruning" in held._jdf.queryExecution().executedPlan().toString()
    assert {(r.embedder_ver, len(r.embedding)) for r in held.collect()} == {("new", 3)}
    found = S.nearest(as_queries(held), held, 2, hide="image")
    plain = images.withColumn("embedding", F.slice("embedding", 1, 3))
    assert sorted(found.collect()) == sorted(S.nearest(as_queries(plain), plain, 2, hide="image").collect())


def test_most_pairs_are_only_met_in_single_precision_and_ranks_stay_exact(monkeypatch):
    rng = np.random.default_rng(11)
    vectors = rng.normal(size=(9000, 64)).astype(np.float32)
    vectors[5000:5400] = vectors[17]  # equal vectors tie, more of them than there are ranks
    vectors[6000] = vectors[6001] + np.float32(1e-7)
    ids = np.arange(9000)
    rows = pa.table({"image_id": ids, "individual_id": ids % 11, "embedding": pa.array(list(vectors))})
    asked = pa.table({"query_id": ids[:600], "hide_id": ids[:600], "embedding": pa.array(list(vectors[:600]))})
    double, many = [], S._Best._many
    monkeypatch.setattr(S._Best, "_many", lambda self, q, v, cols, *x: double.append(len(q) * len(cols)) or many(self, q, v, cols, *x))
    best = S._Best(asked, 20, "image", "image", S.SCORE_DIGITS)
    for at in range(0, 9000, 4000):
        best.add(rows.slice(at, 4000))
    schema = pa.schema([("query_id", pa.int64()), ("image_id", pa.int64()), ("individual_id", pa.int64()), ("score", pa.float64())])
    got = best.table(schema)
    unit = vectors.astype(np.float64) / np.linalg.norm(vectors.astype(np.float64), axis=1, keepdims=True)
    scores = np.round(unit[:600] @ unit.T, S.SCORE_DIGITS)
    scores[np.arange(600), np.arange(600)] = -2
    want = np.argsort(-scores, axis=1, kind="stable")[:, :20]
    assert got.column("image_id").to_numpy().reshape(600, 20).tolist() == want.tolist()
    assert sum(double) < 0.2 * 600 * 9000
