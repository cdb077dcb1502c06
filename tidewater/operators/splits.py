"""Frozen hash splits, their checks, and repeatable samples for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.hashing import draw, hash_bucket, md5_hex, permuted, seeded, stratum
from tidewater.functions.ordered import keep_top, ordinal

# fixed values: eligibility floors and bucket limits of the splits
MIN_CLOSED_SET = 10
MIN_PAIR = 2
MIN_GALLERY = 4
VAL_FROM = 70
TEST_FROM = 85
GALLERY_CAP = 6


def split_label(n: Column, bucket: Column) -> Column:
    """Few photos always train; then test, validation, train by bucket."""
    return (
        F.when(n < MIN_GALLERY, "train")
        .when(bucket >= TEST_FROM, "test")
        .when(bucket >= VAL_FROM, "val")
        .otherwise("train")
    )


def _held_out() -> Column:
    """The sighting with the smallest hash: an aggregate, so a hot individual is combined early."""
    return F.min(F.struct(md5_hex(F.col("sighting_id")).alias("h"), "sighting_id"))["sighting_id"]


def eligible(images: DataFrame, floor: int) -> DataFrame:
    """Individuals with at least ``floor`` images."""
    return (
        images.groupBy("individual_id")
        .agg(F.count(F.lit(1)).alias("n_photos"))
        .where(F.col("n_photos") >= floor)
    )


def holdout_pick(images: DataFrame) -> DataFrame:
    """One repeatable held-out sighting per individual."""
    return images.groupBy("individual_id").agg(_held_out().alias("query_sighting_id"))


def loo_split(images: DataFrame, floor: int = MIN_CLOSED_SET) -> DataFrame:
    """Closed-set split: one held-out sighting per individual with enough images."""
    return (
        images.groupBy("individual_id")
        .agg(F.count(F.lit(1)).alias("_n"), _held_out().alias("query_sighting_id"))
        .where(F.col("_n") >= floor)
        .select("individual_id", "query_sighting_id", F.lit("closed_set").alias("role"))
    )


def reid_split(images: DataFrame, embedder_ver: str | None = None) -> DataFrame:
    """Train, validation and test split, disjoint by individual, in one aggregation.

    With ``embedder_ver`` only images stored at that version count: others have no vector
    to be asked with.
    """
    counted = images if embedder_ver is None else images.where(F.col("embedder_ver") == embedder_ver)
    per = (
        counted.groupBy("individual_id")
        .agg(F.count(F.lit(1)).alias("n_photos"), _held_out().alias("_q"))
        .where(F.col("n_photos") >= MIN_PAIR)
    )
    label = split_label(F.col("n_photos"), hash_bucket(F.col("individual_id")))
    return per.withColumn("split", label).select(
        "individual_id",
        "split",
        "n_photos",
        F.when(F.col("split").isin("val", "test"), F.col("_q")).alias("query_sighting_id"),
    )


def split_summary(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(
        F.count(F.lit(1)).alias("individuals"),
        F.sum("n_photos").alias("images"),
        F.round(F.avg("n_photos"), 1).alias("mean_photos"),
        F.count("query_sighting_id").alias("held_out_queries"),
    )


def split_leakage(split: DataFrame) -> DataFrame:
    """Counts that must all be zero in a sound split."""
    per = split.groupBy("individual_id").agg(
        F.count_distinct("split").alias("_s"),
        F.sum(
            ((F.col("split") == "train") & F.col("query_sighting_id").isNotNull()).cast("long")
        ).alias("_t"),
        F.sum(
            ((F.col("split") != "train") & F.col("query_sighting_id").isNull()).cast("long")
        ).alias("_e"),
    )
    return per.agg(
        F.sum((F.col("_s") > 1).cast("long")).alias("in_two_splits"),
        F.sum("_t").alias("train_with_query"),
        F.sum("_e").alias("eval_without_query"),
    )


def eval_cases(split: DataFrame, individuals: DataFrame, name: str, allow_test: bool = False) -> DataFrame:
    """Cases of one split: id, input, expected and tags."""
    guard_test(name, allow_test)
    picked = split.where((F.col("split") == name) & F.col("query_sighting_id").isNotNull())
    named = picked.join(individuals.select("individual_id", "name"), "individual_id")
    return named.select(
        F.concat(F.lit(f"reid-{name}-"), F.col("query_sighting_id").cast("string")).alias("case_id"),
        F.struct("query_sighting_id", "individual_id", "name").alias("input"),
        F.struct("individual_id", "name").alias("expected"),
        F.array(F.lit(f"reid_{name}")).alias("tags"),
    )


def guard_test(split: str, allow_test: bool) -> None:
    """The test split is sealed unless the caller says so."""
    if split not in ("train", "val", "test"):
        raise ValueError(f"unknown split {split!r}")
    if split == "test" and not allow_test:
        raise PermissionError("the test split needs allow_test=True")


def gallery_of(images: DataFrame, split: DataFrame, name: str) -> DataFrame:
    """Images of every individual of a split."""
    members = split.where(F.col("split") == name).select("individual_id")
    return images.join(members, "individual_id", "left_semi")


def gallery_cap(images: DataFrame, cap: int = GALLERY_CAP) -> DataFrame:
    """At most ``cap`` gallery images per individual, smallest id first."""
    first = Window.partitionBy("individual_id").orderBy("image_id")
    return keep_top(images, first, cap, "slot")


def train_pool(split: DataFrame, manifest: DataFrame, floor: int, name: str = "train") -> DataFrame:
    """Readable images of the individuals of a split that keep at least ``floor`` of them."""
    members = split.where((F.col("split") == name) & (F.col("n_photos") >= floor))
    readable = manifest.where(F.col("status") == "ok").join(
        members.select("individual_id"), "individual_id", "left_semi"
    )
    enough = eligible(readable, floor).select("individual_id")
    return readable.join(enough, "individual_id", "left_semi").select(
        "individual_id", "sighting_id", "asset_ref"
    )


def label_index(pool: DataFrame) -> DataFrame:
    """Images with the class index of their individual in id order.

    Individuals are numbered in ranges of ids, so no single task orders all of them.
    """
    people = pool.select("individual_id").distinct()
    numbered = ordinal(
        people, [], F.floor(F.col("individual_id") / 10000), [F.col("individual_id")], "_i"
    )
    index = numbered.select("individual_id", (F.col("_i") - 1).cast("int").alias("class_index"))
    return pool.join(index, "individual_id").select("asset_ref", "individual_id", "class_index")


ID_RANGE = 10_000  # ids that are numbered in one task


def _numbered(df: DataFrame, keys: list[str], id_col: str, out: str) -> DataFrame:
    """Zero-based position in id order; ranges of ids are numbered apart, so there are as many as the data needs."""
    numbered = ordinal(df, keys, F.floor(F.col(id_col) / ID_RANGE), [F.col(id_col)], out)
    return numbered.withColumn(out, F.col(out) - 1)


def _range(counts: DataFrame, out: str, step: int = 10_000) -> DataFrame:
    """``0 .. n-1`` for the one row of ``counts`` (``n``), which is known only when the job runs."""
    blocks = counts.select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / step))).alias("_b"))
    first = F.col("_b") * step
    last = F.least(first + step, F.col("n")) - 1
    return blocks.where("n > 0").repartition("_b").select(F.explode(F.sequence(first, last)).alias(out))


def pk_batches(pool: DataFrame, batches: int | None, p: int, k: int, seed: int = 0) -> DataFrame:
    """``batches`` batches of ``p`` individuals with ``k`` images each.

    Individuals of a batch are distinct; images are distinct if the individual
    has at least ``k``, else drawn with replacement. A draw names a place in a keyed
    permutation of the individuals, or of an individual's images, which are numbered by
    id: nothing is put in random order. Without ``batches`` there are as many as the pool
    has images for (one at least), counted when the job runs.
    """
    images = _numbered(pool, ["individual_id"], "sighting_id", "_slot")
    people = _numbered(
        pool.groupBy("individual_id").agg(F.count(F.lit(1)).alias("n_photos")), [], "individual_id", "_who"
    )
    total = people.agg(F.count(F.lit(1)).alias("n")).scalar()
    if batches is None:
        enough = pool.agg(F.greatest(F.floor(F.count(F.lit(1)) / (p * k)), F.lit(1).cast("long")).alias("n"))
        numbers = _range(enough, "batch")
    else:
        numbers = pool.sparkSession.range(batches).select(F.col("id").alias("batch"))
    draws = (
        numbers.withColumn("n", total)
        .withColumn("p_slot", F.explode(F.sequence(F.lit(0), F.lit(p - 1))))
        .withColumn("_place", stratum(F.col("p_slot"), p, F.col("n"), seed, F.col("batch")))
        .withColumn("_who", permuted(F.col("_place"), F.col("n"), seed, F.lit("people")))
        .drop("n", "_place")
    )
    seats = draws.join(people, "_who").withColumn(
        "k_slot", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    )
    parts = (F.col("batch"), F.col("individual_id"))
    distinct = stratum(F.col("k_slot"), k, F.col("n_photos"), seed, *parts)
    repeated = draw(F.col("n_photos"), seed, *parts, F.col("k_slot"))
    seats = seats.withColumn("_place", F.when(F.col("n_photos") >= k, distinct).otherwise(repeated)).withColumn(
        "_slot", permuted(F.col("_place"), F.col("n_photos"), seed, F.col("individual_id"))
    )
    return seats.join(images, ["individual_id", "_slot"]).select(
        "batch", "p_slot", "k_slot", "individual_id", "sighting_id"
    )


def probe_pairs(pool: DataFrame, individuals: int, seed: int = 0) -> DataFrame:
    """Two distinct images of each of a fixed sample of individuals: query and gallery."""
    sampled = (
        eligible(pool, 2)
        .orderBy(seeded(seed, F.col("individual_id")), "individual_id")
        .limit(individuals)
        .select("individual_id")
    )
    mixed = Window.partitionBy("individual_id").orderBy(
        seeded(seed, F.col("sighting_id")), "sighting_id"
    )
    two = keep_top(pool.join(sampled, "individual_id", "left_semi"), mixed, 2, "_r")
    at = lambda r: F.max(F.when(F.col("_r") == r, F.col("sighting_id")))
    return two.groupBy("individual_id").agg(
        at(1).alias("query_sighting_id"), at(2).alias("gallery_sighting_id")
    )


def query_gallery_sample(
    split: DataFrame, manifest: DataFrame, individuals: int, cap: int = GALLERY_CAP, seed: int = 0
) -> DataFrame:
    """Sampled validation individuals: the held-out query and up to ``cap`` gallery images.

    An individual whose query is unreadable or whose gallery is empty is dropped.
    """
    chosen = (
        split.where((F.col("split") == "val") & F.col("query_sighting_id").isNotNull())
        .orderBy(seeded(seed, F.col("individual_id")), "individual_id")
        .limit(individuals)
        .select("individual_id", "query_sighting_id")
    )
    readable = manifest.where(F.col("status") == "ok").join(chosen, "individual_id")
    is_query = F.col("sighting_id") == F.col("query_sighting_id")
    first = Window.partitionBy("individual_id", "role").orderBy("sighting_id")
    roles = readable.withColumn("role", F.when(is_query, "query").otherwise("gallery"))
    rows = keep_top(roles, first, cap, "slot")
    complete = rows.groupBy("individual_id").agg(F.count_distinct("role").alias("_n")).where("_n = 2")
    return rows.join(complete.select("individual_id"), "individual_id", "left_semi").select(
        "individual_id", "sighting_id", "role", "slot"
    )


def sample_with_replacement(
    rows: DataFrame, id_col: str, n: int | None = None, seed: int = 0
) -> DataFrame:
    """``n`` uniform draws with replacement, repeatable on any cluster.

    Without ``n`` there are as many draws as rows, one epoch; nothing is counted before
    the plan runs.
    """
    ordered = _numbered(rows, [], id_col, "_at")
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    if n is None:
        draws = ordered.select(F.col("_at").alias("draw")).withColumn("_n", total)
    else:
        draws = rows.sparkSession.range(n).select(F.col("id").alias("draw")).withColumn("_n", total)
    draws = draws.withColumn("_at", draw(F.col("_n"), seed, F.col("draw"))).drop("_n")
    return draws.join(ordered, "_at").drop("_at")
