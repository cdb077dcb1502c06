"""Proportional stratified interleaving, with DataFrame operations only.

Rows of a source are numbered in a seeded order; row ``r`` of ``n`` stands at the
fraction ``(r - 1/2) / n``. In the order of these fractions every stretch holds each
source in proportion, so equal cuts give shards that match the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.hashing import seeded
from tidewater.llm.common import (
    before_in_order,
    numbered_copies,
    range_sorted,
    unpacked,
    with_payload,
)
from tidewater.session import stored


def interleaved(rows: DataFrame, shards: int = 16, seed: int = 42) -> DataFrame:
    """``rows`` (``id``, ``source``, more) with ``shard`` and ``slot`` (from 0 in each shard).

    Row counts of shards differ by at most one. Both orders are range sorts of slim rows,
    written once each; totals of ranges give the numbers. Null ids and sources are values
    like any other; rows that agree in both are told apart by their place.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    keyed = rows.withColumn("_key", F.substring(seeded(seed, F.coalesce(F.col("id").cast("string"), F.lit(""))), 1, 16))
    within = range_sorted(keyed, ["source", "_key", "id"], "shard-source")
    ranked = before_in_order(within, ["source"], ["_key", "id"], F.lit(1).cast("long"), "_rank")
    counts = within.groupBy(F.col("source").alias("_source")).agg(F.count(F.lit(1)).alias("_n"))
    spread = (
        ranked.join(counts, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_at", (2 * F.col("_rank") + 1) / (2 * F.col("_n")))
        .drop("_source", "_n", "_rank", "_range", "_tie")
    )
    order = ["_at", "source", "_key", "id"]
    across = range_sorted(spread, order, "shard-order")
    total = max(across.count(), 1)
    return (
        before_in_order(across, [], order, F.lit(1).cast("long"), "_place")
        .withColumn("shard", F.expr(f"(_place * {shards}L) div {total}L").cast("int"))
        .withColumn("slot", F.expr(f"_place - (shard * {total}L + {shards - 1}L) div {shards}L"))
        .drop("_place", "_at", "_key", "_tie", "_range")
    )


def shard_documents(docs: DataFrame, source: str = "source", **options) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``; columns of these names are replaced.

    The texts are shuffled once, by row hash, to meet their place. Copies of a row are
    numbered on both sides, and number meets number.
    """
    kept = docs.drop("shard", "slot")
    packed = with_payload(kept)
    slim = packed.select(F.col("_id").alias("id"), F.col(f"_row.`{source}`").alias("source"))
    places = stored(interleaved(slim, **options).select("id", "shard", "slot"), "shard-places")
    numbered = numbered_copies(places, "id", "shard", "slot").withColumnRenamed("_copy", "_same")
    met = numbered_copies(packed, "_id").join(
        numbered, (F.col("_id") == F.col("id")) & (F.col("_copy") == F.col("_same"))
    )
    return unpacked(met, F.col("shard"), F.col("slot"))
