"""Mixing sources to target weights: hash-random order, prefix sums, exact cuts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.hashing import seeded
from tidewater.llm.common import (
    WORD,
    before_in_order,
    numbered_copies,
    range_sorted,
    unpacked,
    with_payload,
)
from tidewater.session import stored


def word_count(text: Column) -> Column:
    """Words (runs of anything but ASCII white space) of a text; a null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float], share: float = 1.5, epochs: float = 2.0
) -> DataFrame:
    """``source``, ``source_size``, ``weight``, ``target`` from ``source``, ``source_size``.

    Sources in code point order (null last) take the weights in turn and share
    ``share`` times all sizes. A target stops at ``epochs`` times its source; what is
    over is shared again by weight until none is above. The rounds are at most as many
    as there are sources; each reads four sums from one row per source.
    """
    listed = range_sorted(sizes.select("source", "source_size"), ["source"], "mix-sources")
    place = F.col("_place") % len(weights)
    weighed = stored(
        before_in_order(listed, [], ["source"], F.lit(1).cast("long"), "_place").select(
            "source",
            "source_size",
            F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")).alias("weight"),
            (F.col("source_size") * float(epochs)).alias("most"),
        ),
        "mix-weights",
    )
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, settled = float("inf"), -1
    open_ = lambda: F.col("most") > F.col("weight") * F.lit(level)
    budget, weight = share * total, weighed.agg(F.sum("weight")).first()[0] or 0.0
    while weight:
        level = budget / weight
        held = weighed.where(~open_()).agg(
            F.count(F.lit(1)), F.coalesce(F.sum("most"), F.lit(0.0)), F.coalesce(F.sum("weight"), F.lit(0.0))
        ).first()
        if held[0] == settled:
            break
        settled, budget = held[0], share * total - held[1]
        weight = weighed.where(open_()).agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    return weighed.select(
        "source",
        "source_size",
        "weight",
        F.least("most", F.col("weight") * F.lit(level)).alias("target"),
    )


def mixed(
    rows: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, epochs: float = 2.0, seed: int = 42
) -> DataFrame:
    """``rows`` (``id``, ``source``, ``size``, more) with ``source_size``, ``target``, ``copies``, ``taken``.

    Within a source the rows stand in an order of seeded hashes of ``id``. Whole epochs
    of a source are taken while its target allows; of the rest, the rows whose end
    brings the running sum nearest to the target, so a source misses it by at most half
    a row. Rows without size (also those with a null text) cost nothing and follow the
    same rule. A null source is a source. Equal ids are told apart by their place.
    """
    keyed = rows.withColumn("_key", F.substring(seeded(seed, F.coalesce(F.col("id").cast("string"), F.lit(""))), 1, 16))
    order = ["_key", "id", "size"]
    ordered = range_sorted(keyed, ["source", *order], "mix-order")
    sizes = ordered.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes, weights, share, epochs), "mix-targets")
    placed = before_in_order(ordered, ["source"], order, F.col("size"), "_before")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - F.col("_whole") * F.col("source_size")
    more = (2 * F.col("_before") + F.col("size") <= 2 * rest) & (rest > 0)
    named = targets.withColumnRenamed("source", "_source").drop("weight")
    return (
        placed.join(named, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_whole", whole.cast("long"))
        .withColumn("copies", F.col("_whole") + more.cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("_source", "_whole", "_before", "_key", "_tie", "_range")
    )


def mix_documents(docs: DataFrame, source: str = "source", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their own columns.

    Only hashes, sources and sizes are ordered; the texts are shuffled once, by row
    hash, to meet their number of copies.
    """
    packed = with_payload(docs)
    slim = packed.select(
        F.col("_id").alias("id"),
        F.col(f"_row.`{source}`").alias("source"),
        word_count(F.col(f"_row.`{text}`")).alias("size"),
    )
    counts = (
        mixed(slim, **options)
        .groupBy("id", "copies")
        .agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("id")
        .agg(F.min("copies").alias("least"), F.max("copies").alias("most"), F.max_by("rows", "copies").alias("with_most"))
    )
    met = numbered_copies(packed, "_id").join(stored(counts, "mix-copies"), F.col("_id") == F.col("id"))
    copies = F.when(F.col("_copy") <= F.col("with_most"), F.col("most")).otherwise(F.col("least"))
    repeated = met.withColumn("_n", copies).where("_n > 0").withColumn("_each", F.explode(F.sequence(F.lit(1), "_n")))
    return unpacked(repeated)
