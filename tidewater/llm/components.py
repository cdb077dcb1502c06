"""Connected components of a link table, as joins and minima."""

from __future__ import annotations

import atexit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.session import _remove_quietly, discard, shared_path


def _written(df: DataFrame, path: str) -> tuple[DataFrame, tuple]:
    spark = df.sparkSession
    df.write.parquet(path)
    atexit.register(_remove_quietly, spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return back, tuple(back.agg(F.count(F.lit(1)), mark).first())


def _lowest(edges: DataFrame, node: str, other: str) -> DataFrame:
    """Each ``node`` with the smallest of its neighbours and itself."""
    return edges.groupBy(F.col(node).alias("u")).agg(F.min(other).alias("m")).select(
        "u", F.least("u", "m").alias("m")
    )


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node``, ``label`` (smallest node it can reach) for the nodes of ``links``.

    Alternating star contraction: every node hands its larger, then its smaller
    neighbours to the smallest one it knows. Neighbour lists are never gathered; a
    step is a grouped minimum (combined map-side) and a join that adaptive execution
    can split at a hot node. Rounds grow with the logarithm of the longest chain;
    each is written to the shared folder and removed after the next one.
    Links with a null end or from a node to itself are ignored.
    """
    spark = links.sparkSession
    fresh = lambda: shared_path(spark, "components")
    edges, mark = _written(
        links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b")))
        .distinct(),
        path := fresh(),
    )
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        large = (
            both.join(_lowest(both, "u", "v"), "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("a"), F.col("m").alias("b"))
        )
        lowest = _lowest(large, "a", "b")
        small = (
            large.join(lowest, large["a"] == lowest["u"])
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(lowest.select(F.col("u").alias("a"), F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        edges, now = _written(small, new := fresh())
        discard(spark, path)
        path = new
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
