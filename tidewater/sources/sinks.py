"""Sinks and the keyed write rules: upsert, insert-if-absent, conditional update."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_latest(existing: DataFrame, new: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Rows of both tables, one per key; the row with the highest ``order`` wins.

    Rows of ``new`` win over ``existing`` on equal order. The ranking window
    keeps one row per key before the shuffle, so a hot key does not travel.
    """
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    latest = Window.partitionBy(*key).orderBy(F.col("_new").desc(), F.col(order).desc())
    return (
        both.withColumn("_rn", F.row_number().over(latest)).where("_rn = 1").drop("_rn", "_new")
    )


def insert_if_absent(
    existing: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[Column] = ()
) -> DataFrame:
    """Rows of ``new`` whose key is not stored yet, one per key (to append)."""
    key = list(key)
    if order:
        first = Window.partitionBy(*key).orderBy(*order)
        once = new.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
    else:
        once = new.dropDuplicates(key)
    return once.join(existing.select(*key), key, "left_anti")


def conditional_update(
    df: DataFrame, flagged: DataFrame, key: str, column: str, old: str, value: str
) -> DataFrame:
    """Set ``column`` to ``value`` where it is ``old`` and the key is flagged.

    ``changed`` marks the updated rows, so a second run changes nothing.
    """
    marks = flagged.select(key).distinct().withColumn("_flag", F.lit(True))
    joined = df.join(marks, key, "left")
    change = F.coalesce(F.col("_flag") & (F.col(column) == old), F.lit(False))
    return (
        joined.withColumn("changed", change)
        .withColumn(column, F.when(F.col("changed"), value).otherwise(F.col(column)))
        .drop("_flag")
    )


def write_frozen(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace a frozen table (a split) as a whole."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_gallery(vectors: DataFrame, path: str) -> None:
    """Append stored vectors, a folder per ``embedder_ver``: versions may differ in width."""
    vectors.write.mode("append").partitionBy("embedder_ver").parquet(path)


def seed_once(df: DataFrame, path: str) -> None:
    """Write a dataset only if the target does not exist yet."""
    df.write.mode("ignore").parquet(path)


def write_manifest(df: DataFrame, path: str) -> None:
    """Manifest as CSV with a header."""
    df.select("sighting_id", "individual_id", "asset_ref", "source_url", "status").write.option(
        "header", True
    ).mode("overwrite").csv(path)


def export_cases(cases: DataFrame) -> DataFrame:
    """Cases as JSON strings: input, expected and tags."""
    return cases.select(
        "case_id",
        F.to_json("input").alias("input"),
        F.to_json("expected").alias("expected"),
        F.to_json("tags").alias("tags"),
    )
