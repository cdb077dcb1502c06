"""The result contract: ``ok``, a one-line ``summary`` and ``citations``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CITATION = "struct<kind:string,source:string,locator:string,ref:string>"


def citation(kind: str, source: Column, locator: Column, ref: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        source.cast("string").alias("source"),
        locator.cast("string").alias("locator"),
        ref.cast("string").alias("ref"),
    )


def no_citations() -> Column:
    return F.array().cast(f"array<{CITATION}>")


def answer_all(
    requests: DataFrame, results: DataFrame, key: str, tool: str, empty_summary: str
) -> DataFrame:
    """One row per request; a request without a result gets ``ok = false``.

    ``results`` carries ``summary`` and ``citations`` and at most one row per key.
    """
    found = results.withColumn("_found", F.lit(True))
    return (
        requests.join(found, key, "left")
        .withColumn("tool", F.lit(tool))
        .withColumn("ok", F.coalesce(F.col("_found"), F.lit(False)))
        .withColumn("summary", F.coalesce(F.col("summary"), F.lit(empty_summary)))
        .withColumn("citations", F.coalesce(F.col("citations"), no_citations()))
        .drop("_found")
    )
