"""Ingest jobs: embed what is missing, flag unreadable images, reconcile downloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.catalog import license_not_denied
from tidewater.operators.embedders import Embedder, embed_rows
from tidewater.sources.sinks import conditional_update, insert_if_absent


def pending(
    manifest: DataFrame, sightings: DataFrame, existing: DataFrame, version: str,
    members: DataFrame | None = None,
) -> DataFrame:
    """Readable, licensed manifest rows without an embedding of this version.

    ``members`` restricts to the individuals of a split.
    """
    rows = (
        manifest.where(F.col("status") == "ok")
        .join(sightings.select("sighting_id", "license"), "sighting_id")
        .where(license_not_denied(F.col("license")))
        .drop("license")
    )
    if members is not None:
        rows = rows.join(members.select("individual_id"), "individual_id", "left_semi")
    done = existing.where(F.col("embedder_ver") == version).select("sighting_id")
    return rows.join(done, "sighting_id", "left_anti")


def embed_pending(
    manifest: DataFrame, sightings: DataFrame, existing: DataFrame, embedder: Embedder, value: str,
    members: DataFrame | None = None,
) -> DataFrame:
    """New embedding rows to append; a second run gives none."""
    todo = pending(manifest, sightings, existing, embedder.version, members)
    new = embed_rows(todo, embedder, value).withColumn("created_at", F.current_timestamp())
    return insert_if_absent(existing, new, ["sighting_id", "embedder_ver"])


def jpeg_complete(content: str) -> Column:
    """Whether the bytes start and end like a complete JPEG file; zeros may follow the end."""
    body = F.decode(F.col(content), "ISO-8859-1")  # a character per byte
    ends = F.rtrim(body, F.lit("\x00")).endswith("\xff\xd9")
    return F.coalesce(body.startswith("\xff\xd8\xff") & ends, F.lit(False))


def flag_unreadable(
    manifest: DataFrame, blobs: DataFrame, readable: Column | None = None
) -> DataFrame:
    """Manifest with ``corrupt`` on every ``ok`` row whose file does not decode.

    blobs: ``asset_ref, content``. ``changed`` marks the updated rows; a dry run
    only counts them.
    """
    check = jpeg_complete("content") if readable is None else readable
    ok_refs = manifest.where(F.col("status") == "ok").select("asset_ref")
    bad = blobs.join(ok_refs, "asset_ref", "left_semi").where(~check).select("asset_ref")
    return conditional_update(manifest, bad, "asset_ref", "status", "ok", "corrupt")


def destination(individual: Column, sighting: Column, root: str) -> Column:
    return F.concat(F.lit(root.rstrip("/") + "/"), individual.cast("string"), F.lit("/"),
                    sighting.cast("string"), F.lit(".jpg"))


def download_reconcile(tasks: DataFrame, listing: DataFrame, root: str) -> DataFrame:
    """Download tasks against stored files: destination and ``found`` or ``to_fetch``.

    tasks: ``individual_id, sighting_id, url``; listing: ``asset_ref, n_bytes``.
    """
    planned = tasks.withColumn(
        "asset_ref", destination(F.col("individual_id"), F.col("sighting_id"), root)
    )
    stored = listing.where(F.col("n_bytes") > 0).select("asset_ref").distinct()
    stored = stored.withColumn("_there", F.lit(True))
    return planned.join(stored, "asset_ref", "left").select(
        "individual_id", "sighting_id", "url", "asset_ref",
        F.when(F.col("_there"), "found").otherwise("to_fetch").alias("status"),
    )
