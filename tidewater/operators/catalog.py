"""Raw encounters to licensed sightings to individuals, and the checks around them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: license patterns that allow storing a row
ALLOWED_LICENSES = ("%creativecommons%", "%publicdomain%")
# fixed value: license part that forbids derivatives
DENIED_LICENSE = "%-nd/%"


def license_allowed(license_: Column, patterns: Sequence[str] = ALLOWED_LICENSES) -> Column:
    allowed = F.lit(False)
    for pattern in patterns:
        allowed = allowed | license_.like(pattern)
    return allowed


def license_not_denied(license_: Column) -> Column:
    """A NULL license is dropped by a filter on this."""
    return ~license_.like(DENIED_LICENSE)


def id_from_url(url: Column) -> Column:
    return F.regexp_extract(url, r"(\d+)$", 1).try_cast("bigint")


def clean_date(text: Column) -> Column:
    """Empty text is no date, and text that is not a date is none either."""
    return F.nullif(text, F.lit("")).try_cast("date")


def sighting_key(row_id: Column) -> Column:
    """A stable id of a source row: the first 60 bits of its md5."""
    return F.conv(F.left(F.md5(row_id.cast("string")), F.lit(15)), 16, 10).cast("long")


# fixed values: optional columns of a raw encounter, their types and their names in the catalog
OPTIONAL = {
    "group_size": ("int", "group_size"),
    "external_resource": ("string", "image_url"),
    "external_resource_thumb": ("string", "thumb_url"),
    "rights_holder": ("string", "rights_holder"),
    "provider": ("string", "provider"),
}


def clean_encounters(raw: DataFrame) -> DataFrame:
    """Renames and typed columns of the raw encounter rows, before any filter.

    Columns of ``OPTIONAL`` that the source does not have are null.
    """
    more = [
        (F.col(name) if name in raw.columns else F.lit(None)).cast(kind).alias(new)
        for name, (kind, new) in OPTIONAL.items()
    ]
    return raw.select(
        sighting_key(F.col("row_id")).alias("sighting_id"),
        id_from_url(F.col("organism_id")).alias("individual_id"),
        F.col("organism_id").alias("individual_url"),
        F.col("scientific_name").alias("species"),
        clean_date(F.col("date_time")).alias("obs_date"),
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lon"),
        "license",
        F.col("row_id").alias("source_row_id"),
        *more,
    )


def build_sightings(raw: DataFrame) -> DataFrame:
    """Licensed encounters of a known individual."""
    clean = clean_encounters(raw)
    return clean.where(F.col("individual_id").isNotNull() & license_allowed(F.col("license")))


def hub_derive(sightings: DataFrame) -> DataFrame:
    """One row per individual: most frequent species (smallest on ties), count, date span.

    Counts per (individual, species) are combined first; nothing is collected.
    """
    per_species = sightings.groupBy("individual_id", "species").agg(
        F.count(F.lit(1)).alias("_n"), F.min("obs_date").alias("_f"), F.max("obs_date").alias("_l")
    )
    return per_species.groupBy("individual_id").agg(
        F.min(
            F.when(F.col("species").isNotNull(), F.struct((-F.col("_n")).alias("k"), "species"))
        )["species"].alias("species"),
        F.sum("_n").alias("n_sightings"),
        F.min("_f").alias("first_seen"),
        F.max("_l").alias("last_seen"),
    )


def build_individuals(sightings: DataFrame) -> DataFrame:
    """The hub with the page of each individual: the smallest address its sightings give."""
    pages = sightings.groupBy("individual_id").agg(F.min("individual_url").alias("individual_url"))
    return hub_derive(sightings).join(pages, "individual_id")


def build_catalog_report(raw: DataFrame) -> DataFrame:
    """Row counts of the catalog build, with the reason of every dropped row."""
    clean = clean_encounters(raw)
    no_id = F.col("individual_id").isNull()
    open_license = F.coalesce(license_allowed(F.col("license")), F.lit(False))
    kept = ~no_id & open_license
    count = lambda c: F.sum(c.cast("long"))
    report = clean.agg(
        F.count(F.lit(1)).alias("raw_rows"),
        count(kept).alias("sightings"),
        count(no_id).alias("no_individual"),
        count(~no_id & F.col("license").isNull()).alias("no_license"),
        count(~no_id & F.col("license").isNotNull() & ~open_license).alias("closed_license"),
        F.count_distinct(F.when(kept, F.col("individual_id"))).alias("individuals"),
    )
    return report


def orphan_check(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Number of child rows and of child rows without a parent.

    Child rows are counted per key before the join, so a hot key is one row.
    """
    parents = parent.select(F.col(key).alias("_p")).distinct()
    per_key = child.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.join(parents, F.col(key) == F.col("_p"), "left").agg(
        F.sum("_n").alias("n_rows"),
        F.sum(F.when(F.col("_p").isNull(), F.col("_n")).otherwise(0)).alias("n_orphans"),
    )


def version_census(embeddings: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows per embedding version and their share of the manifest."""
    total = manifest.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        embeddings.groupBy("embedder_ver")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("coverage", F.col("n_rows") / total)
    )


def singleton_tail(sightings: DataFrame) -> DataFrame:
    """Individuals, those seen once, mean and highest number of sightings."""
    per = sightings.groupBy("individual_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.count(F.lit(1)).alias("individuals"),
        F.sum((F.col("n") == 1).cast("long")).alias("seen_once"),
        F.avg("n").alias("mean_sightings"),
        F.max("n").alias("most_sightings"),
    )


def status_normalize(status: Column) -> Column:
    return F.when(status.isin("ok", "found", "200"), "ok").otherwise("failed")


def manifest_join(manifest: DataFrame, sightings: DataFrame) -> DataFrame:
    """Manifest rows with the date, license and species of their sighting."""
    return manifest.join(
        sightings.select("sighting_id", "species", "obs_date", "license"), "sighting_id"
    )


def hub_enrich(images: DataFrame, sightings: DataFrame, individuals: DataFrame) -> DataFrame:
    """Images with their sighting (required) and the individual's name (optional)."""
    return images.join(
        sightings.select("sighting_id", "thumb_url"), "sighting_id"
    ).join(individuals.select("individual_id", "name"), "individual_id", "left")


def filters_where(
    *,
    available: Sequence[str],
    species: Sequence[str] | None = None,
    region: tuple[float, float, float, float] | None = None,
    date_range: tuple[str, str] | None = None,
    source: Sequence[str] | None = None,
) -> Column:
    """One filter record to one predicate; fields without a matching column are ignored.

    ``available`` are the columns of the table; ``species`` may be an array
    column there (``species_list``). ``region`` is lat_min, lat_max, lon_min, lon_max.
    """
    where = F.lit(True)
    if species is not None:
        if "species_list" in available:
            wanted = F.array(*[F.lit(s) for s in species])
            where = where & F.arrays_overlap(F.col("species_list"), wanted)
        elif "species" in available:
            where = where & F.col("species").isin(list(species))
    if region is not None and {"lat", "lon"} <= set(available):
        lat_min, lat_max, lon_min, lon_max = region
        where = where & F.col("lat").between(lat_min, lat_max)
        where = where & F.col("lon").between(lon_min, lon_max)
    if date_range is not None and "obs_date" in available:
        low, high = (F.lit(d).cast("date") for d in date_range)
        where = where & F.col("obs_date").between(low, high)
    if source is not None and "source" in available:
        where = where & F.col("source").isin(list(source))
    return where


def stock_facts(species: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts card per species (a published table with one row per species)."""
    return species.join(facts, "species", "left")
