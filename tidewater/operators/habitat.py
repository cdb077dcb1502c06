"""Sighting history, core range, regions and habitat statistics per individual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.contract import answer_all, citation
from tidewater.functions.geo import in_box
from tidewater.functions.ordered import keep_top, order_statistics, ordinal, quantile, range_cells

# fixed values: shelf depth in metres, central share of the core range, citation cap
SHELF_DEPTH_M = -200
CORE_PCT = 0.9
MAX_CITATIONS = 10

BOX = ("lat_min", "lat_max", "lon_min", "lon_max")


def located(sightings: DataFrame) -> DataFrame:
    return sightings.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def sighting_history(sightings: DataFrame) -> DataFrame:
    """Located sightings with their chronological number per individual.

    Unknown dates come last. Numbering is cut into ranges of rows, so an individual
    with very many sightings, dated or not, is not sorted in one task.
    """
    order = [F.col("obs_date").asc_nulls_last(), F.col("sighting_id")]
    ranged = range_cells(located(sightings), [F.col("individual_id"), *order], "_range", "history")
    return ordinal(ranged, ["individual_id"], F.col("_range"), order, "seq").drop("_range")


def core_bbox(sightings: DataFrame, core_pct: float = CORE_PCT, step: float = 0.25) -> DataFrame:
    """Central ``core_pct`` of the sightings per axis; 1.0 gives the full extent.

    Both axes are one pass; ``step`` (degrees) is the histogram cell.
    """
    tail = (1.0 - core_pct) / 2.0
    low = lambda n: F.least(n - 1, F.floor(F.lit(tail) * n))
    high = lambda n: F.least(n - 1, F.floor(F.lit(1.0 - tail) * n))
    axes = located(sightings).select(
        "individual_id", F.expr("stack(2, 'lat', lat, 'lon', lon) as (axis, v)")
    )
    bounds = order_statistics(
        axes, ["individual_id", "axis"], F.col("v"), {"low": low, "high": high}, step
    )
    pick = lambda axis, c: F.max(F.when(F.col("axis") == axis, F.col(c)))
    return bounds.groupBy("individual_id").agg(
        F.max("n").alias("n_sightings"),
        pick("lat", "low").alias("lat_min"),
        pick("lat", "high").alias("lat_max"),
        pick("lon", "low").alias("lon_min"),
        pick("lon", "high").alias("lon_max"),
    )


def full_extent(sightings: DataFrame) -> DataFrame:
    return located(sightings).groupBy("individual_id").agg(
        F.min("lat").alias("lat_min"),
        F.max("lat").alias("lat_max"),
        F.min("lon").alias("lon_min"),
        F.max("lon").alias("lon_max"),
    )


def bbox_outliers(sightings: DataFrame, boxes: DataFrame) -> DataFrame:
    """Sightings in total and outside the box of their individual."""
    inside = in_box(F.col("lat"), F.col("lon"), {c: F.col(c) for c in BOX})
    return (
        located(sightings)
        .join(boxes.select("individual_id", *BOX), "individual_id")
        .groupBy("individual_id")
        .agg(
            F.count(F.lit(1)).alias("n_sightings"),
            F.sum((~inside).cast("long")).alias("n_outside"),
        )
    )


def seen_span(individuals: DataFrame, sightings: DataFrame) -> DataFrame:
    """First and last date seen: the hub value, else from located sightings."""
    dates = located(sightings).groupBy("individual_id").agg(
        F.min("obs_date").alias("_f"), F.max("obs_date").alias("_l")
    )
    return dates.join(
        individuals.select("individual_id", "first_seen", "last_seen"), "individual_id", "left"
    ).select(
        "individual_id",
        F.coalesce("first_seen", "_f").alias("first_seen"),
        F.coalesce("last_seen", "_l").alias("last_seen"),
    )


def sighting_lookup(
    requests: DataFrame,
    sightings: DataFrame,
    individuals: DataFrame,
    core_pct: float = CORE_PCT,
) -> DataFrame:
    """One contract row per requested individual: name, span, core range, citations."""
    wanted = located(sightings).join(requests, "individual_id", "left_semi")
    boxes = core_bbox(wanted, core_pct)
    outside = bbox_outliers(wanted, boxes).drop("n_sightings")
    first = Window.partitionBy("individual_id").orderBy(
        F.col("obs_date").asc_nulls_last(), "sighting_id"
    )
    cited = keep_top(wanted, first, MAX_CITATIONS, "_r")
    source = F.coalesce("provider", F.lit("catalog"))
    one = F.struct("_r", citation("sighting", source, F.col("thumb_url"), F.col("individual_id")))
    cites = cited.groupBy("individual_id").agg(
        F.transform(F.array_sort(F.collect_list(one)), lambda c: c["col2"]).alias("citations")
    )
    names = individuals.select(
        "individual_id", F.coalesce("common_name", "name").alias("name")
    )
    found = (
        boxes.join(outside, "individual_id")
        .join(seen_span(individuals, wanted), "individual_id")
        .join(cites, "individual_id")
        .join(names, "individual_id", "left")
    )
    span = F.when(
        F.col("first_seen").isNotNull() & F.col("last_seen").isNotNull(),
        F.concat_ws("–", F.col("first_seen").cast("string"), F.col("last_seen").cast("string")),
    ).otherwise("dates unknown")
    who = F.coalesce("name", F.concat(F.lit("individual "), F.col("individual_id").cast("string")))
    trimmed = F.when(
        F.col("n_outside") > 0,
        F.format_string("; %d outlying sightings trimmed from range", "n_outside"),
    ).otherwise("")
    text = F.concat(
        F.format_string("%d sightings of %s (%s); ", F.col("n_sightings"), who, span),
        F.format_string(f"core range (central {core_pct:.0%}%) lat %.2f–%.2f, ", "lat_min", "lat_max"),
        F.format_string("lon %.2f–%.2f", "lon_min", "lon_max"),
        trimmed,
    )
    return answer_all(
        requests.select("individual_id").distinct(),
        found.withColumn("summary", text),
        "individual_id",
        "sighting_lookup",
        "No sightings for this individual",
    )


def region_label(points: DataFrame, regions: DataFrame, grid: int = 10) -> DataFrame:
    """Named region of each point; the first region by name if boxes overlap.

    Boxes are laid on a grid of ``grid`` degrees and met by an equi join on the
    grid cell; the exact test follows. ``points`` carries ``point_id, lat, lon``.
    """
    cell = lambda c: F.floor(c / F.lit(grid)).cast("int")
    tiles = regions.withColumn(
        "_gx", F.explode(F.sequence(cell(F.col("lon_min")), cell(F.col("lon_max"))))
    ).withColumn("_gy", F.explode(F.sequence(cell(F.col("lat_min")), cell(F.col("lat_max")))))
    placed = points.withColumn("_gx", cell(F.col("lon"))).withColumn("_gy", cell(F.col("lat")))
    # boxes per grid cell are few, so the list per cell is short and fixed by the region table
    boxes = tiles.groupBy("_gx", "_gy").agg(
        F.array_sort(F.collect_list(F.struct("region", *BOX))).alias("_boxes")
    )
    hits = F.filter(
        "_boxes",
        lambda b: F.col("lat").between(b["lat_min"], b["lat_max"])
        & F.col("lon").between(b["lon_min"], b["lon_max"]),
    )
    return (
        placed.join(boxes, ["_gx", "_gy"], "left")
        .withColumn("region", F.try_element_at(hits, F.lit(1))["region"])
        .drop("_gx", "_gy", "_boxes")
    )


def region_profile(labelled: DataFrame) -> DataFrame:
    """Per region: sightings, share, individuals, and individuals seen only there."""
    rows = labelled.withColumn("region", F.coalesce("region", F.lit("other")))
    pairs = rows.groupBy("individual_id", "region").agg(F.count(F.lit(1)).alias("_n"))
    spread = pairs.groupBy("individual_id").agg(F.count(F.lit(1)).alias("_regions"))
    total = labelled.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        pairs.join(spread, "individual_id")
        .groupBy("region")
        .agg(
            F.sum("_n").alias("n_sightings"),
            F.count(F.lit(1)).alias("n_individuals"),
            F.avg((F.col("_regions") == 1).cast("double")).alias("single_region_share"),
        )
        .withColumn("share", F.col("n_sightings") / total)
    )


def density_grid(sightings: DataFrame, degrees: float = 1.0) -> DataFrame:
    """Sightings per grid cell and month, with the share of the month in the cell."""
    axis = lambda c: F.floor(F.col(c) / F.lit(degrees)).cast("int")
    cells = (
        located(sightings)
        .where(F.col("obs_date").isNotNull())
        .groupBy(
            axis("lat").alias("lat_cell"), axis("lon").alias("lon_cell"),
            F.month("obs_date").alias("month"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )
    whole = Window.partitionBy("lat_cell", "lon_cell")
    return cells.withColumn("month_share", F.col("n") / F.sum("n").over(whole))


def json_number(doc: Column, path: str) -> Column:
    return F.get_json_object(doc, path).try_cast("double")


def environment(encounters: DataFrame) -> DataFrame:
    """Depth, temperature, ecosystem and protected area from the enrichment JSON."""
    doc = F.col("oceano")
    owner = ["individual_id"] if "individual_id" in encounters.columns else []
    return encounters.select(
        *owner,
        F.col("row_id").alias("source_row_id"),
        json_number(doc, "$.BATH.ETOPO1").alias("depth"),
        json_number(doc, "$.SST.OISST.DAY").alias("sst"),
        F.get_json_object(doc, "$.ZONE.LME[0].LME_NAME").alias("lme"),
        F.get_json_object(doc, "$.ZONE.WDPA[0].NAME").alias("wdpa"),
    )


def context_join(sightings: DataFrame, staging: DataFrame) -> DataFrame:
    """Sightings with their staging row; a repeated staging row id counts once."""
    once = staging.dropDuplicates(["source_row_id"])
    return sightings.select("individual_id", "sighting_id", "source_row_id").join(
        once, "source_row_id"
    )


def habitat_context(rows: DataFrame, shelf_depth: float = SHELF_DEPTH_M) -> DataFrame:
    """Habitat of each individual from ``individual_id, depth, sst, lme, wdpa`` rows.

    A row without depth counts in ``n`` only. Medians come from the histogram
    order statistics; the lists hold ecosystem and area names, which are few.
    """
    base = rows.groupBy("individual_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("depth").alias("depth_min"),
        F.max("depth").alias("depth_max"),
        F.avg((F.col("depth") > F.lit(shelf_depth)).cast("int")).alias("shelf_fraction"),
        F.min("sst").alias("sst_min"),
        F.max("sst").alias("sst_max"),
        F.array_sort(F.collect_set("lme")).alias("regions"),
        F.array_sort(F.collect_set("wdpa")).alias("sanctuaries"),
    )
    # both medians in one pass; the cell width depends on the measure
    measures = rows.select(
        "individual_id", F.expr("stack(2, 'depth', depth, 'sst', sst) as (measure, v)")
    )
    width = F.when(F.col("measure") == "depth", 25.0).otherwise(0.5)
    medians = quantile(measures, ["individual_id", "measure"], F.col("v"), 0.5, "median", width)
    pick = lambda m: F.max(F.when(F.col("measure") == m, F.col("median"))).alias(f"{m}_median")
    wide = medians.groupBy("individual_id").agg(pick("depth"), pick("sst"))
    return base.join(wide, "individual_id", "left")


def habitat_answers(requests: DataFrame, habitat: DataFrame) -> DataFrame:
    """One contract row per requested individual."""
    bits = F.concat_ws(
        "; ",
        F.format_string("%d sightings", "n"),
        F.when(
            F.col("depth_median").isNotNull(),
            F.concat(
                F.format_string("median depth %.0f m", F.round("depth_median", 0)),
                F.when(
                    F.col("shelf_fraction").isNotNull(),
                    F.format_string(
                        " (%.0f%% over continental shelf)", F.round(F.round("shelf_fraction", 6) * 100, 0)
                    ),
                ).otherwise(""),
            ),
        ),
        F.when(F.col("sst_median").isNotNull(), F.format_string("SST ~%.1f°C", F.round(F.round("sst_median", 6), 1))),
        F.when(F.size("regions") > 0, F.concat(F.lit("regions: "), F.array_join("regions", ", "))),
        F.when(
            F.size("sanctuaries") > 0,
            F.concat(F.lit("sanctuaries: "), F.array_join("sanctuaries", ", ")),
        ),
    )
    cites = F.array(
        citation("sighting", F.lit("encounter enrichment"), F.lit(None), F.col("individual_id"))
    )
    return answer_all(
        requests.select("individual_id").distinct(),
        habitat.withColumn("summary", bits).withColumn("citations", cites),
        "individual_id",
        "sighting_context",
        "No oceano context for this individual",
    )


def habitat_extra(rows: DataFrame, region: str, paths: dict[str, str]) -> DataFrame:
    """Share of rows per region that carry each further measurement, and its mean."""
    typed = rows.select(region, *[json_number(F.col("oceano"), p).alias(n) for n, p in paths.items()])
    aggregates = [F.count(F.lit(1)).alias("n")]
    for name in paths:
        aggregates.append(F.avg(F.col(name).isNotNull().cast("int")).alias(f"{name}_share"))
        aggregates.append(F.avg(name).alias(f"{name}_mean"))
    return typed.groupBy(region).agg(*aggregates)
