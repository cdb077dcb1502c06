"""Scans: tables, task lists, image listings, page lists, raster tiles and zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.sources import schemas


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def jdbc_table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A database table; give ``partitionColumn`` and bounds to read it in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def download_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Headerless three-column CSV, fields trimmed."""
    return spark.read.schema(schemas.DOWNLOAD_TASKS).csv(
        path, header=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True
    )


def image_listing(spark: SparkSession, root: str, with_content: bool = False) -> DataFrame:
    """``<individual>/<sighting>.jpg`` files below ``root``; bytes only on request."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.jpg")
        .load(root)
    )
    ids = r"([^/]+)/([^/]+)\.jpg$"
    cols = [
        F.regexp_extract("path", ids, 1).try_cast("bigint").alias("individual_id"),
        F.regexp_extract("path", ids, 2).try_cast("bigint").alias("sighting_id"),
        F.col("path").alias("asset_ref"),
        F.col("length").alias("n_bytes"),
    ]
    return files.select(*cols, *(["content"] if with_content else []))


def gallery(spark: SparkSession, path: str, versions: DataFrame) -> DataFrame:
    """Stored vectors of the versions in ``versions`` (``embedder_ver``) only.

    The versions are found while the job runs, and folders of others are not read: the
    table of versions is a settings table of a row per version, filtered by a comparison
    (a bare flag does not make Spark prune).
    """
    return spark.read.parquet(path).join(versions.select("embedder_ver"), "embedder_ver", "left_semi")


def page_concat(pages: DataFrame, doc: str, page_no: str, text: str) -> DataFrame:
    """Document text: its pages joined by newlines in page order (one row per document)."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(page_no), F.coalesce(text, F.lit("")).alias("t"))))
    return pages.groupBy(doc).agg(
        F.array_join(F.transform(ordered, lambda p: p["t"]), "\n").alias("text"),
        F.count(F.lit(1)).alias("n_pages"),
    )


def page_range_select(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Pages inside hand-mapped ranges ``(doc_id, first_page, last_page)``, each page once."""
    hit = F.col("page_no").between(F.col("first_page"), F.col("last_page"))
    joined = pages.alias("p").join(
        ranges.alias("r"), (F.col("p.doc_id") == F.col("r.doc_id")) & hit, "left_semi"
    )
    return joined


def raster_cells(tiles: DataFrame) -> DataFrame:
    """Tiles to cells with traffic: row and column in the tile and centre coordinates.

    The value 0 is nodata; it and whole nodata tiles leave no rows.
    """
    cells = tiles.select("year", "rid", "ulx", "uly", "scale", "width", F.posexplode("pixels"))
    col, row = F.col("pos") % F.col("width"), F.floor(F.col("pos") / F.col("width"))
    return cells.where("col <> 0").select(
        "year",
        "rid",
        col.cast("int").alias("tile_col"),
        row.cast("int").alias("tile_row"),
        (F.col("ulx") + (col + 0.5) * F.col("scale")).alias("x"),
        (F.col("uly") - (row + 0.5) * F.col("scale")).alias("y"),
        F.col("col").cast("long").alias("value"),
    )


def grid_cells(tiles: DataFrame, x0: float, y0: float, scale: float) -> DataFrame:
    """Cells on the integer grid shared by all tiles: ``year, col, row, value``."""
    return raster_cells(tiles).select(
        "year",
        F.floor((F.col("x") - x0) / scale).cast("long").alias("col"),
        F.floor((F.lit(y0) - F.col("y")) / scale).cast("long").alias("row"),
        "value",
    )


def raster_grid_check(tiles: DataFrame, srid: int = 3857, size: int = 256) -> DataFrame:
    """Tile constraints per year: reference system, one scale, tile size, pixel count, alignment."""
    off = lambda c: F.abs(F.col(c) / F.col("scale") - F.round(F.col(c) / F.col("scale")))
    return tiles.groupBy("year").agg(
        F.count(F.lit(1)).alias("tiles"),
        F.bool_and(F.col("srid") == srid).alias("srid_ok"),
        (F.min("scale") == F.max("scale")).alias("scale_ok"),
        F.bool_and((F.col("width") == size) & (F.col("height") == size)).alias("size_ok"),
        F.bool_and(F.size("pixels") == F.col("width") * F.col("height")).alias("pixels_ok"),
        F.bool_and((off("ulx") < 1e-6) & (off("uly") < 1e-6)).alias("aligned_ok"),
    )


def zone_rings(zones: DataFrame) -> DataFrame:
    """Polygon parts with their box columns, written once at ingest."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    return zones.withColumns(
        {
            "xmin": F.array_min(xs),
            "xmax": F.array_max(xs),
            "ymin": F.array_min(ys),
            "ymax": F.array_max(ys),
        }
    )


def year_union(spark: SparkSession, path: str) -> DataFrame:
    """Yearly tables below ``path`` (``year=...`` folders) under one name, with the year as a column.

    One scan, whatever the years are; a filter on the year reads its folders only, and
    rows without a year stay, with a null.
    """
    return spark.read.parquet(path).withColumn("year", F.col("year").cast("int"))


def path_normalize(path: Column, root: str) -> Column:
    """Drop a leading ``blobs/`` and put the root in front."""
    return F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace(path, "^blobs/", ""))
