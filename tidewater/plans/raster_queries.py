"""Ranges over traffic and zones, for all individuals at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions.geo import point_box
from tidewater.operators import habitat as H
from tidewater.operators import raster as R
from tidewater.operators import tiles as T
from tidewater.operators.catalog import hub_derive
from tidewater.operators.corpus import zone_to_chunks
from tidewater.plans import bindings as B
from tidewater.plans.catalog_queries import FACTS_SQL, _facts
from tidewater.plans.habitat_queries import CORE_SQL, HABITAT_STATS_SQL, habitat_rows
from tidewater.plans.registry import query
from tidewater.session import stored
from tidewater.sources.scans import table

X0, Y0, SCALE = B.GRID
YEAR_SQL = "CAST(1991 + individual_id % 8 AS INT)"  # the first of the years has no raster


def boxes(spark, d):
    """Core range of every individual, with a year to look at; a table that later steps read."""
    ranges = H.core_bbox(B.sightings(spark, d)).select(
        F.col("individual_id").alias("request_id"),
        F.expr("cast(1991 + individual_id % 8 as int)").alias("year"),
        *H.BOX,
    )
    return stored(ranges, "ranges")


def raster(spark, d):
    """The summed-area tables of all tiles, stored as they are at ingest.

    Every third tile comes twice, once with smaller values: cells of overlapping tiles count once.
    """
    smaller = F.transform("pixels", lambda p: F.greatest(p - 1, F.lit(0)))
    times = F.when(F.col("rid") % 3 == 0, F.array(smaller, F.col("pixels"))).otherwise(F.array("pixels"))
    return stored(T.tile_images(B.tiles(spark, d).withColumn("pixels", F.explode(times)), B.GRID, B.TILE), "tiles")


BOXES_SQL = f"""(
  SELECT individual_id AS request_id, {YEAR_SQL} AS year, lat_min, lat_max, lon_min, lon_max FROM {CORE_SQL})"""


def _x(c):
    return f"6378137 * radians({c})"


def _y(c):
    return f"6378137 * ln(tan(pi() / 4 + radians({c}) / 2))"


def ranged_sql(boxes_sql: str) -> str:
    low = lambda v: f"CAST(ceil(({v}) / {SCALE}::DOUBLE - 0.5::DOUBLE) AS BIGINT)"
    high = lambda v: f"CAST(floor(({v}) / {SCALE}::DOUBLE - 0.5::DOUBLE) AS BIGINT)"
    return f"""(
      SELECT *, {low(f"{_x('lon_min')} - ({X0}::DOUBLE)")} AS c0, {high(f"{_x('lon_max')} - ({X0}::DOUBLE)")} AS c1,
             {low(f"{Y0}::DOUBLE - {_y('lat_max')}")} AS r0, {high(f"{Y0}::DOUBLE - {_y('lat_min')}")} AS r1
      FROM {boxes_sql})"""


def sums_sql(boxes_sql: str) -> str:
    return f"""(
      SELECT b.request_id, b.year, count(*) AS trafficked_cells, CAST(sum(value) AS BIGINT) AS total_transits,
             CAST(max(value) AS BIGINT) AS busiest_cell, sum(value) / count(*) AS mean_per_cell
      FROM {ranged_sql(boxes_sql)} b JOIN {B.CELLS_SQL} c
        ON c.year = b.year AND c.col BETWEEN c0 AND c1 AND c.row BETWEEN r0 AND r1
      GROUP BY ALL)"""


def zones_sql(boxes_sql: str) -> str:
    return f"""(
      SELECT request_id, array_to_string(list_sort(list(DISTINCT name)), '|') AS zones
      FROM {B.zone_hits_sql(boxes_sql)} GROUP BY 1)"""


@query(
    "raster_summary",
    f"""SELECT request_id, year, trafficked_cells, total_transits, busiest_cell,
               round(mean_per_cell, 6) AS mean_per_cell FROM {sums_sql(BOXES_SQL)}""",
)
def _(spark, d):
    ranges = R.cell_range(boxes(spark, d), *B.GRID)
    out = T.box_sums(ranges, raster(spark, d), B.TILE, B.TILE_EDGES).where("trafficked_cells > 0")
    return out.withColumn("mean_per_cell", B.rounded("mean_per_cell"))


@query(
    "box_cell_join",
    f"""SELECT request_id, b.year, count(*) AS n_cells, CAST(sum(value) AS BIGINT) AS transits,
               CAST(sum(col * 1000 + row) AS BIGINT) AS places
        FROM {ranged_sql(BOXES_SQL)} b
        JOIN {B.CELLS_SQL} c ON c.year = b.year AND col BETWEEN c0 AND c1 AND row BETWEEN r0 AND r1
        GROUP BY ALL""",
)
def _(spark, d):
    """The cells themselves in the range of every individual, as count and sums per range."""
    inside = R.box_cells(R.cell_range(boxes(spark, d), *B.GRID), B.cells(spark, d))
    return inside.groupBy("request_id", "year").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.sum("value").alias("transits"),
        F.sum(F.col("col") * 1000 + F.col("row")).alias("places"),
    )


@query("zone_overlap", f"SELECT * FROM {zones_sql(BOXES_SQL)}")
def _(spark, d):
    out = R.zone_overlap(boxes(spark, d), B.zones(spark))
    return out.withColumn("zones", F.array_join("zones", "|"))


YEARS_SQL = f"(SELECT year FROM {B.CELLS_SQL})"


def traffic_sql(boxes_sql: str) -> str:
    return f"""(
      SELECT b.request_id, b.year,
             e.request_id IS NOT NULL AS ok,
             s.trafficked_cells, s.total_transits, s.mean_per_cell, s.busiest_cell, z.zones,
             printf('bbox(%.6f, %.6f, %.6f, %.6f)', round(b.lon_min, 6), round(b.lat_min, 6), round(b.lon_max, 6), round(b.lat_max, 6)) AS place
      FROM {ranged_sql(boxes_sql)} b
      LEFT JOIN (SELECT DISTINCT request_id FROM {ranged_sql(boxes_sql)} r JOIN {B.TILES_SQL} t
                 ON r.year = t.year AND c0 <= c1 AND r0 <= r1 AND c0 <= tx * {B.TILE} + {B.TILE - 1} AND c1 >= tx * {B.TILE}
                    AND r0 <= ty * {B.TILE} + {B.TILE - 1} AND r1 >= ty * {B.TILE}) e ON e.request_id = b.request_id
      LEFT JOIN {sums_sql(boxes_sql)} s ON s.request_id = b.request_id
      LEFT JOIN {zones_sql(boxes_sql)} z ON z.request_id = b.request_id)"""


def answers_sql(boxes_sql: str) -> str:
    return f"""
      SELECT request_id, year, ok, CASE WHEN ok THEN coalesce(trafficked_cells, 0) END AS trafficked_cells,
             CASE WHEN ok THEN coalesce(total_transits, 0) END AS total_transits,
             CASE WHEN ok THEN coalesce(busiest_cell, 0) END AS busiest_cell,
             CASE WHEN ok THEN round(coalesce(mean_per_cell, 0), 6) END AS mean_per_cell,
             CASE WHEN ok THEN coalesce(zones, '') END AS zones,
             CASE WHEN ok THEN zones IS NOT NULL END AS lane_overlap,
             CASE WHEN year NOT IN {YEARS_SQL} THEN 'No AIS data for year ' || CAST(year AS VARCHAR)
                       || ' (have ' || (SELECT string_agg(DISTINCT CAST(year AS VARCHAR), ', ' ORDER BY CAST(year AS VARCHAR))
                                             FROM {B.CELLS_SQL}) || ')'
                  WHEN NOT ok THEN 'Region outside AIS coverage'
                  ELSE format('{{:,}}', coalesce(total_transits, 0)) || ' vessel transits (' || CAST(year AS VARCHAR)
                       || ') over ' || format('{{:,}}', coalesce(trafficked_cells, 0)) || ' cells (mean '
                       || printf('%.1f', coalesce(mean_per_cell, 0)) || '/cell, busiest '
                       || format('{{:,}}', coalesce(busiest_cell, 0)) || ')'
                       || CASE WHEN zones IS NULL THEN '' ELSE '; in zone(s): ' || replace(zones, '|', ', ') END
             END AS summary,
             CASE WHEN ok THEN 'ais|transit counts ' || CAST(year AS VARCHAR) || '|' || place || '|' || CAST(year AS VARCHAR)
                  ELSE '' END AS cited
      FROM {traffic_sql(boxes_sql)}"""


def _answers(out):
    return out.select(
        "request_id", "year", "ok", "trafficked_cells", "total_transits", "busiest_cell",
        B.rounded("mean_per_cell").alias("mean_per_cell"),
        F.array_join("zones", "|").alias("zones"), "lane_overlap", "summary",
        B.cited("citations").alias("cited"),
    )


@query("vessel_traffic", answers_sql(BOXES_SQL))
def _(spark, d):
    return _answers(
        T.vessel_traffic(boxes(spark, d), raster(spark, d), B.zones(spark), B.GRID, B.TILE, B.TILE_EDGES)
    )


POINTS_SQL = f"""(
  SELECT sighting_id AS request_id, CAST(year(obs_date) AS INT) AS year, lat - 0.01::DOUBLE AS lat_min,
         lat + 0.01::DOUBLE AS lat_max, lon - 0.01::DOUBLE AS lon_min, lon + 0.01::DOUBLE AS lon_max
  FROM {B.SIGHTINGS_SQL} WHERE lat IS NOT NULL)"""


@query("traffic_at_point", answers_sql(POINTS_SQL))
def _(spark, d):
    points = B.sightings(spark, d).where("lat is not null").select(
        F.col("sighting_id").alias("request_id"), F.year("obs_date").alias("year"), "lat", "lon"
    )
    return _answers(
        T.traffic_at_point(points, raster(spark, d), B.zones(spark), B.GRID, B.TILE, edges=B.TILE_EDGES)
    )


@query("busy_cells", f"SELECT year, col, row, value FROM {B.CELLS_SQL} WHERE year = 1998 AND value >= 2")
def _(spark, d):
    return R.busy_cells(B.cells(spark, d), 1998, 2)


EXPOSURE_SQL = f"""(
  SELECT request_id AS individual_id, year, ok, total_transits, busiest_cell, mean_per_cell, zones FROM {traffic_sql(BOXES_SQL)})"""


def range_exposure(spark, d):
    """Core range, traffic and zones of every individual, each in its own year, in one plan."""
    answers = T.vessel_traffic(boxes(spark, d), raster(spark, d), B.zones(spark), B.GRID, B.TILE, B.TILE_EDGES)
    return answers.withColumnRenamed("request_id", "individual_id")


@query(
    "range_exposure",
    f"""SELECT individual_id, year, CASE WHEN ok THEN coalesce(total_transits, 0) END AS total_transits,
               CASE WHEN ok THEN coalesce(busiest_cell, 0) END AS busiest_cell,
               CASE WHEN ok THEN coalesce(zones, '') END AS zones, ok FROM {EXPOSURE_SQL}""",
)
def _(spark, d):
    return range_exposure(spark, d).select(
        "individual_id", "year", "total_transits", "busiest_cell", F.array_join("zones", "|").alias("zones"), "ok"
    )


@query(
    "multi_hop",
    f"""SELECT c.individual_id, c.n_sightings, round(c.lat_min, 2) AS lat_min, round(c.lat_max, 2) AS lat_max,
               CASE WHEN e.ok THEN coalesce(e.total_transits, 0) END AS total_transits, e.ok
        FROM {CORE_SQL} c JOIN {EXPOSURE_SQL} e USING (individual_id)""",
)
def _(spark, d):
    """The range answer is the input of the traffic answer: a join, not text between calls."""
    ranges = H.core_bbox(B.sightings(spark, d))
    traffic = range_exposure(spark, d).select("individual_id", "total_transits", "ok")
    return ranges.join(traffic, "individual_id").select(
        "individual_id", "n_sightings", F.round("lat_min", 2).alias("lat_min"),
        F.round("lat_max", 2).alias("lat_max"), "total_transits", "ok",
    )


@query(
    "risk_profile",
    f"""WITH sp AS (SELECT individual_id, first(species ORDER BY n DESC, species) AS species FROM (
                      SELECT individual_id, species, count(*) AS n FROM {B.SIGHTINGS_SQL} GROUP BY ALL) GROUP BY 1)
        SELECT e.individual_id, species, CASE WHEN e.ok THEN coalesce(e.total_transits, 0) END AS total_transits,
               CASE WHEN e.ok THEN coalesce(e.zones, '') END AS zones, h.shelf_fraction, h.depth_median,
               f.abundance, f.pbr
        FROM {EXPOSURE_SQL} e JOIN sp USING (individual_id)
        LEFT JOIN {HABITAT_STATS_SQL} h USING (individual_id) LEFT JOIN {FACTS_SQL} f USING (species)""",
)
def _(spark, d):
    species = hub_derive(B.sightings(spark, d)).select("individual_id", "species")
    habitat = H.habitat_context(habitat_rows(spark, d)).select(
        "individual_id", B.rounded("shelf_fraction").alias("shelf_fraction"),
        B.rounded("depth_median").alias("depth_median"),
    )
    profile = R.risk_profile(range_exposure(spark, d), species, habitat, _facts(spark, d))
    return profile.withColumn("zones", F.array_join("zones", "|"))


ZONE_NAMES = ("Bank", "Bay", "Channel", "Olympic")


@query(
    "zone_to_chunks",
    f"""SELECT request_id, z.name AS sanctuary, count(*) AS n_chunks, CAST(sum(doc_id) AS BIGINT) AS chunk_sum
        FROM (SELECT DISTINCT request_id, name FROM {B.zone_hits_sql(BOXES_SQL)}) z
        JOIN (SELECT doc_id, {list(ZONE_NAMES)!r}[CAST(substr(source, 4) AS INT) % {len(ZONE_NAMES)} + 1] AS s
              FROM documents) ON s = z.name
        GROUP BY ALL""",
)
def _(spark, d):
    """Documents about the zones of every range, as count and sum per range and zone."""
    number = F.substring("source", 4, 9).cast("int") % len(ZONE_NAMES)
    chunks = table(spark, d, "documents").select(
        F.col("doc_id").alias("chunk_id"),
        F.element_at(F.array(*map(F.lit, ZONE_NAMES)), number + 1).alias("sanctuary"),
    )
    totals = {"n_chunks": F.count(F.lit(1)), "chunk_sum": F.sum("chunk_id")}
    found = zone_to_chunks(R.zone_overlap(boxes(spark, d), B.zones(spark)), chunks, totals)
    return found.groupBy("request_id", "sanctuary").agg(
        F.sum("n_chunks").alias("n_chunks"), F.sum("chunk_sum").alias("chunk_sum")
    )
