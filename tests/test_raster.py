"""Box sums, zones and coverage against direct computations."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidewater.functions.geo import mercator_x, mercator_y
from tidewater.operators import raster as R
from tidewater.operators import tiles as T
from tidewater.operators.corpus import zone_to_chunks
from tidewater.session import stored
from tidewater.sources import scans
from tidewater.sources.schemas import RASTER_TILES

GRID = (0.0, 0.0, 1000.0)


@pytest.fixture(scope="module")
def cells_rows():
    rng = random.Random(4)
    spots = {(rng.randrange(-40, 300), rng.randrange(-40, 300)) for _ in range(1500)}
    return [(2024, c, r, rng.randrange(0, 9)) for c, r in spots]


@pytest.fixture(scope="module")
def cells(spark, cells_rows):
    return spark.createDataFrame(cells_rows, "year int, col long, row long, value long")


@pytest.mark.parametrize("edges", [(1, 4, 16, 64), (1, 2), (1,)])
def test_box_sums_equal_brute_force(spark, cells, cells_rows, edges):
    rng = random.Random(9)
    boxes = [(0, -40, 299, -40, 299), (1, 5, 5, 7, 7), (2, 9, 8, 0, 5)]
    for i in range(3, 40):
        a, b = sorted(rng.randrange(-45, 305) for _ in range(2))
        c, d = sorted(rng.randrange(-45, 305) for _ in range(2))
        boxes.append((i, a, b, c, d))
    df = spark.createDataFrame(
        [(i, 2024, *b) for i, *b in boxes],
        "request_id long, year int, c0 long, c1 long, r0 long, r1 long",
    )
    got = {
        r.request_id: (r.trafficked_cells, r.total_transits, r.busiest_cell)
        for r in R.box_cell_sums(df, cells, edges).collect()
    }
    want = {}
    for i, a, b, c, d in boxes:
        inside = [v for _, x, y, v in cells_rows if v and a <= x <= b and c <= y <= d]
        if inside:
            want[i] = (len(inside), sum(inside), max(inside))
    assert got == want
    listed = R.box_cells(df, cells).groupBy("request_id").agg(F.sum("value").alias("t")).collect()
    assert {r.request_id: r.t for r in listed} == {i: t for i, (_, t, _) in want.items()}


def test_a_cell_counts_if_its_centre_is_in_the_box(spark):
    lon = lambda x: float(spark.range(1).select(F.degrees(F.lit(x / 6378137.0))).first()[0])
    box = spark.createDataFrame(
        [(1, 2024, -0.001, 0.0, lon(499.0), lon(1501.0))],
        "request_id long, year int, lat_min double, lat_max double, lon_min double, lon_max double",
    )
    row = R.cell_range(box, *GRID).first()
    assert (row.c0, row.c1) == (0, 1)  # centres at 500 and 1500


def test_tiles_to_cells_skips_nodata(spark):
    tiles = spark.createDataFrame(
        [
            (2024, 1, 0.0, 0.0, 100.0, 2, 2, [0, 7, 0, 3], 3857),
            (2024, 2, 200.0, 0.0, 100.0, 2, 2, [0, 0, 0, 0], 3857),
        ],
        RASTER_TILES,
    )
    out = {(r.x, r.y): r.value for r in scans.raster_cells(tiles).collect()}
    assert out == {(150.0, -50.0): 7, (150.0, -150.0): 3}
    check = scans.raster_grid_check(tiles, size=2).first()
    assert all((check.srid_ok, check.scale_ok, check.size_ok, check.pixels_ok, check.aligned_ok))
    bad = tiles.withColumn("srid", F.lit(4326))
    assert scans.raster_grid_check(bad, size=2).first().srid_ok is False


def test_overlapping_tiles_count_a_cell_once(spark):
    twice = spark.createDataFrame([(2024, 1, 1, 5), (2024, 1, 1, 5)], "year int, col long, row long, value long")
    assert [tuple(r) for r in R.merge_cells(twice).collect()] == [(2024, 1, 1, 5)]


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def test_ring_overlap(spark):
    zones = scans.zone_rings(
        spark.createDataFrame(
            [
                ("triangle", 1, ring((0, 0), (10, 0), (0, 10))),
                ("parts", 1, ring((20, 0), (21, 0), (21, 1), (20, 1))),
                ("parts", 2, ring((23, 0), (24, 0), (24, 1), (23, 1))),
                ("sliver", 1, ring((-30, -5), (-10, -5.1), (-10, -4.9))),
            ],
            "name string, part_id int, ring array<struct<x:double,y:double>>",
        )
    )
    boxes = spark.createDataFrame(
        [
            (1, 1.0, 2.0, 1.0, 2.0),  # inside the triangle
            (2, 8.0, 9.0, 8.0, 9.0),  # in its box, outside the triangle
            (3, -5.0, 30.0, -5.0, 15.0),  # holds the triangle
            (4, 0.5, 0.6, 20.5, 23.5),  # both parts of one zone
            (5, -6.0, -4.0, -21.0, -20.0),  # crossed by an edge, no corner inside
            (6, 40.0, 41.0, 40.0, 41.0),
        ],
        "request_id long, lat_min double, lat_max double, lon_min double, lon_max double",
    )
    out = {r.request_id: r.zones for r in R.zone_overlap(boxes, zones).collect()}
    assert out == {1: ["triangle"], 3: ["triangle"], 4: ["parts"], 5: ["sliver"]}


def tile_rows(cells, size, scale=1000.0, keep_calm=()):
    """Tiles of all cells that have a value, and calm ones where asked."""
    places = {(year, c // size, r // size) for year, c, r, _ in cells} | set(keep_calm)
    at = {}
    for year, c, r, v in cells:
        at[year, c, r] = max(v, at.get((year, c, r), 0))
    return [
        (year, i, tx * size * scale, -ty * size * scale, scale, size, size,
         [at.get((year, tx * size + c, ty * size + r), 0) for r in range(size) for c in range(size)], 3857)
        for i, (year, tx, ty) in enumerate(sorted(places))
    ]


@pytest.mark.parametrize("size, edges", [(16, (1, 4, 16)), (8, (1, 2)), (20, (1, 4))])
def test_tiles_equal_brute_force(spark, cells_rows, size, edges):
    rng = random.Random(size)
    rows = [r for r in cells_rows if not (r[1] // size == 3 and r[2] // size == 2)]  # a hole of one tile
    tiles = spark.createDataFrame(tile_rows(rows, size), RASTER_TILES)
    twice = tiles.unionByName(tiles.where("rid % 3 = 0").withColumn("pixels", F.transform("pixels", lambda p: p - 1)))
    images = T.tile_images(twice, GRID, size)
    boxes = [(0, -40, 299, -40, 299), (1, 5, 5, 7, 7), (2, 9, 8, 0, 5), (3, 3 * size, 3 * size + 2, 2 * size, 2 * size + 2), (4, 9000, 9001, 0, 1)]
    for i in range(5, 60):
        a, b = sorted(rng.randrange(-60, 330) for _ in range(2))
        c, d = sorted(rng.randrange(-60, 330) for _ in range(2))
        boxes.append((i, a, b, c, d))
    df = spark.createDataFrame([(i, 2024, *b) for i, *b in boxes], "request_id long, year int, c0 long, c1 long, r0 long, r1 long")
    got = {r.request_id: (r.trafficked_cells, r.total_transits, r.busiest_cell) for r in T.box_sums(df, images, size, edges, part_rows=9).collect()}
    busy = {(c // size, r // size) for _, c, r, v in rows if v}
    want = {}
    for i, a, b, c, d in boxes:
        if any(a <= x * size + size - 1 and b >= x * size and c <= y * size + size - 1 and d >= y * size for x, y in busy) and a <= b and c <= d:
            inside = [v for _, x, y, v in rows if v and a <= x <= b and c <= y <= d]
            want[i] = (len(inside), sum(inside), max(inside, default=0))
    assert got == want and 3 not in got and 4 not in got


def test_outside_coverage_is_not_calm(spark):
    cells = [(2024, 0, 0, 4), (2024, 9, 9, 6), (2023, 0, 0, 1)]
    images = T.tile_images(spark.createDataFrame(tile_rows(cells, 4), RASTER_TILES), GRID, 4)
    zones = scans.zone_rings(
        spark.createDataFrame(
            [("a", 1, ring((0.0, -1.0), (1.0, -1.0), (1.0, 0.0), (0.0, 0.0)))],
            "name string, part_id int, ring array<struct<x:double,y:double>>",
        )
    )
    deg = 180 / 3.141592653589793 / 6378137.0
    box = lambda i, year, a, b: (i, year, -b * deg, -a * deg, a * deg, b * deg)
    requests = spark.createDataFrame(
        [
            box(1, 2024, 100.0, 900.0),  # one busy cell
            box(2, 2024, 2100.0, 3900.0),  # a calm edge of a tile
            box(3, 2024, 50000.0, 60000.0),  # outside
            box(4, 1999, 100.0, 900.0),  # unknown year
            box(5, 2024, 5100.0, 6900.0),  # between the tiles, where none is
        ],
        "request_id long, year int, lat_min double, lat_max double, lon_min double, lon_max double",
    )
    out = {r.request_id: r for r in T.vessel_traffic(requests, images, zones, GRID, 4).collect()}
    assert (out[1].ok, out[1].total_transits, out[1].zones) == (True, 4, ["a"])
    assert "4 vessel transits (2024) over 1 cells" in out[1].summary and "in zone(s): a" in out[1].summary
    assert out[1].citations[0].locator.startswith("bbox(0.000898, -0.008085, 0.008085, -0.000898")
    assert (out[2].ok, out[2].total_transits, out[2].busiest_cell, out[2].mean_per_cell) == (True, 0, 0, 0.0)
    for i in (3, 5):
        assert (out[i].ok, out[i].summary, out[i].citations) == (False, "Region outside AIS coverage", [])
    assert out[4].ok is False and out[4].summary == "No AIS data for year 1999 (have 2023, 2024)"


def test_wrong_tile_size_is_an_error(spark):
    tiles = spark.createDataFrame(tile_rows([(2024, 0, 0, 4)], 4), RASTER_TILES)
    with pytest.raises(Exception, match="has not 8 x 8 pixels"):
        T.tile_images(tiles, GRID, 8).collect()


def test_mercator(spark):
    row = spark.range(1).select(mercator_x(F.lit(180.0)).alias("x"), mercator_y(F.lit(0.0)).alias("y")).first()
    assert row.x == pytest.approx(20037508.342789244) and row.y == pytest.approx(0.0, abs=1e-6)


def broadcast_sides(df):
    """What the plan sends through the driver, as the text of each broadcast's subtree."""
    lines = df._jdf.queryExecution().sparkPlan().toString().split("\n")
    return [line for line in lines if "BroadcastHashJoin" in line]


def wide_boxes(spark):
    """A few boxes of many tiles each, in a file that Spark takes for small."""
    boxes = spark.range(50).select(
        F.col("id").alias("request_id"), F.lit(2024).alias("year"), F.lit(0).cast("long").alias("c0"), F.lit(999).cast("long").alias("c1"),
        F.lit(0).cast("long").alias("r0"), F.lit(999).cast("long").alias("r1"), F.lit(-80.0).alias("lat_min"), F.lit(80.0).alias("lat_max"),
        F.lit(-170.0).alias("lon_min"), F.lit(170.0).alias("lon_max"),
    )
    return stored(boxes, "wide")


def test_boxes_laid_on_tiles_are_not_broadcast(spark, cells):
    out = R.box_cells(wide_boxes(spark), cells)
    assert broadcast_sides(out) == []
    assert out.count() == 50 * cells.where("value <> 0 and col >= 0 and row >= 0").count()


def test_requests_and_images_are_not_broadcast(spark, cells_rows):
    images = stored(T.tile_images(spark.createDataFrame(tile_rows(cells_rows, 16), RASTER_TILES), GRID, 16), "tiles")
    zones = scans.zone_rings(spark.createDataFrame([("a", 1, ring((0, 0), (1, 0), (0, 1)))], "name string, part_id int, ring array<struct<x:double,y:double>>"))
    joins = broadcast_sides(T.vessel_traffic(wide_boxes(spark), images, zones, GRID, 16))
    assert joins and [line for line in joins if "BuildLeft" in line] == []


def test_zones_go_to_the_boxes_and_not_the_boxes_to_the_zones(spark):
    zones = scans.zone_rings(
        spark.createDataFrame(
            [("a", 1, ring((0, 0), (10, 0), (0, 10))), ("b", 1, ring((40, 0), (41, 0), (41, 1), (40, 1)))],
            "name string, part_id int, ring array<struct<x:double,y:double>>",
        )
    )
    few, many = (R.zone_overlap(wide_boxes(spark), zones, few_edges=n) for n in (31, 30))  # 3 edges in 9 cells of the grid, 4 in one
    assert [("BuildRight" in x) for x in broadcast_sides(few)] == [True]
    assert broadcast_sides(many) == []
    for out in (few, many):
        assert {(r.request_id, *r.zones) for r in out.collect()} == {(i, "a", "b") for i in range(50)}
    assert R.zone_overlap(wide_boxes(spark), zones.limit(0)).collect() == []


def test_totals_of_chunks_per_zone_equal_those_over_all_chunks(spark):
    overlaps = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, ["c"]), (None, ["b"])], "request_id long, zones array<string>")
    chunks = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)] + [(50, None), (None, "a")], "chunk_id long, sanctuary string")
    totals = {"n": F.count(F.lit(1)), "s": F.sum("chunk_id")}
    listed = zone_to_chunks(overlaps, chunks)
    assert listed.count() == 11 + 10 + 11 + 10
    want = {tuple(r) for r in listed.groupBy("request_id", "sanctuary").agg(F.count(F.lit(1)), F.sum("chunk_id")).collect()}
    got = zone_to_chunks(overlaps, chunks, totals).select("request_id", "sanctuary", "n", "s").collect()
    assert len(got) == 4 and {tuple(r) for r in got} == want
