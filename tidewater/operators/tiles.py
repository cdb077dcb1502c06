"""Boxes over tiled rasters by summed-area tables.

Every tile carries integral images of its counts and values, so that any rectangle in
it costs four lookups each; maxima come from a table of all rectangles with edges of
powers of two, which a task makes for a tile that it has. A box reads the tiles that
its border crosses; the tiles wholly inside it are cells of a coarser raster, whose
aligned rectangles are summed once for all boxes. The tiles that exist are the
coverage: a box that meets none is outside, one that meets a calm tile has no traffic.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.contract import answer_all, citation
from tidewater.functions.geo import point_box
from tidewater.operators.raster import EDGES, cell_range, pieces, rectangle_sums, zone_overlap

IMAGES = (
    "year int, tx long, ty long, n long, total long, peak long, "
    "counts array<int>, sums array<bigint>, pixels array<int>"
)
PIECE_SUMS = "request_id {id}, year int, n long, total long, peak long"


def _integral(values: np.ndarray) -> np.ndarray:
    return np.pad(values.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))


def tile_images(tiles: DataFrame, grid: tuple[float, float, float], size: int) -> DataFrame:
    """The columns of ``IMAGES``, one row per tile with traffic.

    tiles: ``year, ulx, uly, pixels``, squares of ``size`` cells on the grid ``x0, y0,
    scale``; ``raster_grid_check`` tells whether they are. ``tx, ty`` is the place of a tile
    among all. Tiles at one place are merged, the larger value of a cell counts; 0 and null
    are no traffic. Tiles without traffic are left out, as if they were absent.
    """
    x0, y0, scale = grid
    placed = tiles.select(
        "year",
        F.round((F.col("ulx") - x0) / (scale * size)).cast("long").alias("tx"),
        F.round((F.lit(y0) - F.col("uly")) / (scale * size)).cast("long").alias("ty"),
        "pixels",
    )
    kinds = (pa.int32(), pa.int64(), pa.int64())

    def images(key: tuple[pa.Scalar, ...], same: pa.Table) -> pa.Table:
        lists = same.column("pixels").combine_chunks().drop_null()
        values = np.nan_to_num(lists.flatten().to_numpy(zero_copy_only=False)).astype(np.int64)
        if (lists.value_lengths().to_numpy(zero_copy_only=False) != size * size).any():
            raise ValueError(f"tile {key} has not {size} x {size} pixels")
        pixels = values.reshape(-1, size, size).max(axis=0, initial=0)
        counts, sums = _integral(pixels != 0), _integral(pixels)
        one = lambda value, kind: pa.array([value], kind)
        return pa.table(
            [one(k.as_py(), kind) for k, kind in zip(key, kinds)]
            + [one(int(x), pa.int64()) for x in (counts[-1, -1], sums[-1, -1], pixels.max())]
            + [
                one(counts.ravel().astype(np.int32), pa.list_(pa.int32())),
                one(sums.ravel(), pa.list_(pa.int64())),
                one(pixels.ravel().astype(np.int32), pa.list_(pa.int32())),
            ],
            names=[x.split()[0] for x in IMAGES.split(", ")],
        )

    return placed.groupBy("year", "tx", "ty").applyInArrow(images, IMAGES).where("n > 0")


class Maxima:
    """Maximum of any rectangle of a tile from four of those with edges of powers of two."""

    def __init__(self, pixels: np.ndarray):
        levels = max(1, len(pixels).bit_length())
        rows = [pixels]
        for k in range(levels - 1):
            rows.append(self._doubled(rows[-1], 1 << k))
        self.tables = np.empty((levels, levels, *pixels.shape), dtype=pixels.dtype)
        for i, row in enumerate(rows):
            self.tables[i, 0] = row
            for k in range(levels - 1):
                self.tables[i, k + 1] = self._doubled(self.tables[i, k].T, 1 << k).T

    @staticmethod
    def _doubled(values: np.ndarray, step: int) -> np.ndarray:
        out = values.copy()
        np.maximum(values[:-step], values[step:], out=out[:-step])
        return out

    def of(self, y0: np.ndarray, y1: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
        level = lambda low, high: np.frexp(high - low + 1)[1] - 1
        i, k = level(y0, y1), level(x0, x1)
        ys, xs = (y0, y1 + 1 - (1 << i)), (x0, x1 + 1 - (1 << k))
        corners = [self.tables[i, k, y, x] for y in ys for x in xs]
        return np.maximum(np.maximum(corners[0], corners[1]), np.maximum(corners[2], corners[3]))


def _div(c: Column, size: int) -> Column:
    return F.floor(c / F.lit(size)).cast("long")


def _placed(boxes: DataFrame, images: DataFrame, size: int) -> DataFrame:
    """Boxes with the tiles they touch (``tx0..ty1``) and hold whole (``ix0..iy1``), cut to what exists."""
    extent = images.groupBy("year").agg(
        F.min("tx").alias("_x0"), F.max("tx").alias("_x1"), F.min("ty").alias("_y0"), F.max("ty").alias("_y1")
    )
    cut = boxes.where("c0 <= c1 and r0 <= r1").join(F.broadcast(extent), "year").select(
        "request_id",
        "year",
        F.greatest("c0", F.col("_x0") * size).alias("c0"),
        F.least("c1", F.col("_x1") * size + size - 1).alias("c1"),
        F.greatest("r0", F.col("_y0") * size).alias("r0"),
        F.least("r1", F.col("_y1") * size + size - 1).alias("r1"),
    )
    return cut.where("c0 <= c1 and r0 <= r1").withColumns(
        {
            "tx0": _div(F.col("c0"), size),
            "tx1": _div(F.col("c1"), size),
            "ty0": _div(F.col("r0"), size),
            "ty1": _div(F.col("r1"), size),
            "ix0": _div(F.col("c0") + size - 1, size),
            "ix1": _div(F.col("c1") + 1, size) - 1,
            "iy0": _div(F.col("r0") + size - 1, size),
            "iy1": _div(F.col("r1") + 1, size) - 1,
        }
    )


def _border(placed: DataFrame, size: int) -> DataFrame:
    """One row per tile that a box holds in part, with the rectangle inside it (``x0..y1``)."""
    wide = placed.withColumn("tx", F.explode(F.sequence("tx0", "tx1")))
    inner = F.col("tx").between(F.col("ix0"), F.col("ix1")) & (F.col("iy0") <= F.col("iy1"))
    ends = F.filter(F.array_distinct(F.array("ty0", "ty1")), lambda t: (t < F.col("iy0")) | (t > F.col("iy1")))
    tall = wide.withColumn("ty", F.explode(F.when(inner, ends).otherwise(F.sequence("ty0", "ty1"))))
    low = lambda c, t: F.greatest(F.col(c) - F.col(t) * size, F.lit(0)).cast("int")
    high = lambda c, t: F.least(F.col(c) - F.col(t) * size, F.lit(size - 1)).cast("int")
    return tall.select(
        "request_id", "year", "tx", "ty",
        low("c0", "tx").alias("x0"), high("c1", "tx").alias("x1"), low("r0", "ty").alias("y0"), high("r1", "ty").alias("y1"),
    )


def _looked_up(border: DataFrame, images: DataFrame, size: int, part_rows: int) -> DataFrame:
    """Count, sum and maximum of the rectangle of every row of ``border`` whose tile exists.

    A tile and the rectangles in it meet in one task; those of a busy tile are dealt out
    to several copies of it, ``part_rows`` to each. The images are never broadcast: they are
    many times their size in a file.
    """
    schema = PIECE_SUMS.format(id=border.schema["request_id"].dataType.simpleString())
    parts = border.groupBy("year", "tx", "ty").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(part_rows)).cast("int").alias("_parts")
    )
    asked = images.join(parts.hint("merge"), ["year", "tx", "ty"]).select(
        F.col("year").alias("t_year"), F.col("tx").alias("t_tx"), F.col("ty").alias("t_ty"),
        F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("t_part"), "counts", "sums", "pixels",
    )
    dealt = border.join(parts.hint("merge"), ["year", "tx", "ty"]).withColumn("part", F.pmod(F.xxhash64("request_id"), F.col("_parts")).cast("int"))

    def look(rows: pa.Table, tile: pa.Table) -> pa.Table:
        if not tile.num_rows or not rows.num_rows:
            rows, sums = rows.slice(0, 0), [np.zeros(0, dtype=np.int64)] * 3
        else:
            x0, x1, y0, y1 = (rows.column(c).to_numpy().astype(np.int64) for c in ("x0", "x1", "y0", "y1"))
            image = lambda c, n: tile.column(c).combine_chunks().flatten().to_numpy().astype(np.int64).reshape(n, n)
            area = lambda a: a[y1 + 1, x1 + 1] - a[y0, x1 + 1] - a[y1 + 1, x0] + a[y0, x0]
            peak = Maxima(image("pixels", size)).of(y0, y1, x0, x1)
            sums = [area(image("counts", size + 1)), area(image("sums", size + 1)), peak]
        return pa.table(
            [rows.column("request_id"), rows.column("year"), *[pa.array(x, pa.int64()) for x in sums]],
            names=["request_id", "year", "n", "total", "peak"],
        )

    return (
        dealt.select("request_id", "year", "tx", "ty", "part", "x0", "x1", "y0", "y1")
        .groupBy("year", "tx", "ty", "part")
        .cogroup(asked.groupBy("t_year", "t_tx", "t_ty", "t_part"))
        .applyInArrow(look, schema)
    )


def box_sums(
    boxes: DataFrame, images: DataFrame, size: int, edges: Sequence[int] = EDGES, part_rows: int = 100_000
) -> DataFrame:
    """``request_id, year, trafficked_cells, total_transits, busiest_cell, mean_per_cell``.

    boxes: ``request_id, year, c0, c1, r0, r1`` (cells). A row for every box that meets a
    tile of its year, with zeros where it is calm; none for the others. A box costs about
    as much as its border is long in tiles. ``images`` is read three times: store it.
    """
    placed = _placed(boxes, images, size)
    part = _looked_up(_border(placed, size), images, size, part_rows)
    whole = placed.where("ix0 <= ix1 and iy0 <= iy1").select(
        "request_id", "year",
        F.col("ix0").alias("c0"), F.col("ix1").alias("c1"), F.col("iy0").alias("r0"), F.col("iy1").alias("r1"),
    )
    coarse = images.select("year", F.col("tx").alias("col"), F.col("ty").alias("row"), "n", "total", "peak")
    inner = pieces(whole, edges).join(rectangle_sums(coarse, edges).hint("merge"), ["year", "x", "y"])
    both = part.unionByName(inner.select("request_id", "year", "n", "total", "peak"))
    sums = both.groupBy("request_id", "year").agg(
        F.sum("n").alias("trafficked_cells"), F.sum("total").alias("total_transits"), F.max("peak").alias("busiest_cell")
    )
    mean = F.when(F.col("trafficked_cells") > 0, F.col("total_transits") / F.col("trafficked_cells")).otherwise(F.lit(0.0))
    return sums.withColumn("mean_per_cell", mean)


def vessel_traffic(
    requests: DataFrame,
    images: DataFrame,
    zones: DataFrame,
    grid: tuple[float, float, float],
    size: int,
    edges: Sequence[int] = EDGES,
) -> DataFrame:
    """Traffic and zones per requested box and year, one contract row per request.

    requests: ``request_id, year, lat_min, lat_max, lon_min, lon_max``; images: the stored
    rows of :func:`tile_images`. The raster has the years that its tiles have; another
    year, or a box that meets no tile, gives ``ok = false``.
    """
    have = images.select("year").distinct()
    known = F.sort_array(F.collect_list("year"))
    listed = have.agg(F.array_join(known, ", ").alias("names"), known.alias("years")).alias("have")
    sums = box_sums(cell_range(requests, *grid), images, size, edges).drop("year")
    overlap = zone_overlap(requests, zones)
    found = (
        sums.join(overlap, "request_id", "left")
        .withColumn("zones", F.coalesce("zones", F.array().cast("array<string>")))
        .withColumn("lane_overlap", F.size("zones") > 0)
    )
    answered = requests.join(found.hint("merge"), "request_id")
    text = F.concat(
        F.format_string(
            "%s vessel transits (%d) over %s cells (mean %.1f/cell, busiest %s)",
            F.format_number("total_transits", 0), F.col("year"),
            F.format_number("trafficked_cells", 0), F.col("mean_per_cell"),
            F.format_number("busiest_cell", 0),
        ),
        F.when(
            F.col("lane_overlap"), F.concat(F.lit("; in zone(s): "), F.array_join("zones", ", "))
        ).otherwise(""),
    )
    corners = [F.round(c, 6) for c in ("lon_min", "lat_min", "lon_max", "lat_max")]
    place = F.format_string("bbox(%.6f, %.6f, %.6f, %.6f)", *corners)
    cites = F.array(citation("ais", F.format_string("transit counts %d", "year"), place, F.col("year")))
    results = answered.select(
        "request_id", "trafficked_cells", "total_transits", "mean_per_cell", "busiest_cell", "zones", "lane_overlap",
        text.alias("summary"), cites.alias("citations"),
    )
    out = answer_all(
        requests.select("request_id", "year"),
        results,
        "request_id",
        "vessel_traffic",
        "Region outside AIS coverage",
    )
    names, years = listed.select("names").scalar(), listed.select("years").scalar()
    unknown = ~F.coalesce(F.array_contains(years, F.col("year")), F.lit(False))
    note = F.format_string("No AIS data for year %d (have %s)", "year", names)
    return out.withColumn("summary", F.when(unknown, note).otherwise(F.col("summary")))


def traffic_at_point(
    points: DataFrame, images: DataFrame, zones: DataFrame, grid: tuple[float, float, float], size: int, **kw
) -> DataFrame:
    """Traffic in a small box around each ``request_id, year, lat, lon``."""
    boxes = points.select("request_id", "year", *point_box(F.col("lat"), F.col("lon")))
    return vessel_traffic(boxes, images, zones, grid, size, **kw)
