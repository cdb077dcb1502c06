"""Boxes over yearly traffic rasters and protected zones, for all boxes at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.geo import mercator_x, mercator_y

# fixed values: years with a traffic raster, and the year used when none is given
RASTER_YEARS = (2022, 2023, 2024, 2025)
DEFAULT_YEAR = 2024

EDGES = (1, 4, 16, 64, 256, 1024)  # edge lengths of summed rectangles, in cells

RANGE = ("c0", "c1", "r0", "r1")


def cell_range(boxes: DataFrame, x0: float, y0: float, scale: float) -> DataFrame:
    """Index range of the cells whose centre lies in the projected box.

    ``x0, y0`` is the upper left corner of the shared grid. An empty range has
    ``c0 > c1`` or ``r0 > r1``.
    """
    low = lambda c: F.ceil(c / F.lit(scale) - 0.5).cast("long")
    high = lambda c: F.floor(c / F.lit(scale) - 0.5).cast("long")
    return boxes.withColumns(
        {
            "c0": low(mercator_x(F.col("lon_min")) - x0),
            "c1": high(mercator_x(F.col("lon_max")) - x0),
            "r0": low(F.lit(y0) - mercator_y(F.col("lat_max"))),
            "r1": high(F.lit(y0) - mercator_y(F.col("lat_min"))),
        }
    )


def _div(c: Column, size: Column | int) -> Column:
    return F.floor(c / size).cast("long")


def _code(start: Column, level: int | Column) -> Column:
    """One number for a run of cells: its first cell and the position of its length in the edges."""
    return start * 16 + level


def segments(low: Column, high: Column, edges: Sequence[int]) -> Column:
    """Cut the cells ``low .. high`` into aligned runs, as long as possible (run codes).

    At each edge length the loose ends up to the next longer edge are cut off on
    both sides, so the number of runs grows with the logarithm of the width.
    """
    levels = F.array(
        *[
            F.struct(
                F.lit(i).cast("long").alias("level"),
                F.lit(edge).cast("long").alias("edge"),
                F.lit(wider).cast("long").alias("next"),
            )
            for i, (edge, wider) in enumerate(zip(edges, (*edges[1:], 1 << 40)))
        ]
    )
    nothing = F.array().cast("array<bigint>")

    def runs(start: Column, stop: Column, level: Column) -> Column:
        starts = F.sequence(start, stop - level["edge"], level["edge"])
        coded = F.transform(starts, lambda s: _code(s, level["level"]))
        return F.when(stop > start, coded).otherwise(nothing)

    def cut(acc: Column, level: Column) -> Column:
        up = F.least(_div(acc["a"] + level["next"] - 1, level["next"]) * level["next"], acc["b"])
        down = F.greatest(_div(acc["b"], level["next"]) * level["next"], up)
        return F.struct(
            up.alias("a"),
            down.alias("b"),
            F.concat(acc["runs"], runs(acc["a"], up, level), runs(down, acc["b"], level)).alias("runs"),
        )

    start = F.struct(low.alias("a"), (high + 1).alias("b"), nothing.alias("runs"))
    return F.aggregate(levels, start, cut, lambda acc: acc["runs"])


def pieces(boxes: DataFrame, edges: Sequence[int]) -> DataFrame:
    """Every box as a few disjoint rectangles: its column runs times its row runs."""
    flat = boxes.where("c0 <= c1 and r0 <= r1").select(
        "request_id",
        "year",
        segments(F.col("c0"), F.col("c1"), edges).alias("_x"),
        segments(F.col("r0"), F.col("r1"), edges).alias("_y"),
    )
    # the outer form keeps the optimizer from copying the cuts into a filter
    wide = flat.select("request_id", "year", "_y", F.explode_outer("_x").alias("x"))
    return wide.select("request_id", "year", "x", F.explode_outer("_y").alias("y"))


def rectangle_sums(values: DataFrame, edges: Sequence[int]) -> DataFrame:
    """Count, sum and maximum of every aligned rectangle of ``year, col, row, n, total, peak``.

    Columns are summed first, rows after, each with partial aggregation; the
    coarse rectangles of a busy area are combined before the shuffle.
    """
    totals = [F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("peak").alias("peak")]

    def codes(at: str) -> Column:
        return F.explode(
            F.array(*[_code(_div(F.col(at), edge) * edge, i) for i, edge in enumerate(edges)])
        )

    single = values.select("year", codes("col").alias("x"), "row", "n", "total", "peak")
    columns = single.groupBy("year", "x", "row").agg(*totals)
    both = columns.select("year", "x", codes("row").alias("y"), "n", "total", "peak")
    return both.groupBy("year", "x", "y").agg(*totals)


def _single(cells: DataFrame) -> DataFrame:
    value = F.col("value").cast("long")
    return cells.where("value <> 0").select(
        "year", "col", "row", F.lit(1).cast("long").alias("n"), value.alias("total"), value.alias("peak")
    )


def box_cell_sums(
    boxes: DataFrame, cells: DataFrame, edges: Sequence[int] = EDGES
) -> DataFrame:
    """Count, sum and maximum over the cells with traffic in each box.

    boxes: ``request_id, year, c0, c1, r0, r1``; cells: ``year, col, row, value``,
    one row per cell and year. A box without such cells has no row. A box meets
    summed rectangles by an equi join, not its cells, so a wide box over a busy
    area costs about as much as a small one.
    """
    return (
        pieces(boxes, edges)
        .join(rectangle_sums(_single(cells), edges).hint("merge"), ["year", "x", "y"])
        .groupBy("request_id", "year")
        .agg(
            F.sum("n").alias("trafficked_cells"),
            F.sum("total").alias("total_transits"),
            F.max("peak").alias("busiest_cell"),
        )
        .withColumn("mean_per_cell", F.col("total_transits") / F.col("trafficked_cells"))
    )


def box_cells(boxes: DataFrame, cells: DataFrame, size: int = 16) -> DataFrame:
    """The cells in each box: boxes and cells meet on tiles of ``size`` cells.

    The join is a sort-merge join by hint: Spark takes a box with all its tiles for one row
    when it guesses sizes, and would send the boxes of a wide table through the driver.
    """
    tiles = lambda a, b: F.explode(F.sequence(_div(F.col(a), size), _div(F.col(b), size)))
    left = (
        boxes.where("c0 <= c1 and r0 <= r1")
        .select("request_id", "year", *RANGE)
        .withColumn("_tx", tiles("c0", "c1"))
        .withColumn("_ty", tiles("r0", "r1"))
    )
    right = cells.where("value <> 0").withColumns(
        {"_tx": _div(F.col("col"), size), "_ty": _div(F.col("row"), size)}
    )
    inside = F.col("col").between(F.col("c0"), F.col("c1")) & F.col("row").between(
        F.col("r0"), F.col("r1")
    )
    return left.join(right.hint("merge"), ["year", "_tx", "_ty"]).where(inside).drop("_tx", "_ty", *RANGE)


def merge_cells(cells: DataFrame) -> DataFrame:
    """One value per cell and year where tiles overlap."""
    return cells.groupBy("year", "col", "row").agg(F.max("value").alias("value"))


def ring_edges(ring: Column) -> Column:
    """The edges of a ring, the closing one included."""
    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(
        ring,
        following,
        lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")),
    )


def edge_meets_box(e: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """The edge touches the box: their extents meet and the corners are not all on one side of it."""
    side = lambda x, y: (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
    sides = [side(x, y) for x in (x0, x1) for y in (y0, y1)]
    return (
        (F.least(e["x1"], e["x2"]) <= x1) & (F.greatest(e["x1"], e["x2"]) >= x0)
        & (F.least(e["y1"], e["y2"]) <= y1) & (F.greatest(e["y1"], e["y2"]) >= y0)
        & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)
    )


def point_in_ring(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd test of a point that no edge touches."""
    crosses = lambda e: F.when(
        (e["y1"] > y) != (e["y2"] > y), x < e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])
    ).otherwise(F.lit(False))
    return F.aggregate(edges, F.lit(False), lambda odd, e: odd != crosses(e))


FEW_EDGES = 100_000  # zones of so many ring edges travel to the boxes


def zone_overlap(boxes: DataFrame, zones: DataFrame, grid: int = 5, few_edges: int = FEW_EDGES) -> DataFrame:
    """Sorted names of the zones each box meets (``request_id, zones``), boxes with a hit only.

    Both sides are laid on a grid of ``grid`` degrees and met by an equi join;
    the box columns cut the pairs, the ring test decides. The edges of the zones are
    counted first: up to ``few_edges`` are broadcast, more are shuffled. The boxes never
    go through the driver, however small Spark takes them before they are laid out.
    """
    cells = lambda a, b: F.explode(
        F.sequence(F.floor(F.col(a) / grid).cast("int"), F.floor(F.col(b) / grid).cast("int"))
    )
    left = (
        boxes.select("request_id", "lat_min", "lat_max", "lon_min", "lon_max")
        .withColumn("_gx", cells("lon_min", "lon_max"))
        .withColumn("_gy", cells("lat_min", "lat_max"))
    )
    right = (
        zones.withColumn("_edges", ring_edges(F.col("ring")))
        .withColumn("_gx", cells("xmin", "xmax"))
        .withColumn("_gy", cells("ymin", "ymax"))
    )
    corners = [F.col(c) for c in ("lon_min", "lon_max", "lat_min", "lat_max")]
    meets = F.exists("_edges", lambda e: edge_meets_box(e, *corners)) | point_in_ring(
        F.col("_edges"), F.col("lon_min"), F.col("lat_min")
    )
    # a pair that shares several grid cells is tested in the first of them only
    first = (
        F.col("_gx") == F.floor(F.greatest("lon_min", "xmin") / grid)
    ) & (F.col("_gy") == F.floor(F.greatest("lat_min", "ymin") / grid))
    touching = (
        (F.col("lon_min") <= F.col("xmax")) & (F.col("lon_max") >= F.col("xmin"))
        & (F.col("lat_min") <= F.col("ymax")) & (F.col("lat_max") >= F.col("ymin"))
    )
    edges = right.agg(F.sum(F.size("_edges"))).first()[0] or 0
    right = F.broadcast(right) if edges <= few_edges else right.hint("merge")
    return (
        left.join(right, ["_gx", "_gy"])
        .where(touching & first)
        .where(meets)
        .groupBy("request_id")
        .agg(F.array_sort(F.collect_set("name")).alias("zones"))
    )


def busy_cells(cells: DataFrame, year: int, threshold: int = 100) -> DataFrame:
    """Cells of one year with at least ``threshold`` transits."""
    return cells.where((F.col("year") == year) & (F.col("value") >= threshold))


def risk_profile(
    exposure: DataFrame, species: DataFrame, habitat: DataFrame, facts: DataFrame
) -> DataFrame:
    """Numbers of the risk chain, one row per individual: traffic, zones, habitat, facts card.

    It states figures only and draws no verdict. ``facts`` is keyed by species.
    """
    return (
        exposure.select("individual_id", "total_transits", "zones")
        .join(species, "individual_id")
        .join(habitat, "individual_id", "left")
        .join(facts, "species", "left")
    )
