"""Exact nearest neighbours that leave out most of the gallery: a metric pivot table.

A bounded number of gallery vectors are pivots. Every gallery vector belongs to its
nearest pivot, at a known angle; large cells are cut into rings of that angle. Angles
between unit vectors obey the triangle inequality, so a query at angle ``t`` from a
pivot is at least ``max(0, t - far, near - t)`` from everything in a ring ``near..far``
around it. A search scores some rows of the closest rings first, where queries and rows
meet by ring. The k-th score found there is a bound, and all rings that can still reach it
are scored after that, for a chunk of queries around the same pivots at a time. No result
is lost; where vectors have no structure, no ring can be left out and all pairs are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidewater.functions.ordered import keep_top
from tidewater.operators.similarity import _CHUNK, SCORE_DIGITS, _Best, _block_join, _matrix, _out_schema, _runs
from tidewater.session import stored

_SLACK = 1e-7  # what arccos may lose near 1, in radians
_ROWS = 512  # gallery rows that meet all pivots at once inside a task
_ASKED = 64  # queries that meet all rings at once inside a task
_BOUND_ROWS = 4096  # rows of a ring at most that give the bounds; its other rows are scored later


@dataclass(frozen=True)
class Sizes:
    """What bounds the pivot table.

    ``cell_rows``: vectors per pivot, until there are ``most_pivots`` of them, picked
    from ``sample`` times as many, which the driver holds once.
    ``most_rings``: rings of a cell with more vectors than that. The driver and every
    task hold ``most_pivots`` vectors and ``most_pivots * most_rings`` ring sizes.
    ``block_rows``: least rows of a block of queries and of a part of the gallery (see
    ``similarity._block_join``). ``first``: rings scored first hold this many times ``top``.
    """

    cell_rows: int = 1024
    most_pivots: int = 4096
    sample: int = 4
    most_rings: int = 16
    block_rows: int = 8192
    first: int = 4


@dataclass(frozen=True)
class Rings:
    """Pivot (row of ``pivots``), nearest and farthest angle and vectors of every ring."""

    pivots: np.ndarray
    pivot: np.ndarray
    near: np.ndarray
    far: np.ndarray
    rows: np.ndarray

    def angles(self, vectors: np.ndarray) -> np.ndarray:
        """Angle between each vector and each pivot."""
        return np.arccos(np.clip(vectors @ self.pivots.T, -1, 1))

    def gaps(self, angles: np.ndarray) -> np.ndarray:
        """Least angle between each vector and anything in each ring."""
        angle = angles[:, self.pivot]
        return np.maximum(0, np.maximum(angle - self.far, self.near - angle) - _SLACK)

    def closest(self, angles: np.ndarray, least: int) -> np.ndarray:
        """The rings to score first, as flags: by gap, then by pivot, until they hold ``least`` vectors."""
        gaps = self.gaps(angles) + 1e-9 * angles[:, self.pivot]
        some = min(least, gaps.shape[1])  # no more, since each ring holds a vector
        near = np.argpartition(gaps, some - 1, axis=1)[:, :some]
        order = np.take_along_axis(near, np.argsort(np.take_along_axis(gaps, near, axis=1), axis=1), axis=1)
        before = np.cumsum(self.rows[order], axis=1) - self.rows[order]
        flags = np.zeros(gaps.shape, dtype=bool)
        np.put_along_axis(flags, order, before < least, axis=1)
        return flags

    def within(self, angles: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """The rings that hold, or may hold, anything within the angle ``reach`` of each vector, as flags."""
        reach = reach[:, None] + _SLACK
        return ((angles - reach)[:, self.pivot] <= self.far) & ((angles + reach)[:, self.pivot] >= self.near)

    def all_within(self, angles: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Whether no ring can be left out, by the least and the greatest angle of each vector; false may be true."""
        return (angles.max(axis=1) - reach <= self.far.min()) & (angles.min(axis=1) + reach >= self.near.max())


@dataclass(frozen=True)
class Search:
    """``found`` as :func:`similarity.nearest` returns it; ``asked``: the (query, ring) pairs to score, with the ring's ``rows``.

    A chunk of queries scores the rings of all its members.
    """

    found: DataFrame
    asked: DataFrame


def _spread(vectors: np.ndarray, wanted: int) -> np.ndarray:
    """``wanted`` of the vectors, each the one farthest from those before it; equal ones once."""
    picked = [0]
    nearest = vectors @ vectors[0]
    while len(picked) < wanted:
        far = int(nearest.argmin())
        if nearest[far] > 1 - 1e-12:
            break
        picked.append(far)
        nearest = np.maximum(nearest, vectors @ vectors[far])
    return vectors[picked]


def _pivots(gallery: DataFrame, sizes: Sizes) -> np.ndarray:
    """Unit vectors far from each other, out of a sample of rows that a hash picks.

    There are at most ``most_pivots``, out of ``sample`` times as many.
    """
    whole = gallery.where("embedding is not null")
    n = whole.count()
    wanted = max(1, min(sizes.most_pivots, -(-n // sizes.cell_rows)))
    picked = whole.orderBy(F.xxhash64("image_id", F.lit("pivot")), "image_id").limit(sizes.sample * wanted).select("embedding").toArrow()
    if not picked.num_rows:
        return np.zeros((1, 0))
    vectors = _matrix(picked.column("embedding"))
    vectors = vectors[np.isfinite(vectors).all(axis=1)]
    return _spread(vectors, wanted) if len(vectors) else np.eye(1, vectors.shape[1])


def _celled(gallery: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The gallery with its ``cell`` and the ``angle`` to its pivot; zero vectors, which match nothing, are left out."""
    schema = StructType([*gallery.schema.fields]).add("cell", "integer").add("angle", "double")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # some rows at a time: they meet all pivots in one matrix
        for some in (batch.slice(k, _ROWS) for batch in batches for k in range(0, batch.num_rows, _ROWS)):
            table = pa.Table.from_batches([some])
            vectors = _matrix(table.column("embedding"))
            scores = vectors @ pivots.T
            cell = np.zeros(len(scores), dtype=np.int32)
            angle = np.full(len(scores), np.nan)
            usable = np.isfinite(scores).all(axis=1)
            cell[usable] = scores[usable].argmax(axis=1)
            angle[usable] = np.arccos(np.clip(scores[usable].max(axis=1), -1, 1))
            table = table.append_column("cell", pa.array(cell)).append_column("angle", pa.array(angle))
            yield from table.filter(pa.array(usable)).to_batches()

    return gallery.where("embedding is not null").mapInArrow(assign, schema)


def _ringed(celled: DataFrame, sizes: Sizes) -> DataFrame:
    """Adds ``ring``: cells of many vectors are cut at equal steps between their least and greatest angle."""
    spans = celled.groupBy(F.col("cell").alias("_cell")).agg(
        F.min("angle").alias("_near"),
        (F.max("angle") - F.min("angle")).alias("_span"),
        F.least(F.ceil(F.count(F.lit(1)) / F.lit(sizes.cell_rows)), F.lit(sizes.most_rings)).cast("int").alias("_rings"),
    )
    step = F.floor((F.col("angle") - F.col("_near")) / F.col("_span") * F.col("_rings")).cast("int")
    ring = F.when(F.col("_span") > 0, F.least(step, F.col("_rings") - 1)).otherwise(F.lit(0))
    return celled.join(spans, F.col("cell") == F.col("_cell")).withColumn("ring", ring).drop("_cell", "_near", "_span", "_rings")


def search(
    queries: DataFrame,
    gallery: DataFrame,
    top: int,
    *,
    by: str = "image",
    scope: list[str] | None = None,
    hide: str | None = None,
    score_digits: int = SCORE_DIGITS,
    sizes: Sizes = Sizes(),
) -> Search:
    """Arguments and result as of :func:`similarity.nearest`, exact for every input."""
    scope = scope or []
    held = stored(gallery.select(*scope, "image_id", "individual_id", "embedding"), "pivots")
    pivots = _pivots(held, sizes)
    rows = stored(_ringed(_celled(held, pivots), sizes), "pivots")
    stats = (
        rows.groupBy("cell", "ring")
        .agg(F.min("angle").alias("near"), F.max("angle").alias("far"), F.count(F.lit(1)).alias("rows"))
        .orderBy("cell", "ring")
        .toArrow()
    )
    n_rows = stats.column("rows").to_numpy()
    rings = Rings(
        pivots,
        stats.column("cell").to_numpy(),
        stats.column("near").to_numpy(),
        stats.column("far").to_numpy(),
        n_rows,
    )
    number = {(c, r): i for i, (c, r) in enumerate(zip(stats.column("cell").to_pylist(), stats.column("ring").to_pylist()))}
    asked_cols = [*scope, "query_id", "embedding", *(["hide_id"] if hide else [])]
    asking = queries.select(*asked_cols).where("embedding is not null")
    request = StructType().add("query_id", asking.schema["query_id"].dataType).add("at", "integer").add("rows", "long")

    def reach(bound: np.ndarray) -> np.ndarray:
        """The angle in which all lies that can reach a bound; without one, everything."""
        least = np.clip(bound - 2 * 10.0**-score_digits - 1e-12, -1, 1)
        return np.where(np.isnan(bound), np.pi, np.arccos(least))

    def angled(table: pa.Table, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Angles of some queries at a time, which bounds the table of angles, and whether they have any."""
        for start in range(0, table.num_rows if len(rings.rows) else 0, rows):
            vectors = _matrix(table.column("embedding").slice(start, rows))
            usable = np.isfinite(vectors).all(axis=1)
            yield rings.angles(np.where(usable[:, None], vectors, 0.0)), usable

    def flagged(table: pa.Table, bounded: bool) -> Iterator[np.ndarray]:
        """Flags by query of the rings to score: the closest, or with bounds those that can reach them."""
        for k, (angles, usable) in enumerate(angled(table, _ASKED)):
            if bounded:
                flags = rings.within(angles, reach(table.column("bound").slice(_ASKED * k, _ASKED).to_numpy()))
            else:
                flags = rings.closest(angles, sizes.first * top)
            yield flags & usable[:, None]

    def requests(frame: DataFrame, bounded: bool) -> DataFrame:
        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for k, flags in enumerate(flagged(pa.Table.from_batches([whole]), bounded)):
                    query, ring = np.nonzero(flags)
                    yield pa.RecordBatch.from_arrays(
                        [whole.column("query_id").take(pa.array(_ASKED * k + query)), pa.array(ring, pa.int32()), pa.array(rings.rows[ring], pa.int64())],
                        ["query_id", "at", "rows"],
                    )

        return frame.mapInArrow(ask, request)

    def needed(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """An order of queries that puts those around the same pivots together, and the rings to score by chunk."""
        bound = table.column("bound").to_numpy()
        away = reach(bound)
        place, every = np.zeros(table.num_rows, dtype=np.int64), np.zeros(table.num_rows, dtype=bool)
        for k, (angles, usable) in enumerate(angled(table, _ROWS)):
            at = slice(_ROWS * k, _ROWS * k + len(usable))
            place[at] = np.where(usable, angles.argmin(axis=1), -1)
            every[at] = usable & rings.all_within(angles, away[at])
        order = np.lexsort((place, every))
        flags = np.zeros((-(-table.num_rows // _CHUNK), len(rings.rows)), dtype=bool)
        for k, chunk in enumerate(flags):
            at = order[_CHUNK * k : _CHUNK * (k + 1)]
            if every[at].any():
                chunk[:] = True
                continue
            for some in flagged(table.take(pa.array(at)), bounded=True):
                chunk |= some.any(axis=0)
                if chunk.all():
                    break
        return order, flags

    table = rows.sparkSession.createDataFrame(
        [(int(c), int(r), i) for (c, r), i in number.items()], "t_cell int, t_ring int, at int"
    )
    placed = rows.join(F.broadcast(table), (F.col("cell") == F.col("t_cell")) & (F.col("ring") == F.col("t_ring"))).drop("t_cell", "t_ring")

    def routed(frame: DataFrame) -> DataFrame:
        """The queries with ``at``, once for each of their closest rings."""

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for k, flags in enumerate(flagged(pa.Table.from_batches([whole]), bounded=False)):
                    query, ring = np.nonzero(flags)
                    some = whole.take(pa.array(_ASKED * k + query))
                    yield some.append_column("at", pa.array(ring, pa.int32()))

        return frame.mapInArrow(route, StructType([*frame.schema.fields]).add("at", "integer"))

    own = ["query_id", *(["individual_id"] if by == "individual" else [])]
    tie = "individual_id" if by == "individual" else "image_id"
    near = _ring_join(routed(asking), placed, top, by, scope, hide, score_digits).select(*own, "score")
    if by == "individual":
        near = near.groupBy(*own).agg(F.max("score").alias("score"))
    last = F.try_element_at(F.sort_array(F.collect_list("score"), False), F.lit(top))
    bounds = near.groupBy(F.col("query_id").alias("_query")).agg(last.alias("bound"))
    bounded = stored(asking.join(bounds, F.col("query_id") == F.col("_query"), "left").drop("_query"), "pivots")
    found = _block_join(bounded, placed, top, by, scope, hide, sizes.block_rows, score_digits, int(n_rows.sum()), needed)
    if by == "individual":
        best = Window.partitionBy("query_id", "individual_id").orderBy(F.col("score").desc(), "image_id")
        found = keep_top(found, best, 1).drop("rank")
    found = keep_top(found, Window.partitionBy("query_id").orderBy(F.col("score").desc(), tie), top)
    return Search(found, requests(asking, bounded=False).unionByName(requests(bounded, bounded=True)))


def _ring_join(
    routed: DataFrame, placed: DataFrame, top: int, by: str, scope: list[str], hide: str | None, digits: int
) -> DataFrame:
    """The best ``top`` of every query in some rows of each ring it was routed to.

    A task holds at most ``_BOUND_ROWS`` rows of a ring, and lets the ring's queries stream past.
    """
    out = _out_schema(routed, placed)
    keys = [*[f"_scope{i}" for i in range(len(scope))], "at"]
    vector = routed.schema["embedding"].dataType
    if vector != placed.schema["embedding"].dataType:
        vector = "array<double>"
    kinds = {"query_id": out["query_id"].dataType, "image_id": out["image_id"].dataType, "individual_id": out["individual_id"].dataType}
    if hide:
        kinds["hide_id"] = routed.schema["hide_id"].dataType

    def side(df: DataFrame, number: int, names: tuple[str, ...]) -> DataFrame:
        return df.select(
            *[F.col(c).alias(f"_scope{i}") for i, c in enumerate(scope)],
            "at",
            F.lit(number).alias("_side"),
            *[(F.col(c) if c in names else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()],
            F.col("embedding").cast(vector).alias("embedding"),
        )

    both = side(placed, 0, ("image_id", "individual_id")).unionByName(side(routed, 1, ("query_id", "hide_id")))
    schema = to_arrow_schema(out)
    asked = [c for c in ("query_id", "hide_id", "embedding") if c in both.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for now, part in _runs(pa.Table.from_batches([batch]), [*keys, "_side"]):
                if now[:-1] != key:
                    key, held = now[:-1], []
                if now[-1] == 0:
                    if (room := _BOUND_ROWS - sum(x.num_rows for x in held)) > 0:
                        held.append(part.slice(0, room))
                    continue
                if not held:
                    continue
                best = _Best(part.select(asked), top, by, hide, digits)
                best.add(pa.concat_tables(held))
                yield from best.table(schema).to_batches()

    return both.repartition(*keys).sortWithinPartitions(*keys, "_side").mapInArrow(run, out)
