"""Exact nearest neighbours as a blocked similarity join, and what follows from it.

Scores of a query table against a gallery are a matrix product. The queries are cut
into a bounded number of blocks by a hash of their id; a task holds a block and lets
the gallery (or one of a few parts of it) stream past in Arrow batches, keeping the
best rows of every query so far. So both sides are copied a bounded number of times,
whatever their size, and no pair of rows is ever written to a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidewater.functions.contract import answer_all, citation
from tidewater.functions.ordered import keep_top
from tidewater.functions.vectors import cosine

# fixed values: candidate images per query, shipped abstain threshold, answer length
CANDIDATE_IMAGES = 50
ABSTAIN_THRESHOLD = 0.54
TOP_INDIVIDUALS = 5

SCORE_DIGITS = 9  # scores are rounded before ranking, so equal vectors tie exactly
_CHUNK = 512  # query rows per product inside a task
_TILE = 1024  # gallery rows per product in single precision, so that the scores stay in the cache
_FIRST_ROWS = 1024  # gallery rows of the first product of a block
DIRECT_ROWS = 262_144  # galleries up to this size are scored pair by pair



def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Row-normalized double matrix of a list column; zero vectors become NaN rows."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    rows = len(lists)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    widths = lists.value_lengths().to_numpy(zero_copy_only=False)
    if rows and (widths != widths[0]).any():
        raise ValueError(f"vectors of several widths: {sorted(set(widths.tolist()))}")
    matrix = values.reshape(rows, widths[0] if rows else 0)
    with np.errstate(invalid="ignore", divide="ignore"):
        return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _ids(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _codes(ids: np.ndarray) -> np.ndarray:
    """Sort positions of ids of any comparable type; whole numbers are their own."""
    return ids if ids.dtype.kind in "iu" else np.unique(ids, return_inverse=True)[1]


def _true_places(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the few true values of a table, eight flags at a time."""
    flat = flags.ravel()
    whole = len(flat) & ~7
    at = np.flatnonzero(flat[:whole].view(np.uint64))
    word, bit = np.nonzero(flat[:whole].reshape(-1, 8)[at])
    places = np.concatenate((at[word] * 8 + bit, whole + np.flatnonzero(flat[whole:])))
    return np.divmod(places, max(flags.shape[1], 1))


def _top_columns(scores: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``top`` best finite scores per row; ties keep the left column."""
    width = scores.shape[1]
    if width > top:
        floor = np.partition(scores, width - top, axis=1)[:, width - top]
        keep = scores >= floor[:, None]
    else:
        keep = np.ones(scores.shape, dtype=bool)
    keep &= np.isfinite(scores)
    row, col = np.nonzero(keep)
    order = np.lexsort((col, -scores[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, row, side="left")
    within = np.arange(len(row)) - first < top
    return row[within], col[within]


class _Best:
    """The best ``top`` images, or individuals by their best image, of every query of a block so far.

    A query that has its ``top`` meets further rows in single precision first, whose error is
    bounded; what may still be among its best is scored in double precision. Rows without
    ``floor``, or with too much near it (equal vectors), are scored in double precision at once.
    """

    def __init__(self, queries: pa.Table, top: int, by: str, hide: str | None, digits: int):
        self.top, self.by, self.hide, self.digits = top, by, hide, digits
        self.queries = queries
        self.vectors = _matrix(queries.column("embedding"))
        self.single = self.vectors.astype(np.float32)
        # of sums of so many products of rounded numbers, for unit vectors
        self.error = (self.vectors.shape[1] + 8) * 2.0**-24
        self.hidden = _ids(queries, "hide_id") if hide else None
        self.floor = np.full(queries.num_rows, -np.inf)  # the score of the last of the best, once there are enough
        if "bound" in queries.column_names:  # known before, give or take rounding
            bound = queries.column("bound").to_numpy()
            self.floor = np.where(np.isnan(bound), -np.inf, bound - 10.0**-digits)
        self.row, self.score, self.held = np.zeros(0, dtype=np.int64), np.zeros(0), None
        self.found: list[tuple[np.ndarray, np.ndarray, pa.Table]] = []
        self.waiting, self.seen, self.settled = 0, 0, 0

    def add(self, gallery: pa.Table, needed: np.ndarray | None = None) -> None:
        """Score some gallery rows for all queries; or by ``needed``, flags of the rows' ``at`` by chunk of queries.

        The first rows come in small pieces, so that floors rise before many rows are compared.
        """
        start = 0
        while start < gallery.num_rows:
            piece = gallery.slice(start, max(_FIRST_ROWS, self.seen))
            self._piece(piece, needed)
            start += piece.num_rows
            self.seen += piece.num_rows
            if self.seen >= 2 * self.settled:
                self._settle()
                self.settled = self.seen

    def _piece(self, gallery: pa.Table, needed: np.ndarray | None) -> None:
        vectors = _matrix(gallery.column("embedding"))
        if len(self.vectors) and vectors.shape[1] != self.vectors.shape[1]:
            raise ValueError(f"vectors of several widths: {[self.vectors.shape[1], vectors.shape[1]]}")
        ids, owners = _ids(gallery, "image_id"), _ids(gallery, "individual_id")
        against = ids if self.hide == "image" else owners
        at = None if needed is None else _ids(gallery, "at")
        names = gallery.select(["image_id", "individual_id"])
        single = vectors.astype(np.float32)
        every = np.arange(len(vectors))
        for number, start in enumerate(range(0, len(self.vectors), _CHUNK)):
            cols = every if at is None else np.flatnonzero(needed[number][at])
            if not len(cols):
                continue
            whole = len(cols) == len(every)
            rows = np.arange(start, min(start + _CHUNK, len(self.vectors)))
            known = np.isfinite(self.floor[rows])
            dense = [rows[~known]]
            if known.any():
                row, col, value, heavy = self._few(rows[known], single if whole else single[cols], vectors, cols, against)
                self._keep(row, value, names, col)
                dense.append(heavy)
            dense = np.concatenate(dense)
            if len(dense):
                self._keep(*self._many(dense, vectors, cols, ids, owners, against, names))

    def _keep(self, row: np.ndarray, value: np.ndarray, names: pa.Table, col: np.ndarray) -> None:
        if not len(row):
            return
        self.found.append((row, value, names.take(pa.array(col))))
        self.waiting += len(row)
        if self.waiting > max(self.top * len(self.vectors), 1 << 16):
            self._settle()

    def _few(
        self, rows: np.ndarray, single: np.ndarray, vectors: np.ndarray, cols: np.ndarray, against: np.ndarray
    ) -> tuple[np.ndarray, ...]:
        """Query, gallery row and rounded score of what can still be among the best of its query, and the queries with too much."""
        least = self.floor[rows] - 10.0**-self.digits - self.error  # more than rounding can add
        least = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
        asking, tiles = self.single[rows], range(0, len(single), _TILE)
        met = [_true_places(asking @ single[k : k + _TILE].T >= least[:, None]) for k in tiles]
        row = np.concatenate([x for x, _ in met])
        col = np.concatenate([y + k for k, (_, y) in zip(tiles, met)])
        heavy = rows[:0]
        if len(row) > 4 * self.top * len(rows):
            much = np.bincount(row, minlength=len(rows)) > 4 * self.top
            heavy = rows[much]
            row, col = row[~much[row]], col[~much[row]]
        row, col = rows[row], cols[col]
        out = []
        for k in range(0, len(row), 1 << 16):
            r, c = row[k : k + (1 << 16)], col[k : k + (1 << 16)]
            value = np.round(np.einsum("ij,ij->i", self.vectors[r], vectors[c]), self.digits)
            keep = np.isfinite(value) & (value >= self.floor[r])
            if self.hidden is not None:
                keep &= self.hidden[r] != against[c]
            out.append((r[keep], c[keep], value[keep]))
        if not out:
            return row, col, np.zeros(0), heavy
        return (*(np.concatenate(x) for x in zip(*out)), heavy)

    def _many(self, rows, vectors, cols, ids, owners, against, names) -> tuple[np.ndarray, np.ndarray, pa.Table, np.ndarray]:
        """Query, rounded score and gallery row of the best of these rows, for queries of which no floor helps."""
        by_owner = self.by == "individual"
        order = np.lexsort((_codes(ids[cols]), *([_codes(owners[cols])] if by_owner else [])))
        cols = cols[order]
        scores = np.round(self.vectors[rows] @ vectors[cols].T, self.digits)
        scores[np.isnan(scores)] = -np.inf
        if self.hidden is not None:
            scores[self.hidden[rows][:, None] == against[cols][None, :]] = -np.inf
        if not by_owner:
            row, col = _top_columns(scores, self.top)
        else:
            rank = _codes(owners[cols])
            starts = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
            ends = np.r_[starts[1:], len(rank)]
            best = np.maximum.reduceat(scores, starts, axis=1)
            best[best < self.floor[rows][:, None]] = -np.inf
            row, group = _top_columns(best, self.top)
            col = np.array([x + np.argmax(scores[r, x:y]) for r, x, y in zip(row, starts[group], ends[group])], dtype=np.int64)
        return rows[row], scores[row, col], names, cols[col]

    def _ordered(self, row: np.ndarray, score: np.ndarray, tie: np.ndarray) -> np.ndarray:
        """The order by query, score from the best, and tie; scores of few digits are sorted with the query as one number."""
        if self.digits > 9 or (len(score) and np.abs(score).max() > 2):
            return np.lexsort((tie, -score, row))
        key = (row << 33) - np.rint(score * 10.0**self.digits).astype(np.int64)
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        tied = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
        if len(tied):
            order[tied] = order[tied][np.lexsort((tie[order[tied]], key[tied]))]
        return order

    def _settle(self) -> None:
        """Merge what was found into the best."""
        if not self.found:
            return
        row = np.concatenate([self.row, *[x[0] for x in self.found]])
        score = np.concatenate([self.score, *[x[1] for x in self.found]])
        held = pa.concat_tables([*([] if self.held is None else [self.held]), *[x[2] for x in self.found]])
        self.found, self.waiting = [], 0
        pick = np.flatnonzero(score >= self.floor[row])
        row, score, held = row[pick], score[pick], held.take(pa.array(pick)).combine_chunks()
        image = _codes(_ids(held, "image_id"))
        if self.by == "individual":
            tie = _codes(_ids(held, "individual_id"))
            pick = np.lexsort((image, -score, tie, row))
            again = (row[pick][1:] == row[pick][:-1]) & (tie[pick][1:] == tie[pick][:-1])
            pick = pick[np.r_[np.ones(min(len(pick), 1), dtype=bool), ~again]]
            pick = pick[np.lexsort((tie[pick], -score[pick], row[pick]))]
        else:
            pick = self._ordered(row, score, image)
        ordered = row[pick]
        place = np.arange(len(pick)) - np.searchsorted(ordered, ordered, side="left")
        pick, place = pick[place < self.top], place[place < self.top]
        self.row, self.score, self.held = row[pick], score[pick], held.take(pa.array(pick)).combine_chunks()
        last = place == self.top - 1
        self.floor[self.row[last]] = np.maximum(self.floor[self.row[last]], self.score[last])

    def table(self, schema: pa.Schema) -> pa.Table:
        """``query_id, image_id, individual_id, score`` of the best."""
        self._settle()
        if self.held is None:
            return schema.empty_table()
        query = self.queries.column("query_id").take(pa.array(self.row))
        columns = [query, self.held.column("image_id"), self.held.column("individual_id"), pa.array(self.score)]
        return pa.table(columns, names=["query_id", "image_id", "individual_id", "score"]).cast(schema)


def _out_schema(queries: DataFrame, gallery: DataFrame) -> StructType:
    return (
        StructType()
        .add("query_id", queries.schema["query_id"].dataType)
        .add("image_id", gallery.schema["image_id"].dataType)
        .add("individual_id", gallery.schema["individual_id"].dataType)
        .add("score", "double")
    )


def _blocks(df: DataFrame, scope: list[str], block_rows: int) -> Column:
    """Number of blocks as a scalar subquery; per scope value when a scope is given.

    The scope is a label set (split, region): its size map stays small.
    """
    size = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)), F.lit(1)).cast("int")
    if not scope:
        return df.agg(size.alias("n")).scalar()
    sizes = df.groupBy(F.struct(*scope).alias("k")).agg(size.alias("n"))
    size_map = sizes.agg(
        F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m")
    ).scalar()
    return F.coalesce(F.element_at(size_map, F.struct(*scope)), F.lit(0))


def nearest(
    queries: DataFrame,
    gallery: DataFrame,
    top: int,
    *,
    by: str = "image",
    scope: list[str] | None = None,
    hide: str | None = None,
    block_rows: int = 4096,
    score_digits: int = SCORE_DIGITS,
    direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """``(query_id, image_id, individual_id, score, rank)`` of the best ``top`` per query.

    A gallery of more than ``direct_rows`` vectors is searched by its pivot table
    (:mod:`tidewater.operators.pivots`), which leaves out what cannot be in the result;
    the rows are the same either way.

    queries: ``query_id, embedding`` plus the scope columns, and ``hide_id`` if
    ``hide`` is ``"image"`` (never return that image) or ``"individual"``.
    gallery: ``image_id, individual_id, embedding`` plus the scope columns.
    ``by="individual"`` keeps the best image of each individual; the individuals
    of a block that can reach the global top are in the top of that block, so
    the cut inside a block is exact. Ties go to the smaller id. ``block_rows`` is the
    least size of a block; see :func:`_block_join`.
    """
    held = gallery.select("image_id").limit(direct_rows + 1).count()
    if held > direct_rows:
        from tidewater.operators import pivots

        return pivots.search(queries, gallery, top, by=by, scope=scope, hide=hide, score_digits=score_digits).found
    found = _block_join(queries, gallery, top, by, scope or [], hide, block_rows, score_digits, held)
    if by == "individual":
        best = Window.partitionBy("query_id", "individual_id").orderBy(
            F.col("score").desc(), "image_id"
        )
        found = keep_top(found, best, 1).drop("rank")
        tie = "individual_id"
    else:
        tie = "image_id"
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), tie)
    return keep_top(found, ranked, top)


#: blocks of queries, as many as their size asks for up to this; more only where a block had over _HELD_ROWS
_QUERY_BLOCKS, _HELD_ROWS = 32, 65_536
#: parts of the gallery that pass a block of queries in different tasks; more where there are few blocks
_GALLERY_PARTS, _TASKS = 4, 128
_MANY_ROWS = 16_384


def _split(q_rows: Column, g_rows: Column, block_rows: int) -> tuple[Column, Column]:
    """Blocks of the queries and parts of the gallery, of tables of so many times ``block_rows``."""
    q_blocks = F.greatest(F.least(q_rows, F.lit(_QUERY_BLOCKS)), F.ceil(q_rows * F.lit(block_rows / _HELD_ROWS)).cast("int"))
    beside = F.floor(F.lit(_TASKS) / F.greatest(q_blocks, F.lit(1))).cast("int")
    return q_blocks, F.least(g_rows, F.greatest(beside, F.lit(_GALLERY_PARTS)))


def _block_join(
    queries, gallery, top, by, scope, hide, block_rows, digits, held: int, wanted: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]] | None = None
) -> DataFrame:
    """The best ``top`` of every query in each part of the gallery.

    A gallery row is copied once per block of queries, a query once per part: both numbers
    are bounded, so the shuffle grows with the tables and not with their product. Sorting
    puts the queries of a block before the gallery rows, which stream past. ``wanted``
    gives an order of the queries of a block, and the gallery's ``at`` to score as flags by
    chunk of ``_CHUNK`` queries in that order; queries carry a ``bound`` that their ``top``-th
    score reaches (null: not known) then. Where the gallery holds ``held`` rows or so and these
    are many, blocks are dealt to more tasks than their bytes ask for: products take the time.
    """
    out = _out_schema(queries, gallery)
    q_rows, g_rows = _blocks(queries, scope, block_rows), _blocks(gallery, scope, block_rows)
    q_blocks, g_parts = _split(q_rows, g_rows, block_rows)
    scopes = [f"_scope{i}" for i in range(len(scope))]
    keys = [*scopes, "_qb", "_gb"]
    vector = queries.schema["embedding"].dataType
    if vector != gallery.schema["embedding"].dataType:
        vector = "array<double>"
    kinds = {"query_id": out["query_id"].dataType, "image_id": out["image_id"].dataType, "individual_id": out["individual_id"].dataType}
    if hide:
        kinds["hide_id"] = queries.schema["hide_id"].dataType
    if wanted:
        kinds |= {"bound": "double", "at": "int"}

    def side(df: DataFrame, number: int, id: str, own: str, other: str) -> DataFrame:
        return (
            df.withColumns({"_q": q_blocks, "_g": g_parts})
            .where("_q > 0 and _g > 0 and embedding is not null")
            .select(
                *[F.col(c).alias(name) for c, name in zip(scope, scopes)],
                F.expr(f"cast(pmod(xxhash64({id}), {'_q' if own == '_qb' else '_g'}) as int)").alias(own),
                F.explode(F.expr(f"sequence(0, {'_g' if own == '_qb' else '_q'} - 1)")).alias(other),
                F.lit(number).alias("_side"),
                *[(F.col(c) if c in df.columns and (c in of[number]) else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()],
                F.col("embedding").cast(vector).alias("embedding"),
            )
        )

    of = (("query_id", "hide_id", "bound"), ("image_id", "individual_id", "at"))
    both = side(queries, 0, "query_id", "_qb", "_gb").unionByName(side(gallery, 1, "image_id", "_gb", "_qb"))
    order = [*keys, "_side", "image_id"]
    schema = to_arrow_schema(out)
    q_cols = [c for c in ("query_id", "hide_id", "bound", "embedding") if c in both.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asked, best, needed = None, [], None, None
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            for now, part in _runs(whole, [*keys, "_side"]):
                if now[:-1] != key:
                    if best is not None:
                        yield from best.table(schema).to_batches()
                    key, asked, best, needed = now[:-1], [], None, None
                if now[-1] == 0:
                    asked.append(part.select(q_cols))
                    continue
                if best is None:
                    if not asked:
                        continue
                    block = pa.concat_tables(asked)
                    if wanted:
                        order, needed = wanted(block)
                        block = block.take(pa.array(order))
                    best = _Best(block.combine_chunks(), top, by, hide, digits)
                best.add(part, needed)
        if best is not None:
            yield from best.table(schema).to_batches()

    dealt = both.repartition(2 * _TASKS, *keys) if held > _MANY_ROWS else both.repartition(*keys)
    return dealt.sortWithinPartitions(*order).mapInArrow(run, out)


def _runs(table: pa.Table, names: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The stretches of a sorted table that agree in some columns, with their values."""
    if not table.num_rows:
        return
    one = lambda i: tuple(table.column(c)[i].as_py() for c in names)
    start = 0
    if one(0) != one(table.num_rows - 1):
        values = list(zip(*[table.column(c).to_pylist() for c in names]))
        for i in range(1, len(values)):
            if values[i] != values[i - 1]:
                yield values[start], table.slice(start, i - start)
                start = i
    yield one(start), table.slice(start)


def best_per_individual(images: DataFrame, k: int | None = TOP_INDIVIDUALS) -> DataFrame:
    """Candidate images of a query to ranked individuals.

    An individual has the score and the image of its best candidate and the
    number of its candidate images as support.
    """
    best = F.min(F.struct((-F.col("score")).alias("low"), "image_id"))
    people = (
        images.groupBy("query_id", "individual_id")
        .agg(best.alias("_b"), F.count(F.lit(1)).alias("n_images"))
        .select(
            "query_id",
            "individual_id",
            (-F.col("_b.low")).alias("score"),
            F.col("_b.image_id").alias("image_id"),
            "n_images",
        )
    )
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "individual_id")
    if k is None:
        return people.withColumn("rank", F.row_number().over(ranked).cast("long"))
    return keep_top(people, ranked, k)


def with_support(ranked: DataFrame, queries: DataFrame, gallery: DataFrame) -> DataFrame:
    """Support of a scoped search: all gallery images of the individual, own image out.

    Counted per individual, not from pairs. ``queries`` has ``query_id, own_individual``
    (the owner of the hidden image, NULL if it is not in the gallery).
    """
    sizes = gallery.groupBy("individual_id").agg(F.count(F.lit(1)).alias("_n"))
    own = F.when(F.col("own_individual") == F.col("individual_id"), 1).otherwise(0)
    return (
        ranked.join(queries.select("query_id", "own_individual"), "query_id")
        .join(sizes, "individual_id")
        .withColumn("n_images", F.col("_n") - own)
        .drop("_n", "own_individual")
    )


def margin_abstain(ranked: DataFrame, threshold: float = ABSTAIN_THRESHOLD) -> DataFrame:
    """Top score, lead over the second (NULL with fewer than two) and the abstain flag."""
    at = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    return (
        ranked.where("rank <= 2")
        .groupBy("query_id")
        .agg(
            at(1, "individual_id").alias("top_individual"),
            at(1, "score").alias("top_score"),
            at(2, "score").alias("_second"),
        )
        .withColumn("margin", F.col("top_score") - F.col("_second"))
        .withColumn("abstain", F.col("top_score") < F.lit(threshold))
        .drop("_second")
    )


def photo_answers(
    requests: DataFrame,
    ranked: DataFrame,
    cards: DataFrame | None = None,
    catalog: str = "catalog",
    threshold: float = ABSTAIN_THRESHOLD,
) -> DataFrame:
    """One contract row per requested ``query_id``; no neighbours means abstain, not ok.

    ``ranked`` has a handful of candidates per query, taken as one sorted list: the
    ``candidates`` of the answer (individual, score, support, image, its catalog and
    thumbnail). ``cards`` gives ``image_id, catalog, thumb_ref`` of gallery images; an image
    without a card belongs to ``catalog`` and has no thumbnail. Each candidate is cited by
    its thumbnail. A low score is told as a likely new individual, a match with its margin
    over the second (``n/a`` without one).
    """
    support = F.col("n_images") if "n_images" in ranked.columns else F.lit(None).cast("long")
    if cards is None:
        shown = ranked.withColumns({"catalog": F.lit(catalog), "thumb_ref": F.lit(None).cast("string")})
    else:
        known = cards.select("image_id", F.col("catalog").alias("_catalog"), "thumb_ref")
        shown = ranked.join(known, "image_id", "left").withColumn("catalog", F.coalesce("_catalog", F.lit(catalog)))
    one = F.struct("rank", "individual_id", "score", support.cast("long").alias("n_images"), "image_id", "catalog", "thumb_ref")
    lists = shown.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("candidates"))
    signals = lists.select(
        "query_id",
        "candidates",
        F.col("candidates")[0]["individual_id"].alias("top_individual"),
        F.col("candidates")[0]["score"].alias("top_score"),
        (F.col("candidates")[0]["score"] - F.try_element_at("candidates", F.lit(2))["score"]).alias("margin"),
    ).withColumn("abstain", F.col("top_score") < F.lit(threshold))
    lead = F.when(F.col("margin").isNull(), F.lit("n/a")).otherwise(F.format_string("%.3f", "margin"))
    matched = F.concat(F.format_string("Top match individual %s (score=%.3f, margin=", "top_individual", "top_score"), lead, F.lit(")"))
    unsure = F.format_string("No confident match (top=%.3f < %s) → likely NOVEL", "top_score", F.lit(threshold))
    cited = lambda c: citation("catalog_image", c["catalog"], c["thumb_ref"], c["individual_id"])
    signals = signals.withColumns(
        {
            "summary": F.when(F.col("abstain"), unsure).otherwise(matched),
            "citations": F.transform("candidates", cited),
        }
    )
    out = answer_all(
        requests.select("query_id"),
        signals,
        "query_id",
        "photo_id",
        "Empty catalog / no neighbors found",
    )
    return out.withColumns({"abstain": F.coalesce("abstain", F.lit(True)), "threshold": F.lit(threshold)})


def region_prior(
    ranked: DataFrame, regions: DataFrame, query_regions: DataFrame, links: DataFrame, species: str
) -> DataFrame:
    """Flags from a seasonal region prior; it can demote a candidate, never confirm one.

    regions: ``individual_id, species, region`` observed; links: feeding
    region to breeding region (a fixed small table); query_regions:
    ``query_id, region``. A candidate is demoted only if it belongs to the one
    species, none of its observed regions is the query region and none is linked
    to it, and the candidates differ in region at all.
    """
    seen = (
        regions.where(F.col("region").isNotNull())
        .groupBy("individual_id")
        .agg(F.max("species").alias("_species"), F.collect_set("region").alias("regions"))
    )
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy(F.col("a").alias("region")).agg(F.collect_set("b").alias("_linked"))
    placed = (
        ranked.join(seen, "individual_id", "left")
        .join(query_regions.join(near, "region", "left"), "query_id", "left")
        .withColumn("observed_here", F.coalesce(F.array_contains("regions", F.col("region")), F.lit(False)))
        .withColumn(
            "linked_here",
            F.coalesce(F.arrays_overlap("regions", F.col("_linked")), F.lit(False)),
        )
    )
    spread = placed.groupBy("query_id").agg(
        (F.count_distinct(F.array_join(F.array_sort("regions"), "|")) > 1).alias("separable")
    )
    applies = F.coalesce(F.col("_species") == species, F.lit(False)) & F.col("region").isNotNull()
    return (
        placed.join(spread, "query_id")
        .withColumn(
            "demote",
            F.col("separable") & applies & F.col("regions").isNotNull()
            & ~F.col("observed_here") & ~F.col("linked_here"),
        )
        .select("query_id", "individual_id", "rank", "observed_here", "linked_here", "separable", "demote")
    )


def arm_scores(ranked: DataFrame, truth: DataFrame, arms: list[str]) -> DataFrame:
    """reid@1 and reid@5 per input arm.

    ranked: ``arm, query_id, individual_id, rank``; truth: ``arm, query_id, true_id``.
    """
    hit = truth.join(
        ranked.where("rank <= 5"), ["arm", "query_id"], "left"
    ).withColumn("_hit", F.when(F.col("individual_id") == F.col("true_id"), F.col("rank")))
    per_query = hit.groupBy("arm", "query_id").agg(F.min("_hit").alias("_at"))
    return (
        per_query.where(F.col("arm").isin(arms))
        .groupBy("arm")
        .agg(
            F.count(F.lit(1)).alias("n_queries"),
            F.avg((F.coalesce(F.col("_at"), F.lit(99)) <= 1).cast("double")).alias("reid_1"),
            F.avg((F.coalesce(F.col("_at"), F.lit(99)) <= 5).cast("double")).alias("reid_5"),
        )
    )


def cosine_separation(images: DataFrame) -> DataFrame:
    """Mean cosine of same-individual and of different-individual ordered pairs.

    The sum over pairs of unit vectors is the squared length of their sum, so
    one aggregate per individual and dimension replaces all pairs.
    """
    unit = images.select(
        "individual_id",
        F.posexplode(
            F.transform("embedding", lambda x: x.cast("double"))
        ).alias("pos", "x"),
        F.sqrt(
            F.aggregate(
                "embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")
            )
        ).alias("_n"),
    )
    per_label = unit.groupBy("individual_id", "pos").agg(
        F.sum(F.col("x") / F.col("_n")).alias("s"), F.count(F.lit(1)).alias("n")
    )
    per_pos = per_label.groupBy("pos").agg(
        F.sum(F.col("s") * F.col("s")).alias("same"),
        F.sum("s").alias("total"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("n")).alias("n_same"),
    )
    sums = per_pos.agg(
        F.sum("same").alias("same"),
        F.sum(F.col("total") * F.col("total")).alias("all"),
        F.max("n").alias("n"),
        F.max("n_same").alias("n_same"),
    )
    return sums.select(
        (F.col("n_same") - F.col("n")).alias("same_pairs"),
        (F.col("n") * F.col("n") - F.col("n_same")).alias("diff_pairs"),
        ((F.col("same") - F.col("n")) / (F.col("n_same") - F.col("n"))).alias("same_mean"),
        ((F.col("all") - F.col("same")) / (F.col("n") * F.col("n") - F.col("n_same"))).alias(
            "diff_mean"
        ),
    )


def supcon_value(batches: DataFrame, temperature: float = 0.1) -> DataFrame:
    """Supervised contrastive loss of a stored table, one value per batch.

    ``batches``: ``batch_id, individual_id, embedding``. A batch is a bounded
    training batch (P individuals times K images), scored as one small matrix.
    """

    def loss(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        owners = _ids(table, "individual_id")
        vectors = _matrix(table.column("embedding"))
        scaled = vectors @ vectors.T / temperature
        others = ~np.eye(len(owners), dtype=bool)
        scaled -= scaled.max(axis=1, keepdims=True)
        log_all = np.log((np.exp(scaled) * others).sum(axis=1, keepdims=True) + 1e-12)
        same = (owners[:, None] == owners[None, :]) & others
        per_anchor = ((scaled - log_all) * same).sum(axis=1) / np.maximum(same.sum(axis=1), 1)
        return pa.table(
            {
                "batch_id": pa.array([key[0].as_py()], pa.int64()),
                "n": pa.array([len(owners)], pa.int64()),
                "loss": pa.array([float(-per_anchor.mean())], pa.float64()),
            }
        )

    return (
        batches.select("batch_id", "individual_id", "embedding")
        .groupBy("batch_id")
        .applyInArrow(loss, schema="batch_id long, n long, loss double")
    )


def version_parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cosine of the same image under two embedding versions, joined by its path."""
    pairs = a.select("asset_ref", F.col("embedding").alias("_a")).join(
        b.select("asset_ref", F.col("embedding").alias("_b")), "asset_ref"
    )
    return pairs.select("asset_ref", cosine(F.col("_a"), F.col("_b")).alias("cosine"))
