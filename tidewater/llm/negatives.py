"""Hard negatives by Fagin's threshold algorithm over integer inner products.

Anchors and candidates meet block by block. A block of candidates has one sorted list
for each dimension. An anchor reads all lists at the same pace, from the top where its
own component is positive and from the bottom where it is negative; every row met is
scored at once. No row that is still unseen can score more than the threshold, which is
the anchor's product with the values just read, so an anchor stops once the threshold
lies strictly below the last score that each of its windows needs. What a block returns
holds the best rows of the block for every window; the best of those are the result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.ordered import keep_top
from tidewater.session import stored

_FIRST_DEPTH, _DEEPER = 8, 4  # rows read of each list before the first check, and the growth of that number


def usable(vector: Column) -> Column:
    """True for a vector without null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, lambda x: F.coalesce(bad(x), F.lit(True)))


def scaled(vector: Column, by: float = 256.0) -> Column:
    """Components as whole numbers: floor(by * x), with x as a double."""
    return F.transform(vector, lambda x: F.floor(F.lit(by) * x.cast("double")).cast("long"))


class Lists:
    """A block of candidates, in the order of their ids, with a sorted list per dimension."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.ascending = np.argsort(vectors, axis=0, kind="stable")

    def best(self, anchor: np.ndarray, eligible: np.ndarray, windows: Sequence[tuple[int | None, int | None]], k: int) -> tuple[list[np.ndarray], np.ndarray, int]:
        """For every window (lowest, highest score; None: open) the first ``k`` eligible rows in it.

        Rows come by descending score, then by position. Also returns all scores known
        (of rows that were read) and the number of rows that were scored.
        """
        vectors, rows = self.vectors, len(self.vectors)
        scores = np.zeros(rows, dtype=vectors.dtype)
        seen = np.zeros(rows, dtype=bool)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        signed = np.concatenate([anchor[up], anchor[down]])
        dims = np.concatenate([up, down])
        depth, scored = 0, 0
        found: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(windows)
        while depth < rows:
            to = min(rows, max(_FIRST_DEPTH, depth * _DEEPER)) if len(dims) else rows
            read = np.zeros(rows, dtype=bool)
            if len(dims):
                read[self.ascending[rows - to : rows - depth, up]] = True
                read[self.ascending[depth:to, down]] = True
            else:
                read[:] = True  # a zero vector scores every row alike
            new = np.flatnonzero(read & ~seen & eligible)
            seen |= read
            scored += len(new)
            scores[new] = vectors[new] @ anchor
            known = np.flatnonzero(seen & eligible)
            order = known[np.lexsort((known, -scores[known]))]
            falling = -scores[order]
            last = np.concatenate([self.ascending[rows - to, up], self.ascending[to - 1, down]])
            threshold = signed @ vectors[last, dims] if len(dims) else 0
            done = True
            for i, (low, high) in enumerate(windows):
                first = 0 if high is None else np.searchsorted(falling, -high, side="left")
                stop = len(order) if low is None else np.searchsorted(falling, -low, side="right")
                found[i] = order[first : max(first, min(stop, first + k))]
                full = len(found[i]) >= k and threshold < scores[found[i][-1]]
                done = done and (full or low is not None and threshold < low)
            depth = to
            if done:
                break
        return found, scores, scored


def _matrices(left: pa.ChunkedArray, right: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Both list columns as matrices of one width, in numbers that hold every inner product exactly."""
    columns = []
    for column in (left, right):
        lists = column.combine_chunks()
        widths = lists.value_lengths().to_numpy(zero_copy_only=False)
        columns.append((lists.flatten().to_numpy(zero_copy_only=False), widths))
    width = max(int(w.max(initial=0)) for _, w in columns)
    most = width
    for values, _ in columns:
        most *= max(abs(int(values.min(initial=0))), abs(int(values.max(initial=0))))
    kind = np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object
    out = []
    for values, widths in columns:
        matrix = np.zeros((len(widths), width), dtype=kind)
        matrix[np.arange(width) < widths[:, None]] = values.astype(kind)
        out.append(matrix)
    return out[0], out[1]


def _long(values: Sequence) -> pa.Array:
    """Scores as longs; one beyond their range becomes its end."""
    ends = np.iinfo(np.int64)
    return pa.array([min(max(int(v), ends.min), ends.max) for v in values], pa.int64())


def _parts(rows: DataFrame, size: int) -> Column:
    return rows.agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(size)), F.lit(1)).cast("int").alias("n")).scalar()


def _met(anchors: DataFrame, rows: DataFrame, anchor_rows: int, block_rows: int):
    """Anchors and candidates, cut by a hash of the id, in a grid of bounded cells."""
    chunks, blocks = _parts(anchors, anchor_rows), _parts(rows, block_rows)
    at = lambda parts: F.pmod(F.xxhash64("id"), parts).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), parts - 1))
    left = anchors.withColumn("_chunk", at(chunks)).withColumn("_block", every(blocks))
    right = rows.withColumn("_block", at(blocks)).select(
        "_block", every(chunks).alias("_chunk"), *[F.col(c).alias(f"other_{c}") for c in ("id", "label", "vector")]
    )  # other names: both sides come from one table
    return left.groupBy("_chunk", "_block").cogroup(right.groupBy("_chunk", "_block"))


FOUND = "anchor_id long, other_id long, score long"
NEGATIVES = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def mined(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    anchor_rows: int = 4096,
    block_rows: int = 4096,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    rows: ``id long, label, vector array<long>``. A score is the inner product with the
    anchor; higher scores come first, then smaller ids. An anchor's positives are its
    first ``positives`` other rows of the same label; each has the first ``negatives``
    rows of other labels whose score is from ``low`` to ``high`` per cent of its own
    (none, if its own is negative). All of them, where there are fewer.

    Rows with a null in any of the three columns take no part; of rows with the same id
    only the smallest (label, vector) does. Shorter vectors count as filled up with
    zeros. Scores beyond a long become its end. An empty table, and an anchor without a
    positive or a fitting negative, give no rows.

    The work is that of anchors times rows, in cells of ``anchor_rows`` by ``block_rows``
    at most (on average: ids are hashed); each side travels once per part of the other.
    """
    whole = rows.where("id is not null and label is not null and vector is not null and not exists(vector, x -> x is null)")
    one = whole.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("v")).select("id", "v.label", "v.vector")
    kept = stored(one, "negatives")
    anchors = kept.where(is_anchor)

    found_schema = pa.schema([("anchor_id", pa.int64()), ("other_id", pa.int64()), ("score", pa.int64())])

    def same_label(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return found_schema.empty_table()
        right = right.sort_by("other_id")
        a, b = _matrices(left.column("vector"), right.column("other_vector"))
        labels = np.array(right.column("other_label").to_pylist(), dtype=object)
        ids = right.column("other_id").to_numpy()
        out: list[tuple] = []
        of: dict = {}
        for i, (anchor_id, own) in enumerate(zip(left.column("id").to_pylist(), left.column("label").to_pylist())):
            if own not in of:
                place = np.flatnonzero(labels == own)
                of[own] = (place, Lists(b[place]))
            place, lists = of[own]
            (best,), scores, _ = lists.best(a[i], ids[place] != anchor_id, [(None, None)], positives)
            out += [(anchor_id, int(ids[place[j]]), scores[j]) for j in best]
        x, y, z = zip(*out) if out else ((), (), ())
        return pa.table([pa.array(x, pa.int64()), pa.array(y, pa.int64()), _long(z)], schema=found_schema)

    near = _met(anchors, kept, anchor_rows, block_rows).applyInArrow(same_label, FOUND)
    ranked = Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "other_id")
    wanted = (
        keep_top(near, ranked, positives)
        .groupBy("anchor_id")
        .agg(F.sort_array(F.collect_list(F.struct(F.col("other_id").alias("id"), "score"))).alias("positives"))
    )
    asking = anchors.join(wanted, anchors["id"] == wanted["anchor_id"]).select("id", "label", "vector", "positives")
    negative_schema = pa.schema([(x.split()[0], pa.int64()) for x in NEGATIVES.split(", ")])

    def other_label(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return negative_schema.empty_table()
        right = right.sort_by("other_id")
        a, b = _matrices(left.column("vector"), right.column("other_vector"))
        labels = np.array(right.column("other_label").to_pylist(), dtype=object)
        ids = right.column("other_id").to_numpy()
        lists = Lists(b)
        eligible: dict = {}
        out: list[tuple] = []
        for i, (anchor_id, own, asked) in enumerate(zip(*(left.column(c).to_pylist() for c in ("id", "label", "positives")))):
            if own not in eligible:
                eligible[own] = labels != own
            # 100 * score lies between low and high times the positive's score
            asked = [p for p in asked if p["score"] >= 0]
            windows = [(-(-low * p["score"] // 100), high * p["score"] // 100) for p in asked]
            found, scores, _ = lists.best(a[i], eligible[own], windows, negatives)
            for p, best in zip(asked, found):
                out += [(anchor_id, p["id"], p["score"], int(ids[j]), scores[j]) for j in best]
        columns = list(zip(*out)) if out else [()] * 5
        return pa.table([_long(c) for c in columns], schema=negative_schema)

    hard = _met(asking, kept, anchor_rows, block_rows).applyInArrow(other_label, NEGATIVES)
    ranked = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    return keep_top(hard, ranked, negatives).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )
