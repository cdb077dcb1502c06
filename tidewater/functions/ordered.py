"""Ordered aggregates that never put one whole key into one task.

A plain window over a key sorts every row of that key in one task. If one key
holds a third of the table, that task is the job. Both helpers below cut a key
into *cells*: cell totals are aggregated map-side, the short list of cells per
key is accumulated, and only rows of one cell meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidewater.session import stored


def keep_top(df: DataFrame, window: WindowSpec, k: int, out: str = "rank") -> DataFrame:
    """First ``k`` rows per partition of ``window``, numbered from 1.

    The comparison is on the bare row number, which lets Spark drop the other
    rows before the shuffle (``WindowGroupLimit``), so a hot key stays cheap.
    """
    numbered = df.withColumn(out, F.row_number().over(window)).where(F.col(out) <= k)
    return numbered.withColumn(out, F.col(out).cast("long"))


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    cell: Column,
    order: Sequence[Column],
    value: Column,
    out: str,
    *,
    descending: bool = False,
) -> DataFrame:
    """Inclusive running sum of ``value`` per key in ``order``.

    ``cell`` must be monotone in ``order`` (for example the month of a date, or
    a floored score); ``descending`` says that the order runs down the cells.
    Cell and order are computed on rows, so ``order`` has to be total.
    """
    keys = list(keys)
    tagged = df.withColumn("_cell", cell).withColumn("_value", value)
    totals = tagged.groupBy(*keys, "_cell").agg(F.sum("_value").alias("_total"))
    by_cell = F.col("_cell").desc_nulls_last() if descending else F.col("_cell").asc_nulls_first()
    earlier = Window.partitionBy(*keys).orderBy(by_cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_cell").alias("_c"),
        F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"),
    )
    on = F.col("_cell").eqNullSafe(F.col("_c"))
    for i, key in enumerate(keys):
        on = on & F.col(key).eqNullSafe(F.col(f"_k{i}"))
    inside = (
        Window.partitionBy(*keys, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        tagged.join(offsets, on)
        .withColumn(out, F.col("_before") + F.sum("_value").over(inside))
        .drop("_cell", "_value", "_c", "_before", *[f"_k{i}" for i in range(len(keys))])
    )


def range_cells(df: DataFrame, order: Sequence[Column], out: str, purpose: str) -> DataFrame:
    """The rows, written, with cells taken from the data: ranges of about equal size in ``order``.

    ``order`` starts with the keys. The borders come from a sample of the rows, so a key, or
    a stretch of it, that holds most rows is cut as often as its rows need; written, so that
    all that is computed from the cells reads the same ones.
    """
    return stored(df.repartitionByRange(*order).withColumn(out, F.spark_partition_id()), purpose)


def ordinal(
    df: DataFrame, keys: Sequence[str], cell: Column, order: Sequence[Column], out: str, **kw
) -> DataFrame:
    """``row_number`` per key, cut into cells (see :func:`running_sum`)."""
    return running_sum(df, keys, cell, order, F.lit(1).cast("long"), out, **kw)


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    positions: dict[str, Callable[[Column], Column]],
    step: float | Column,
) -> DataFrame:
    """Exact values at given sorted positions, per key.

    ``positions`` maps an output name to a function from the number of non-null
    values to a zero-based index. Equal values are counted map-side first, then
    a histogram with cells of width ``step`` finds the one cell that holds each
    position, and only that cell is sorted. ``step`` may depend on the keys.
    """
    keys = list(keys)
    width = step if isinstance(step, Column) else F.lit(float(step))
    counts = (
        df.where(value.isNotNull())
        .groupBy(*keys, value.alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_cell", F.floor(F.col("_v") / width))
    )
    histogram = counts.groupBy(*keys, "_cell").agg(F.sum("_c").alias("_cc"))
    per_key = Window.partitionBy(*keys)
    located = histogram.select(
        *keys,
        "_cell",
        (F.sum("_cc").over(per_key.orderBy("_cell")) - F.col("_cc")).alias("_before"),
        "_cc",
        F.sum("_cc").over(per_key).alias("n"),
    )
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("name"), at(F.col("n")).cast("long").alias("index"))
            for name, at in positions.items()
        ]
    )
    targets = (
        located.withColumn("_t", F.explode(wanted))
        .where(
            (F.col("_t.index") >= F.col("_before"))
            & (F.col("_t.index") < F.col("_before") + F.col("_cc"))
        )
        .select(
            *keys,
            "_cell",
            "n",
            F.col("_t.name").alias("_name"),
            (F.col("_t.index") - F.col("_before")).alias("_local"),
        )
    )
    within = Window.partitionBy(*keys, "_cell", "_name").orderBy("_v")
    hits = (
        counts.join(targets, [*keys, "_cell"])
        .withColumn("_upto", F.sum("_c").over(within))
        .where(
            (F.col("_local") < F.col("_upto")) & (F.col("_local") >= F.col("_upto") - F.col("_c"))
        )
    )
    return hits.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in positions],
    )


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    outs: dict[str, float],
    step: float | Column,
    positions: dict[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """Continuous quantiles (linear between neighbours), like ``percentile_cont``, in one pass.

    ``outs`` maps output names to shares; ``positions`` adds values at sorted positions.
    """
    at = {name: (lambda n, p=p: F.lit(float(p)) * (n - 1)) for name, p in outs.items()}
    wanted = dict(positions or {})
    for name, place in at.items():
        wanted[f"_low_{name}"] = lambda n, place=place: F.floor(place(n))
        wanted[f"_high_{name}"] = lambda n, place=place: F.ceil(place(n))
    stats = order_statistics(df, keys, value, wanted, step)

    def between(name: str) -> Column:
        part = at[name](F.col("n")) - F.floor(at[name](F.col("n")))
        low, high = F.col(f"_low_{name}"), F.col(f"_high_{name}")
        return (low + part * (high - low)).alias(name)

    return stats.select(*keys, *[between(name) for name in outs], *(positions or {}))


def quantile(
    df: DataFrame, keys: Sequence[str], value: Column, p: float, out: str, step: float | Column
) -> DataFrame:
    """One continuous quantile, see :func:`quantiles`."""
    return quantiles(df, keys, value, {out: p}, step)
