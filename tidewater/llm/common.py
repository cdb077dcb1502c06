"""What the corpus operators share: row identity, global order, payload."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.session import stored

#: A word, in every engine: a run of anything but the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def row_hash(df: DataFrame, columns: Sequence[str]) -> Column:
    """64-bit identity of a row over ``columns``; a null differs from an empty text.

    Rows that agree in it are taken as interchangeable copies.
    """
    parts = []
    for name in columns:
        parts += [df[f"`{name}`"], df[f"`{name}`"].isNull()]
    return F.xxhash64(*parts)


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    """The column, or nulls of its type where the table has none."""
    return df[f"`{name}`"] if name in df.columns else F.lit(None).cast(kind)


def range_sorted(df: DataFrame, order: Sequence[str], purpose: str) -> DataFrame:
    """The slim rows in one global order, written, with the range they fell into.

    Adds ``_range`` (ranges are ascending in ``order``) and ``_tie``, which tells
    rows apart that agree in ``order``; the order ends with it. The bounds come from
    a sample of the rows, so a hot key is spread over many ranges. Written, so that
    totals and rows read the same ranges.
    """
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_last() for c in order] + [F.col("_tie")]
    dealt = tied.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id())
    return stored(dealt, purpose)


def before_in_order(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str
) -> DataFrame:
    """Exclusive running sum of ``value`` per key over rows of :func:`range_sorted`.

    Totals per key and range are aggregated map-side; their list is as long as the
    number of ranges, and only the rows of one range meet in one task.
    """
    tagged = rows.withColumn("_value", value)
    totals = tagged.groupBy(*keys, "_range").agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_range").alias("_r"),
        F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"),
    )
    on = F.col("_range") == F.col("_r")
    for i, key in enumerate(keys):
        on = on & F.col(key).eqNullSafe(F.col(f"_k{i}"))
    inside = (
        Window.partitionBy(*keys, "_range")
        .orderBy(*[F.col(c).asc_nulls_last() for c in order], "_tie")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        tagged.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .join(offsets, on)
        .withColumn(out, (F.col("_offset") + F.col("_inside")).cast("long"))
        .drop("_inside", "_value", "_offset", "_r", *[f"_k{i}" for i in range(len(keys))])
    )


def with_payload(docs: DataFrame) -> DataFrame:
    """Every column in one struct ``_row`` next to ``_id``, so that no name can clash."""
    return docs.select(
        row_hash(docs, hashable(docs)).alias("_id"),
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"),
    )


def hashable(docs: DataFrame) -> list[str]:
    """The columns that can be hashed (all but maps and variants)."""
    bad = ("map<", "variant")
    return [c for c, kind in docs.dtypes if not any(b in kind for b in bad)]


def numbered_copies(rows: DataFrame, id: str, *order: str) -> DataFrame:
    """Number the copies of each ``id`` from 1 (``_copy``), so that one decision meets one row."""
    by = Window.partitionBy(id).orderBy(*(order or (F.lit(0),)))
    return rows.withColumn("_copy", F.row_number().over(by))


def unpacked(packed: DataFrame, *more: Column) -> DataFrame:
    return packed.select("_row.*", *more)
