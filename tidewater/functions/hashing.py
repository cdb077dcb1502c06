"""Hash expressions that give the same value on every cluster and engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_hex(value: Column) -> Column:
    return F.md5(value.cast("string"))


def hash_bucket(value: Column, buckets: int = 100) -> Column:
    """First six hex digits of the md5 of the text form, modulo ``buckets``."""
    return (F.conv(F.left(md5_hex(value), F.lit(6)), 16, 10).cast("long") % buckets).cast("int")


def seeded(seed: int, *parts: Column) -> Column:
    """Hex hash of the parts under a seed: a repeatable random order on any engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def draw(n: Column, seed: int, *parts: Column) -> Column:
    """A repeatable draw from ``0 .. n-1`` for the given parts (batch, slot, ...)."""
    return F.conv(F.left(seeded(seed, *parts), F.lit(8)), 16, 10).cast("long") % n


def stratum(slot: Column, slots: int, n: Column, seed: int, *parts: Column) -> Column:
    """A draw for one of ``slots`` equal strata of ``0 .. n-1``; distinct if ``n >= slots``."""
    low = F.floor(slot * n / slots)
    high = F.floor((slot + 1) * n / slots)
    return low + draw(F.greatest(high - low, F.lit(1).cast("long")), seed, *parts, slot)


_ROUNDS = 4
_WALK = 24  # steps back into the range: a cell of the square beyond n is met with probability below 1 / sqrt(n)


def permuted(at: Column, n: Column, seed: int, *parts: Column) -> Column:
    """Where ``at`` stands in a keyed permutation of ``0 .. n-1``; the parts are the key.

    A Feistel network over a rectangle of ``ceil(sqrt(n))`` columns and just enough rows:
    each round shifts one coordinate by a hash of the other. A place beyond ``n`` goes
    through again until it lies in the range, so nothing is sorted or stored, and any
    place can be asked for alone.
    """
    columns = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    rows = F.ceil(n / columns).cast("long")
    spread = lambda i, v: F.conv(F.left(seeded(seed, *parts, i, v), F.lit(8)), 16, 10).cast("long")

    def step(s: Column, i: Column) -> Column:
        across = F.struct(((s["c"] + spread(i, s["r"])) % columns).alias("c"), s["r"].alias("r"))
        down = F.struct(s["c"].alias("c"), ((s["r"] + spread(i, s["c"])) % rows).alias("r"))
        return F.when(i % 2 == 0, across).otherwise(down)

    def shuffled(x: Column) -> Column:
        start = F.struct((x % columns).alias("c"), F.floor(x / columns).alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(_ROUNDS - 1)), start, step, lambda s: s["r"] * columns + s["c"])

    # a negative number has not been through yet
    walk = lambda x, _: F.when(x < 0, shuffled(-1 - x)).when(x >= n, shuffled(x)).otherwise(x)
    beyond = F.least(columns * rows - n, F.lit(_WALK)).cast("int")
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), beyond), -1 - at.cast("long"), walk))
