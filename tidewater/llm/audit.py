"""How filters act on each other: what each removes, in every order of all of them.

A document is only the set of filters that it fails, a mask. All documents of a part
with the same mask form a cell, so that 2^k cells say everything about k filters. A
Gray-code walk goes through all sets of active filters, switching one filter at a time:
each cell counts how many active filters it fails, and the survivors change by the
cells whose counter leaves or reaches zero. The survivors of all 2^k sets are stored;
a step of an order is the difference of two of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import WORD, column_or_null

FILTERS = "ABCDE"
STEPS = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)
#: fixed values of the filters: least words, least per cent of different words, most per cent of capitals, symbols
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 100, 80, 10, "[#$%&*|]"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def own_failures(text: Column) -> Column:
    """Bits 0 to 3: the filters A to D, which look at one text alone (null: empty)."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, WORD.replace("[^", "[")), "")
    n, chars = F.size(words), F.char_length(text)
    capitals = chars - F.char_length(F.translate(text, _CAPITALS, ""))
    fails = (
        n < MIN_WORDS,
        100 * F.size(F.array_distinct(words)).cast("long") < MIN_DISTINCT * n.cast("long"),
        100 * capitals.cast("long") > MAX_CAPITALS * chars.cast("long"),
        text.rlike(SYMBOLS),
    )
    mask = F.lit(0)
    for bit, fail in enumerate(fails):
        mask = mask + F.when(fail, F.lit(1 << bit)).otherwise(F.lit(0))
    return mask


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents by part and by the filters they fail.

    docs: ``doc_id, text, lang``; a null language is the part ``''``. labels: ``doc_id,
    quality, toxic``; of several rows of a document one is enough to call it good or
    toxic. Bit 4 (E) is a text equal to that of a smaller id: rows with the smallest id
    pass, however many they are, and so do rows without an id, which nothing is smaller
    than. Texts are told apart by 128 bits of hash. Only slim rows are shuffled, and rows
    that agree are counted before each shuffle, so a text, part or id that a third of the
    rows share is one row of each task.
    """
    text = F.coalesce(docs["`text`"], F.lit(""))
    slim = docs.select(
        docs["`doc_id`"].alias("id"),
        F.coalesce(column_or_null(docs, "lang", "string"), F.lit("")).alias("part"),
        own_failures(text).alias("own"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit("other seed"), text).alias("h2"),
    )
    rows = slim.groupBy("id", "part", "own", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    known = labels.where(labels["`doc_id`"].isNotNull()).groupBy(labels["`doc_id`"].alias("label_id")).agg(
        F.max(F.coalesce(labels["`quality`"] == 1, F.lit(False))).alias("is_good"),
        F.max(F.coalesce(labels["`toxic`"] == 1, F.lit(False))).alias("is_toxic"),
    )
    # rows without an id have no label; their hash spreads them over the tasks of the join
    tagged = rows.withColumn("key", F.coalesce(F.col("id"), F.col("h1"))).join(
        known, (F.col("key") == F.col("label_id")) & F.col("id").isNotNull(), "left"
    )
    texts = tagged.groupBy(
        "h1",
        "h2",
        "part",
        "own",
        F.coalesce("is_good", F.lit(False)).alias("is_good"),
        F.coalesce("is_toxic", F.lit(False)).alias("is_toxic"),
    ).agg(
        F.sum("n").alias("n"),
        F.min("id").alias("first"),
        F.coalesce(F.min_by("n", "id"), F.lit(0)).alias("n_first"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("n_without"),
    )
    same_text = Window.partitionBy("h1", "h2")  # as many rows as parts and labels, not as copies
    firsts = F.when(F.col("first") == F.min("first").over(same_text), F.col("n_first")).otherwise(F.lit(0))
    split = texts.withColumn("passing", firsts + F.col("n_without"))
    both = F.array(
        F.struct(F.col("own").alias("mask"), F.col("passing").alias("n")),
        F.struct((F.col("own") + 16).alias("mask"), (F.col("n") - F.col("passing")).alias("n")),
    )
    counted = split.select("part", "is_good", "is_toxic", F.explode(both).alias("c")).where("c.n > 0")
    return counted.groupBy("part", F.col("c.mask").alias("mask")).agg(
        F.sum("c.n").alias("n"),
        F.sum(F.when(F.col("is_good"), F.col("c.n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("is_toxic"), F.col("c.n")).otherwise(0)).alias("toxic"),
    )


def survivors(cells: np.ndarray) -> np.ndarray:
    """What every set of active filters leaves of ``cells``, by a Gray-code walk.

    ``cells[mask]`` are the counts (any number of them) of what fails just the filters
    of ``mask``; so are ``result[active]`` of what fails none of ``active``.
    """
    sets = len(cells)
    failing = np.zeros(sets, dtype=np.int64)  # active filters that a cell fails
    masks = np.arange(sets)
    left = cells.sum(axis=0)
    states = np.empty_like(cells)
    states[0] = left
    active = 0
    for step in range(1, sets):
        bit = step & -step  # the one filter in which neighbours of the code differ
        hit = masks & bit > 0
        if active & bit:
            failing[hit] -= 1
            left = left + cells[hit & (failing == 0)].sum(axis=0)
        else:
            left = left - cells[hit & (failing == 0)].sum(axis=0)
            failing[hit] += 1
        active ^= bit
        states[active] = left
    return states


def all_orders(cells: np.ndarray, filters: Sequence[str]) -> pd.DataFrame:
    """Every step of every order of ``filters``; ``cells`` holds documents, good and toxic ones."""
    k = len(filters)
    states = survivors(cells)
    orders = np.array(list(permutations(range(k))))
    bits = 1 << orders
    after = np.cumsum(bits, axis=1)  # the active filters after each step
    lost = states[after - bits] - states[after]
    fails = np.array([cells[np.arange(1 << k) & (1 << f) > 0, 0].sum() for f in range(k)])
    shapley = np.zeros(k, dtype=np.int64)
    np.add.at(shapley, orders, lost[..., 0])
    return pd.DataFrame(
        {
            "filter_order": np.repeat(["".join(filters[f] for f in order) for order in orders], k),
            "step": np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders)),
            "kept": states[after][..., 0].ravel(),
            "removed": lost[..., 0].ravel(),
            "redundant": (fails[orders] - lost[..., 0]).ravel(),
            "unique_fails": cells[bits, 0].ravel(),
            "good_lost": lost[..., 1].ravel(),
            "toxic_lost": lost[..., 2].ravel(),
            "shapley": shapley[orders].ravel(),
        }
    )


def audited(cells: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """One row per part, order of ``filters`` and step, of cells as :func:`mask_cells` gives them.

    Bit i of ``mask`` is a failure of ``filters[i]``. A part is at most 2^k small rows,
    and gives k! times k; an empty table gives none. Cells of the same part and mask are
    added up.
    """
    filters = list(filters)

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((1 << len(filters), 3), dtype=np.int64)
        np.add.at(counts, part["mask"].to_numpy(), part[["n", "good", "toxic"]].to_numpy())
        out = all_orders(counts, filters)
        out.insert(0, "part", part["part"].iloc[0])
        return out

    return cells.groupBy("part").applyInPandas(walk, STEPS)
