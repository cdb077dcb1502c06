"""SimHash near-duplicates through an inverted index of byte positions.

Two 64-bit fingerprints that differ in at most 3 bits agree in at least 5 of their 8
bytes. A list per single (position, byte) would hold a 256th of all fingerprints, so
the index lists are those of 5 positions together: each of the 56 choices of 5
positions, with the bytes found there. A pair that reaches the guaranteed minimum of
5 shared positional bytes meets in at least one list, and in a list every pair has
reached it; the tally and the bit count are then verified. A list is bounded, since
its members differ in 3 bytes only (2^24 values).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import numbered_copies, unpacked, with_payload
from tidewater.llm.components import components
from tidewater.session import stored

BYTES = 8
_ONE = np.uint64(1)
_BITS = np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None, words: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles, repeats included.

    A-Z are lower-cased. Fewer words than a shingle make one shingle of all of them;
    no word at all (also a null text) gives 0.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), 42)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist())
    hashes = np.array([digest(joined[s:e], 42) for s, e in spans], dtype=np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((_ONE << _BITS[2 * counts > len(hashes)]).sum(dtype=np.uint64))


def fingerprints(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with ``fingerprint`` (bits as a signed long) in place of ``text``."""
    rest = [c for c in rows.columns if c != text]
    ordered = rows.select(F.col(text).cast("string"), *rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(t.as_py()) for t in batch.column(0)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(bits.view(np.int64))], [*rest, "fingerprint"]
            )

    return ordered.mapInArrow(run, rows.select(*rest).schema.add("fingerprint", "long"))


def _find(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member index that each index reaches through the links ``i``-``j``."""
    while True:
        low = np.minimum(parent[i], parent[j])
        before = parent.copy()
        np.minimum.at(parent, i, low)
        np.minimum.at(parent, j, low)
        parent = parent[parent]
        if np.array_equal(parent, before):
            return parent


def _flips(positions: tuple[int, ...], most: int) -> np.ndarray:
    """All masks of 1 to ``most`` bits in the bytes that a list leaves open."""
    bits = [8 * p + b for p in range(BYTES) if p not in positions for b in range(8)]
    return np.array(
        [sum(1 << b for b in c) for n in range(1, most + 1) for c in combinations(bits, n)], np.uint64
    )


def _verified(x: np.ndarray, most: int, shared: int) -> np.ndarray:
    """The pairs of xor values that share enough positional bytes and few bits differ."""
    tally = sum(((x >> np.uint64(8 * p)) & np.uint64(255)) == 0 for p in range(BYTES))
    return (tally >= shared) & (np.bitwise_count(x) <= most)


def list_links(members: np.ndarray, positions: tuple[int, ...], most: int, pairwise: int) -> np.ndarray:
    """For each member of one list, the smallest member that it reaches inside the list.

    Up to ``pairwise`` members are compared with each other; a longer list looks up
    every allowed flip of its open bits, which is linear in its length. Both are exact.
    """
    n = len(members)
    parent = np.arange(n)
    if n <= pairwise:
        i, j = np.nonzero(np.triu(_verified(members[:, None] ^ members[None, :], most, BYTES - most), 1))
        return members[_find(parent, i, j)] if len(i) else members
    order = np.sort(members)
    left, right = [], []
    for mask in _flips(positions, most):
        other = order ^ mask
        at = np.minimum(np.searchsorted(order, other), n - 1)
        hit = np.nonzero((order[at] == other) & (order < other))[0]
        left.append(hit)
        right.append(at[hit])
    parent = _find(parent, np.concatenate(left), np.concatenate(right))
    return order[parent][np.searchsorted(order, members)]


def fingerprint_links(prints: DataFrame, most: int = 3, pairwise: int = 1024) -> DataFrame:
    """Links ``a``, ``b`` between the distinct values of ``fingerprint`` (none null).

    They connect exactly the values that chains of at most ``most`` (0 to 3) differing
    bits connect: per list a star to the smallest member of each group, not all pairs.
    """
    choices = list(combinations(range(BYTES), BYTES - most))
    masks = [sum(255 << (8 * p) for p in c) for c in choices]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    postings = prints.select("fingerprint").distinct().select(
        "fingerprint",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(s).alias("choice"),
                        F.col("fingerprint").bitwiseAND(F.lit(m).cast("long")).alias("bytes"),
                    )
                    for s, m in enumerate(signed)
                ]
            )
        ).alias("list"),
    )
    ordered = (
        postings.select("list.choice", "list.bytes", "fingerprint")
        .repartition("choice", "bytes")
        .sortWithinPartitions("choice", "bytes", "fingerprint")
    )

    def links(choice: np.ndarray, held: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate(([True], (choice[1:] != choice[:-1]) | (held[1:] != held[:-1])))
        starts = np.nonzero(new)[0]
        ends = np.append(starts[1:], len(value))
        a, b = [], []
        two = starts[ends - starts == 2]
        fits = _verified(value[two] ^ value[two + 1], most, BYTES - most)
        a.append(value[two][fits])
        b.append(value[two + 1][fits])
        for k in np.nonzero(ends - starts > 2)[0]:
            members = value[starts[k] : ends[k]]
            lowest = list_links(members, choices[choice[starts[k]]], most, pairwise)
            moved = lowest != members
            a.append(members[moved])
            b.append(lowest[moved])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []  # the batches of a list that has not ended yet
        for batch in batches:
            if not batch.num_rows:
                continue
            choice = batch.column(0).to_numpy()
            held = batch.column(1).to_numpy()
            value = batch.column(2).to_numpy().view(np.uint64)
            kept.append((choice, held, value))
            last = (choice != choice[-1]) | (held != held[-1])
            end = int(np.nonzero(last)[0][-1]) + 1 if last.any() else 0
            first = kept[0]
            if not end and (first[0][0], first[1][0]) == (choice[-1], held[-1]):
                continue
            whole = [np.concatenate(x) for x in zip(*kept)]
            cut = len(whole[0]) - (len(choice) - end)
            yield links(*[x[:cut] for x in whole])
            kept = [tuple(x[cut:] for x in whole)]
        if kept:
            yield links(*[np.concatenate(x) for x in zip(*kept)])

    return ordered.mapInArrow(run, "a long, b long").distinct()


def classes(prints: DataFrame, most: int = 3) -> DataFrame:
    """``fingerprint``, ``label``: the smallest fingerprint of its component."""
    labels = components(fingerprint_links(prints, most))
    return (
        prints.select("fingerprint")
        .distinct()
        .join(labels, F.col("fingerprint") == F.col("node"), "left")
        .select("fingerprint", F.coalesce("label", "fingerprint").alias("label"))
    )


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", most: int = 3) -> DataFrame:
    """``id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    ``component_id`` is the smallest id that links of at most ``most`` differing bits
    reach, equal fingerprints included; null if no id there is set. Rows without words
    share fingerprint 0 and are linked like any other. Repeated rows stay repeated.
    """
    slim = docs.select(docs[f"`{id}`"].alias("id"), docs[f"`{text}`"].alias("text"))
    prints = stored(fingerprints(slim), "simhash")
    smallest = prints.groupBy("fingerprint").agg(F.min("id").alias("low"))
    labels = stored(classes(smallest, most).join(smallest, "fingerprint"), "simhash-classes")
    heads = labels.groupBy("label").agg(F.min("low").alias("component_id"))
    named = labels.join(heads, "label").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select(
        F.col("id").alias(id),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", most: int = 3) -> DataFrame:
    """One row of each component with its own columns: the smallest id (nulls last).

    Between rows with that id, the smallest row hash decides; of equal rows one stays.
    """
    packed = with_payload(docs)
    slim = packed.select("_id", F.col(f"_row.`{id}`").alias("id"), F.col(f"_row.`{text}`").alias("text"))
    prints = stored(fingerprints(slim), "simhash")
    rank = F.struct(F.col("id").isNull().alias("late"), "id", "_id")
    lowest = prints.groupBy("fingerprint").agg(F.min(rank).alias("low"))
    labelled = classes(lowest, most).join(lowest, "fingerprint")
    keepers = stored(
        labelled.groupBy("label").agg(F.min("low").alias("low")).select(F.col("low._id").alias("_id")),
        "simhash-keepers",
    )
    once = numbered_copies(packed, "_id").where("_copy = 1").drop("_copy")
    return unpacked(once.join(keepers, "_id", "left_semi"))

