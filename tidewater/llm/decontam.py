"""Benchmark decontamination by template windows.

Numbers, names and units become typed placeholders, so a question that was only
re-parameterised keeps its template. Windows of template tokens are hash-joined with
those of the benchmark; a window counts only if its slots agree with one substitution
of the item's values, for the whole document or for one place that the item stands at.
A capitalised word that starts a sentence is read both as a word and as a name.
Items that are short or mostly placeholders are also looked up word by word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tidewater.llm.common import hashable, row_hash, unpacked, with_payload
from tidewater.session import stored

# fixed values: units that a quantity may be restated in
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres "
    "kilometer kilometers mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours "
    "day days week weeks month months year years mph kmh percent % $ € £ dollar dollars euro euros cent cents "
    "degree degrees °c °f joule joules watt watts volt volts newton newtons".split()
)
_EDGE = "\"'`´“”‘’«»„()[]{}<>.,;:!?…*#&%$|_-"
_NUMBER = regex.compile(r"[+\-−]?[$€£]?\p{N}[\p{N}.,:/]*(?:st|nd|rd|th)?[%$€£]?")
_QUANTITY = regex.compile(r"([+\-−]?\p{N}[\p{N}.,]*)(\p{L}{1,3}|°[CF])")
_LITERAL, _NUM, _UNIT, _SIZE, _NAME = 0, 1, 2, 3, 4
_SLOTS = ("", "num", "unit", "size", "name")
_MARKS = np.array([0] + [xxhash.xxh64_intdigest(f"<{s}>", 7) for s in _SLOTS[1:]], np.uint64)
_U = np.uint64
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_STEPS = np.array([xxhash.xxh64_intdigest(f"place {k}", 7) | 1 for k in range(64)], np.uint64)


@dataclass(frozen=True)
class Templates:
    """Windows of ``words`` template tokens with at least ``literals`` plain words.

    An item leaks if ``coverage`` of its windows is found, slots agreeing. The filter in
    front of the join has ``2 ** filter_bits`` bits whatever the size of the benchmark;
    what it lets through is joined exactly. An item shorter than a window is found
    wherever its words stand or, with ``short_alone``, only where a whole line or
    sentence (or several) is the item.
    """

    words: int = 5
    literals: int = 3
    coverage: float = 0.8
    filter_bits: int = 24
    short_alone: bool = False


class _Words(dict):
    """What each known word is, in one number; starts anew after ``most`` words.

    60 bits of hash of its bare lower-case form, whether it ends a sentence, whether it
    could be a name, and its kind (2 bits).
    """

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        core = text.strip(_EDGE)
        low = core.lower()
        if core.isalpha():
            kind = _UNIT if low in UNITS else _LITERAL
        elif low in UNITS or text in UNITS:
            kind = _UNIT
        elif _NUMBER.fullmatch(text.strip("\"'()[].,;:!?*#&|")):
            kind = _NUM
        elif (found := _QUANTITY.fullmatch(core)) and found[2].lower() in UNITS:
            kind = _SIZE
        else:
            kind = _LITERAL
        named = len(core) > 1 and core[0].isupper() and core[1:].islower()
        ends = not text[-1].isalpha() and text.rstrip("\"'”’»)]*#&%$|").endswith((".", "!", "?", ":"))
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(low or text, 7) & ~15 | ends << 3 | named << 2 | kind
        return value


class _Read:
    """The words of some texts one after the other: what each is, and where each text starts."""

    def __init__(self, texts: Sequence[str | None], known: _Words):
        lists = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        self.lengths = np.array([len(x) for x in lists], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.text = np.repeat(np.arange(len(lists)), self.lengths)
        self.words = list(chain.from_iterable(lists))
        known_as = np.fromiter(map(known.__getitem__, self.words), np.uint64, len(self.words))
        self.bare = known_as >> _U(4)
        self.kind, marks = (known_as & _U(3)).astype(np.uint8), known_as & _U(12)
        first = np.ones(len(self.words), bool)  # of a sentence
        first[1:] = marks[:-1] >= 8
        first[self.starts[self.lengths > 0]] = True
        named = (self.kind == _LITERAL) & (marks & _U(4) != 0)
        self.kind[named & ~first] = _NAME
        self.maybe = named & first
        self.first = first
        self.token = np.where(self.kind == _LITERAL, self.bare, _MARKS[self.kind])

    def runs(self, length: int, exactly: bool = False) -> np.ndarray:
        """First words of the runs of ``length`` words of one text; ``exactly``: of texts that are no longer."""
        at = np.arange(max(0, len(self.words) - length + 1))
        at = at[self.text[at] == self.text[at + length - 1]]
        return at[self.lengths[self.text[at]] == length] if exactly else at

    def place(self, at: np.ndarray) -> np.ndarray:
        return at - self.starts[self.text[at]]


def _summed(token: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A hash that is linear in the tokens, before its last mix: one of them changes it by a fixed step."""
    total = np.full(len(at), length, np.uint64) * _MIX
    for k in range(length):
        total += token[at + k] * _STEPS[k]
    return total


def _mixed(total: np.ndarray) -> np.ndarray:
    total = (total ^ (total >> _U(33))) * _MIX
    total = (total ^ (total >> _U(29))) * _STEP
    return total ^ (total >> _U(32))


def readings(read: _Read, rule: Templates) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and first word of each usable window, then of the same with first words of sentences as names.

    Adds the bits of the places in the window that are read so; a text shorter than a
    window is one window. Such a reading keeps at least one plain word less than a usable
    window. All subsets of a window's possible names are sums of the steps of its members.
    """
    hashes, places, masks = [], [], []
    for n in range(1, rule.words + 1):
        at = read.runs(n, exactly=n < rule.words)
        plain, maybe = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for k in range(n):
            plain += read.kind[at + k] == _LITERAL
            maybe |= read.maybe[at + k].astype(np.int64) << k
        least = min(rule.literals, n)
        usable = plain >= least
        at, plain, maybe = at[usable], plain[usable], maybe[usable]
        total = _summed(read.token, at, n)
        hashes.append(_mixed(total))
        places.append(at)
        masks.append(np.zeros(len(at), np.int64))
        also = maybe != 0
        at, plain, maybe, subset = at[also], plain[also], maybe[also], total[also][:, None]
        if not len(at):
            continue
        for k in range(n):
            step = (_MARKS[_NAME] - read.token[at + k]) * _STEPS[k]
            subset = np.concatenate([subset, subset + step[:, None]], axis=1)
        mask = np.arange(1 << n)
        names = np.array([m.bit_count() for m in mask.tolist()])
        fits = (maybe[:, None] & mask == mask) & (plain[:, None] - names >= least - 1) & (mask > 0)
        window, chosen = np.nonzero(fits)
        hashes.append(_mixed(subset[window, chosen]))
        places.append(at[window])
        masks.append(chosen)
    return np.concatenate(hashes), np.concatenate(places), np.concatenate(masks)


def windows(text: str | None, rule: Templates, known: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Hash and first word of each usable window of one text, with its slot kinds and words.

    A text without words has none. A word that starts a sentence is no name here.
    """
    read = _Read([text], known)
    total, at, mask = readings(read, rule)
    return total[mask == 0], at[mask == 0], read.kind, read.words


def _alone(read: _Read, texts: Sequence[str | None], at: np.ndarray, length: int) -> np.ndarray:
    """Which runs of ``length`` words start and end with a line or a sentence."""
    known: dict[int, set[int]] = {}
    out = []
    for p, text in zip(at.tolist(), read.text[at].tolist()):
        if text not in known:  # places where lines start; the one after the last word counts
            sizes = [len(line.split()) for line in (texts[text] or "").encode("utf-8", "surrogatepass").split(b"\n")]
            known[text] = set(accumulate(sizes, initial=int(read.starts[text])))
        starts = lambda q: q in known[text] or q < len(read.first) and bool(read.first[q])  # noqa: E731, B023
        out.append(starts(p) and starts(p + length))
    return np.array(out, bool)


_GROUP_WORDS = 100_000  # words of the texts that are read together: bounds the arrays, not the texts


def _groups(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "") // 4
        if size >= _GROUP_WORDS:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def template_windows(
    rows: DataFrame, rule: Templates, bits: np.ndarray | None = None, lengths: tuple[int, ...] | None = None
) -> DataFrame:
    """``key``, ``hash``, ``at``, ``slots``, ``n`` (usable windows) and ``exact`` from ``key``, ``text``.

    With ``bits``, only windows that the filter lets through. ``exact`` is 0 or the length of
    an exact window. Those are added for each of ``lengths``; without ``lengths``, only where
    a text is shorter than a window or less than half of its windows are usable.
    """
    shift = np.uint64(64 - rule.filter_bits)

    def passes(hashes: np.ndarray) -> np.ndarray:
        bit = hashes >> shift
        return (bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def found(texts: list[str | None], known: _Words) -> Iterator[tuple]:
        """Text, hash, place, slots, windows of the text and exact length of what passes."""
        read = _Read(texts, known)
        hashes, at, masks = readings(read, rule)
        usable = np.bincount(read.text[at[masks == 0]], minlength=len(texts))
        if bits is not None:
            hit = passes(hashes)
            hashes, at, masks = hashes[hit], at[hit], masks[hit]
        text = read.text[at]
        slots = []
        for p, end, mask in zip(at.tolist(), (read.starts + read.lengths)[text].tolist(), masks.tolist()):
            slots.append(
                [
                    f"{_SLOTS[read.kind[i] or _NAME]}:{read.words[i].decode('utf-8', 'replace').strip(_EDGE).lower()}"
                    for i in range(p, min(p + rule.words, end))
                    if read.kind[i] or mask >> (i - p) & 1
                ]
            )
        yield text, hashes, read.place(at), slots, usable[text], np.zeros(len(at), np.int64)
        few = (read.lengths < rule.words) | (2 * usable < read.lengths - rule.words + 1)
        asked_length = np.where(few, np.minimum(read.lengths, rule.words), 0)
        for length in lengths if lengths is not None else set(asked_length.tolist()) - {0}:
            at = read.runs(length)
            if lengths is None:
                at = at[asked_length[read.text[at]] == length]
            hashes = _mixed(_summed(read.bare, at, length) ^ _STEP)
            if bits is not None:
                hit = passes(hashes)
                hashes, at = hashes[hit], at[hit]
                if rule.short_alone and length < rule.words:
                    alone = _alone(read, texts, at, length)
                    hashes, at = hashes[alone], at[alone]
            text = read.text[at]
            count = np.maximum(read.lengths[text] - length + 1, 0)
            yield text, hashes, read.place(at), [[]] * len(at), count, np.full(len(at), length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            for start, texts in _groups(batch.column(1).to_pylist()):
                for text, hashes, at, slots, n, exact in found(texts, known):
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(text + start)),
                            pa.array(hashes.view(np.int64)),
                            pa.array(at),
                            pa.array(slots, pa.list_(pa.string())),
                            pa.array(n.astype(np.int64)),
                            pa.array(exact.astype(np.int64)),
                        ],
                        ["key", "hash", "at", "slots", "n", "exact"],
                    )

    schema = rows.select("key").schema.add("hash", "long").add("at", "long").add("slots", ArrayType(StringType())).add("n", "long").add("exact", "long")
    return rows.select("key", F.col("text").cast("string")).mapInArrow(run, schema)


def _filter(asked: DataFrame, rule: Templates) -> np.ndarray:
    """One bit per prefix of a benchmark hash: ``2 ** filter_bits`` bits at most reach the driver."""
    prefix = (F.shiftrightunsigned("hash", 64 - rule.filter_bits) + 1).alias("p")
    parts = (
        asked.select(prefix)
        .groupBy(F.expr("bitmap_bucket_number(p)").alias("bucket"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits"))
        .toLocalIterator()
    )
    out = np.zeros(1 << max(rule.filter_bits - 3, 12), np.uint8)
    for part in parts:  # buckets of 32768 bits, numbered from 1
        held = np.frombuffer(bytes(part["bits"]), np.uint8)
        out[(part["bucket"] - 1) * 4096 :][: len(held)] |= held
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, rule: Templates = Templates()) -> DataFrame:
    """``key``, ``item``, ``items``, ``n_windows``, ``n_found``, ``coverage``, ``n_changed``.

    ``docs`` has ``key``, ``text``; ``benchmark`` has ``item``, ``text``. One row per
    document and benchmark text that it contains: of equal benchmark texts the smallest
    ``item`` stands for ``items`` rows. A window is found if its slot values are the ones
    that the document uses most for the item's values (a slot value kept as it is
    counts like any other); ``n_changed`` values differ from the item's. The same is asked
    of each occurrence alone (windows as far apart as in the item), and the best counts:
    so variants of one question in a document do not mix. Items with few usable windows
    leak by their exact windows, too; an item shorter than a window stands where its words
    do. Repeated documents with
    equal keys count once. Null and empty texts neither leak nor are leaked.
    """
    items = benchmark.groupBy("text").agg(F.min("item").alias("key"), F.count(F.lit(1)).alias("items"))
    asked = stored(
        template_windows(items, rule)
        .join(items.select(F.col("key").alias("_k"), "items"), F.col("key").eqNullSafe(F.col("_k")))
        .drop("_k"),
        "templates",
    )
    lengths = tuple(sorted(r[0] for r in asked.where("exact > 0").select("exact").distinct().collect()))  # at most rule.words
    found = template_windows(docs, rule, _filter(asked, rule), lengths).drop("n")
    b, d = asked.alias("b"), found.alias("d")
    hits = stored(
        d.join(b, ["hash", "exact"])
        .select(
            F.col("d.key").alias("key"),
            F.col("b.key").alias("item"),
            F.col("b.at").alias("at"),
            F.col("b.n").alias("n"),
            F.col("b.items").alias("items"),
            "exact",
            F.when(F.col("exact") == 0, F.col("d.at") - F.col("b.at")).alias("occurrence"),
            F.arrays_zip(F.col("b.slots").alias("asked"), F.col("d.slots").alias("used")).alias("slots"),
        )
        .distinct(),
        "template-hits",
    )
    hits = hits.withColumn("occurrence", F.explode(F.array_distinct(F.array(F.lit(None).cast("long"), "occurrence"))))
    by = ["key", "item", "exact", "occurrence"]
    pairs = hits.select(*by, "at", F.explode("slots").alias("s")).select(*by, "at", "s.*")
    used = pairs.groupBy(*by, "asked", "used").agg(F.count_distinct("at").alias("times"))
    chosen = used.groupBy(*by, "asked").agg(
        F.max_by("used", F.struct("times", F.col("asked") == F.col("used"), "used")).alias("used")
    )
    per_item = chosen.groupBy(F.col("key").alias("k"), F.col("item").alias("i"), F.col("exact").alias("e"), F.col("occurrence").alias("o")).agg(
        F.map_from_entries(F.collect_list(F.struct("asked", "used"))).alias("chosen"),
        F.sum((F.col("asked") != F.col("used")).cast("long")).alias("n_changed"),
    )
    agrees = F.forall("slots", lambda s: F.try_element_at("chosen", s["asked"]) == s["used"])
    same = F.lit(True)
    for name, other in zip(by, "kieo"):
        same = same & F.col(name).eqNullSafe(F.col(other))
    counted = (
        hits.join(per_item, same, "left")
        .where(agrees)
        .groupBy(*by, "items")
        .agg(
            F.max("n").alias("n_windows"),
            F.count_distinct("at").alias("n_found"),
            F.coalesce(F.max("n_changed"), F.lit(0)).cast("long").alias("n_changed"),
        )
    )
    share = F.col("n_found") / F.col("n_windows")
    best = F.max(F.struct(share.alias("share"), "n_found", F.col("occurrence").isNull().alias("whole"), (-F.col("n_changed")).alias("kept"), "n_windows"))
    return (
        counted.groupBy("key", "item", "items")
        .agg(best.alias("best"))
        .select("key", "item", "items", "best.n_windows", "best.n_found", (-F.col("best.kept")).alias("n_changed"))
        .withColumn("coverage", F.col("n_found") / F.col("n_windows"))
        .where(F.col("coverage") >= rule.coverage)
    )


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    rule: Templates = Templates(),
) -> DataFrame:
    """:func:`leaks` with the ids of the documents; rows with equal id and text count once."""
    rows = docs.select(F.struct(docs[f"`{id}`"].alias("id"), row_hash(docs, [id, text]).alias("row")).alias("key"), docs[f"`{text}`"].alias("text"))
    asked = benchmark.select(benchmark[f"`{item}`"].alias("item"), benchmark["text"])
    return leaks(rows, asked, rule).select(
        F.col("key.id").alias(id), F.col("item").alias(item), "items", "n_windows", "n_found", "coverage", "n_changed"
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", rule: Templates = Templates(short_alone=True)
) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark text, with their own columns.

    A benchmark text shorter than a window drops only rows of which it is a whole line
    or sentence: a single word stands in many clean texts.

    The list of rows to drop is written first, so that Spark knows its size and sends it
    to the texts only if it is small; otherwise both sides are shuffled.
    """
    packed = with_payload(docs)
    rows = docs.select(row_hash(docs, hashable(docs)).alias("key"), docs[f"`{text}`"].alias("text"))
    asked = benchmark.select(benchmark[f"`{item}`"].alias("item"), benchmark["text"])
    bad = stored(leaks(rows, asked, rule).select(F.col("key").alias("_id")).distinct(), "leaking-rows")
    return unpacked(packed.join(bad, "_id", "left_anti"))
