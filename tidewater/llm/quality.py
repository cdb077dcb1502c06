"""Quality rules by compression bands.

Repetitive text compresses too well, random text hardly at all. What is normal
depends on the length, since a short text has no history to refer to; so the zstd
ratio (bytes / compressed bytes) of the whole text and of each fixed chunk is held
against the band of its own length.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_SYMBOLS = b"#*$%&|<>"
_BREAKS = b" \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Band:
    """Ratios allowed for texts of less than ``below`` bytes (None: any length)."""

    below: int | None
    least: float
    most: float


@dataclass(frozen=True)
class Rules:
    """Limits of the base rules and of the bands.

    A text fails its base with fewer than ``min_words`` words, or with more than
    ``max_repeat`` per cent of its words in 3-word windows that the text repeats.
    It fails the bands if its whole ratio, or that of more than ``bad_chunks`` of its
    chunks of ``chunk_bytes``, lies outside the band of that length.
    """

    min_words: int = 50
    max_repeat: int = 50
    chunk_bytes: int = 4096
    bad_chunks: float = 0.5
    level: int = 3
    bands: Sequence[Band] = field(
        default=(
            Band(256, 0.80, 2.5),
            Band(1024, 1.05, 3.0),
            Band(4096, 1.30, 3.5),
            Band(32768, 1.40, 4.5),
            Band(None, 1.50, 6.0),
        )
    )


BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
JUDGED = f"{BASE}, kept boolean, ratio double, n_chunks long, n_bad_chunks long, reason string"


def base_counts(data: bytes) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in repeated 3-word windows."""
    words = data.split()
    n = len(words)
    breaks = sum(data.count(b) for b in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
    chars = len(data.decode("utf-8", "replace")) - breaks
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip(_BREAKS)]
    repeated = 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            seen, last = Counter(windows), -1
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    repeated += i + 2 - max(last, i - 1)
                    last = i + 2
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def _band(size: int, bands: Sequence[Band]) -> Band:
    return next((b for b in bands if b.below is None or size < b.below), bands[-1])


def judge(text: str | None, rules: Rules, packer: zstandard.ZstdCompressor) -> tuple:
    """The values of ``JUDGED`` for one text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n, chars, symbols, dup_lines, repeated = base_counts(data)
    failed = n < rules.min_words or 100 * repeated > rules.max_repeat * n
    ratio = len(data) / len(packer.compress(data)) if data else 0.0
    chunks = bad = 0
    for at in range(0, len(data), rules.chunk_bytes):
        part = data[at : at + rules.chunk_bytes]
        if at and len(part) < rules.chunk_bytes // 4:
            break  # a short tail says little; the whole ratio covers it
        chunks += 1
        band = _band(len(part), rules.bands)
        bad += not band.least <= len(part) / len(packer.compress(part)) <= band.most
    band = _band(len(data), rules.bands)
    reason = None
    if failed:
        reason = "base"
    elif ratio > band.most:
        reason = "repetitive"
    elif ratio < band.least:
        reason = "incompressible"
    elif bad > rules.bad_chunks * chunks:
        reason = "chunks"
    return n, chars, symbols, dup_lines, repeated, failed, reason is None, ratio, chunks, bad, reason


def _restored(text: str) -> Rules:
    values = json.loads(text)
    return Rules(**values | {"bands": tuple(Band(**b) for b in values["bands"])})


def judged(docs: DataFrame, rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """Every row of ``docs`` in a struct ``row``, with the values of ``JUDGED`` next to it.

    One narrow pass, no shuffle. A null text counts as empty; a text without words
    fails its base. Repeated rows are judged each for itself.
    """
    given = json.dumps(asdict(rules))
    packed = docs.select(
        docs[f"`{text}`"].cast("string").alias("text"),
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
    )
    fields = [x.split() for x in JUDGED.split(", ")]
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = _restored(given)
        packer = zstandard.ZstdCompressor(level=limits.level)
        for batch in batches:
            values = [judge(t.as_py(), limits, packer) for t in batch.column(0)]
            columns = list(zip(*values)) or [[]] * len(fields)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1)] + [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)],
                ["row"] + [name for name, _ in fields],
            )

    schema = StructType([packed.schema["row"], *StructType.fromDDL(JUDGED).fields])
    return packed.mapInArrow(run, schema)


def keep_good(docs: DataFrame, rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns."""
    return judged(docs, rules, text).where("kept").select("row.*")
