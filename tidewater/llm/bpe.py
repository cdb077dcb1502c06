"""Token counts by byte-pair merging with a heap and a linked list.

Only counts come out: a piece of text starts as one symbol per byte, every merge takes
one away, and no identifier is ever looked up.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from unicodedata import category

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

# fixed values of the public byte-level format: its split pattern and its byte alphabet
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEWEST = 0x558  # no character below has changed its kind in years
PRINTABLE = (*range(33, 127), *range(161, 173), *range(174, 256))


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte: itself if printable, else from 256 on."""
    others = [b for b in range(256) if b not in PRINTABLE]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(others)}


def _unassigned() -> str:
    """Ranges of letters and numbers that the regex module knows and the library doesn't yet.

    Both follow Unicode, each at its own version. Only code points that the interpreter's
    older tables leave open can differ; the library's own splitter is asked about each.
    """
    out, known = [], regex.compile(r"[\p{L}\p{N}]")
    pieces = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    for c in range(NEWEST, 0x110000):
        char = chr(c)
        if category(char) == "Cn" and known.match(char):
            if len(pieces("a" + char)) == 1 or len(pieces("1" + char)) == 1:
                continue
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


class _Remembered(dict):
    """Counts of pieces seen before: at most ``most``, none longer than ``longest``."""

    def __init__(self, count, most: int, longest: int = 64):
        super().__init__()
        self.count, self.most, self.longest = count, most, longest

    def __missing__(self, piece: str) -> int:
        n = self.count(piece.encode("utf-8"))
        if len(piece) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[piece] = n
        return n


class Counter:
    """Counts the tokens of texts as a byte-level BPE tokenizer file gives them.

    Pieces seen before are answered from a table of at most ``remembered`` entries,
    which starts anew when full; it changes speed only.
    """

    def __init__(self, path: str, remembered: int = 800_000):
        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        model, before = given["model"], given["pre_tokenizer"]
        plain = (
            model["type"] == "BPE"
            and before["type"] == "ByteLevel"
            and not before["add_prefix_space"]
            and given["normalizer"] is None
            and not any(model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix"))
            and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in given["added_tokens"])
        )
        if not plain:
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        # symbols as numbers: a byte is itself, longer strings are numbered as they appear
        symbols = byte_alphabet()
        number = lambda token: symbols.setdefault(token, len(symbols))
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {number(a) << 32 | number(b): rank for rank, (a, b) in enumerate(pairs)}
        self.merged = [number(a + b) for a, b in pairs]
        special = sorted((t["content"] for t in given["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.split = regex.compile(SPLIT)
        self.rare = regex.compile(f"[{chr(NEWEST)}-\U0010ffff]")
        self.careful = None
        self.known = _Remembered(self.piece, remembered)

    def piece(self, data: bytes) -> int:
        """Symbols left when no adjacent pair of ``data`` has a rank any more."""
        n, ranks = len(data), self.ranks
        symbol = list(data)
        following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [
            (rank, i)
            for i, (a, b) in enumerate(zip(data, data[1:]))
            if (rank := ranks.get(a << 32 | b)) is not None
        ]
        heapify(heap)
        merges = 0
        while heap:
            rank, left = heappop(heap)
            right = following[left]
            if right >= n or symbol[left] < 0 or ranks.get(symbol[left] << 32 | symbol[right]) != rank:
                continue  # one of the two has been merged since
            here = symbol[left] = self.merged[rank]
            symbol[right] = -1
            after = following[left] = following[right]
            merges += 1
            if after < n:
                previous[after] = left
                if (new := ranks.get(here << 32 | symbol[after])) is not None:
                    heappush(heap, (new, left))
            ahead = previous[left]
            if ahead >= 0 and (new := ranks.get(symbol[ahead] << 32 | here)) is not None:
                heappush(heap, (new, ahead))
        return n - merges

    def _ordinary(self, text: str) -> int:
        split = self.split
        if self.rare.search(text):
            if self.careful is None:
                new, pattern = _unassigned(), SPLIT
                if new:
                    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]{new}]")
                    for kind in (r"\p{L}", r"\p{N}"):
                        pattern = pattern.replace(f" ?{kind}+", f" ?[{kind}--[{new}]]+")
                self.careful = regex.compile(pattern, regex.V1)
            split = self.careful
        return sum(map(self.known.__getitem__, split.findall(text)))

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; a special string inside it is one token; null is empty."""
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self._ordinary(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._ordinary, parts))


_COUNTERS: dict[str, Counter] = {}


def counted(rows: DataFrame, path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """``rows`` without ``text``, with ``n_bytes``, ``n_tokens`` and ``over_limit``.

    One narrow pass. ``path`` is the tokenizer file, found under it on every worker,
    which reads it once. Null and empty texts have 0 bytes and 0 tokens.
    """
    rest = [c for c in rows.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(path)
        counter = _COUNTERS[path]
        for batch in batches:
            texts = [t.as_py() for t in batch.column(0)]
            size = pa.array([len((t or "").encode("utf-8")) for t in texts], pa.int64())
            tokens = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], size, pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                [*rest, "n_bytes", "n_tokens", "over_limit"],
            )

    schema = rows.select(*rest).schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")
    return rows.select(F.col(text).cast("string"), *rest).mapInArrow(run, schema)
