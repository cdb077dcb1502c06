"""Embedders behind one interface: a version tag, a width and a batch function.

Model inference is plugged in by registering a batch function; the default one
is an offline hashed bag of words, enough to run and test every job.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMBED_BATCH = 32  # fixed value: inputs per model call

_WORD = re.compile(r"[^\W_]+")


@lru_cache(maxsize=200_000)
def _bucket(word: str, width: int) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:6], 16) % width


def hashed_words(texts: list[str | None], width: int) -> list[np.ndarray | None]:
    """Counts of hashed words, unit length; None for a text without words."""
    out: list[np.ndarray | None] = []
    for text in texts:
        found = [_bucket(w, width) for w in _WORD.findall((text or "").lower())]
        if not found:
            out.append(None)
            continue
        counts = np.bincount(found, minlength=width).astype(np.float64)
        out.append((counts / np.linalg.norm(counts)).astype(np.float32))
    return out


@dataclass(frozen=True)
class Embedder:
    version: str
    width: int
    embed: Callable[[list, int], list[np.ndarray | None]]


_REGISTRY: dict[str, Embedder] = {}


def register(embedder: Embedder) -> Embedder:
    _REGISTRY[embedder.version] = embedder
    return embedder


def get_embedder(version: str) -> Embedder:
    """The embedder of a version tag; an unknown tag is an error."""
    if version not in _REGISTRY:
        raise KeyError(f"unknown embedder version {version!r}, have {sorted(_REGISTRY)}")
    return _REGISTRY[version]


WORDS_64 = register(Embedder("hashed-words-64", 64, hashed_words))
WORDS_256 = register(Embedder("hashed-words-256", 256, hashed_words))


def embed_column(embedder: Embedder, value: Column) -> Column:
    """Embedding of a column; NULL where the embedder cannot read the input."""
    width, embed = embedder.width, embedder.embed

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(embed(batch.tolist(), width), index=batch.index, dtype=object)

    # not copied into filters by the optimizer, so every input is embedded once
    return run.asNondeterministic()(value)


def embed_rows(df: DataFrame, embedder: Embedder, value: str, out: str = "embedding") -> DataFrame:
    """Rows with an embedding of the right width and the version; unreadable inputs are skipped."""
    done = df.withColumn(out, embed_column(embedder, F.col(value)))
    wide = F.size(out) == embedder.width
    checked = F.when(wide, F.col(out)).otherwise(
        F.raise_error(F.lit(f"embedding width differs from {embedder.width}"))
    )
    return (
        done.where(F.col(out).isNotNull())
        .withColumn(out, checked)
        .withColumn("embedder_ver", F.lit(embedder.version))
    )
