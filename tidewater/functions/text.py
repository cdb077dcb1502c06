"""Text expressions: cleaning, tokens, headings, token estimate."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_LINE_END = r"\R|[\x1C-\x1E]"

# fixed values: the characters that count as white space
_SPACE_CODES = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001,
    0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F,
    0x205F, 0x3000,
)
_SPACES = "".join(map(chr, _SPACE_CODES))


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only the space character."""
    return F.btrim(text, F.lit(_SPACES))


def clean_lines(text: Column) -> Column:
    """Join words broken by a hyphen, drop blank, digit-only and dotted-leader lines."""
    broken = F.regexp_replace(text, r"(?U)\b(\w++)-\n(\w+)", "$1$2")
    joined = F.when(text.contains("-\n"), broken).otherwise(text)
    lines = F.transform(F.split(joined, _LINE_END), strip)
    kept = F.filter(
        lines,
        lambda s: (F.length(s) > 0) & ~s.contains("....") & ~s.rlike(r"(?U)^\d+$"),
    )
    return F.array_join(kept, "\n")


def words(text: Column) -> Column:
    """Lower-cased letter and digit runs."""
    parts = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda w: F.length(w) > 0)


def heading_pattern(heading: str) -> str:
    """Case-insensitive, at a line start, any white space between the words."""
    return r"(?im)^\s*" + r"\s+".join(re.escape(w) for w in heading.split())


def token_estimate(role: Column, content: Column) -> Column:
    """Four characters per token over role and content, plus three per message."""
    chars = F.length(F.coalesce(content, F.lit(""))) + F.length(F.coalesce(role, F.lit("")))
    return (F.ceil(chars / F.lit(4)) + F.lit(3)).cast("long")


def path_segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: F.length(s) > 0)


def path_suffix_match(a: Column, b: Column) -> Column:
    """Whether the shorter path equals the trailing segments of the longer one."""
    pa, pb = path_segments(a), path_segments(b)
    n = F.least(F.size(pa), F.size(pb))
    tail = lambda p: F.slice(p, F.size(p) - n + 1, n)
    return F.when(n > 0, tail(pa) == tail(pb)).otherwise(F.lit(False))


def is_url(path: Column) -> Column:
    return path.rlike("^https?://")
