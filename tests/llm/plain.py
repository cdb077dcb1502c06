"""Plain Python versions that the operators are held against, written for clearness, not speed."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")

#: texts every operator must take: null, empty, no word, odd white space, one word, copies, long, scripts
ODD_TEXTS = [
    None,
    "",
    " \t\r\n\x0b\x0c",
    "one",
    "one",
    "two words",
    "a b c",
    "A B C",
    "a b c\x1cd e\x85f g",
    "naïve café 日本語 😀 <b>#tag</b> $5 & 10%",
    "same line\nsame line\n\nother\n same line\nsame line",
    "a b c a b c a b c",
    "word " * 20000,
    "x" * 50000,
    "l\n" * 3000,
]


def words(text):
    return WORD.findall(text or "")


def odd_documents(spark, more=()):
    """All odd texts with a null id, repeated rows and columns named like internal ones."""
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, 0, "x") for i, t in enumerate([*ODD_TEXTS, *more])]
    rows += [rows[3], rows[3], (None, "null id here", None, None, None, None), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _id string")


def base(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = words(text)
    text = text or ""
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    covered = {j for i, x in enumerate(windows) if often[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if words(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines)) if len(lines) < 5000 else len(lines) - len(set(lines))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def fingerprint(text):
    w = words(lower(text))
    if not w:
        return 0
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(n, links):
    """Smallest index that each of ``n`` items reaches."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near_classes(prints, most=3):
    return classes(len(prints), [(i, j) for i, j in combinations(range(len(prints)), 2) if bin(prints[i] ^ prints[j]).count("1") <= most])


def targets(sizes, weights=(3, 1, 2), share=1.5, epochs=2.0):
    """Target of each source, water poured until none is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        left = total - sum(epochs * sizes[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        level = left / open_ if open_ else 0
        more = {s for s in names if s not in full and epochs * sizes[s] <= weight[s] * level}
        if not more:
            return {s: epochs * sizes[s] if s in full else weight[s] * level for s in names}
        full |= more


def key(id, seed=42):
    return hashlib.md5(f"{seed}:{'' if id is None else id}".encode()).hexdigest()[:16]


def copies(rows):
    """Copies of each row (id, source, size) that a mix takes, as (id, source, size) -> sorted list."""
    sizes = Counter()
    for _, source, size in rows:
        sizes[source] += size
    aims, out = targets(dict(sizes)), defaultdict(list)
    for source in sizes:
        whole = aims[source] // sizes[source] if sizes[source] else 0
        rest, before = aims[source] - whole * sizes[source], 0
        for row in sorted((r for r in rows if r[1] == source), key=lambda r: (key(r[0]), r[0] is None, r[0] or 0, r[2])):
            more = rest > 0 and 2 * before + row[2] <= 2 * rest
            out[row].append(int(whole + more))
            before += row[2]
    return {r: sorted(c) for r, c in out.items()}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]
