from __future__ import annotations

from collections import Counter
from itertools import combinations
from pathlib import Path

import corpus_pipeline
import pytest
import zstandard
from plain import base, copies, fingerprint, classes, odd_documents, words

import __spark_entry__ as entry
from tidewater.llm import decontam, quality
from tidewater.llm.common import hashable, row_hash

FOLDER = entry.SMALL


def passes(text, packer, rules):
    n, _, _, _, repeated = base(text)
    if n < rules.min_words or 100 * repeated > rules.max_repeat * n:
        return False
    data = text.encode()

    def fits(part):
        band = next(b for b in rules.bands if b.below is None or len(part) < b.below)
        return band.least <= len(part) / len(packer.compress(part)) <= band.most

    chunks = [data[i : i + rules.chunk_bytes] for i in range(0, len(data), rules.chunk_bytes)]
    chunks = [c for i, c in enumerate(chunks) if not i or len(c) >= rules.chunk_bytes // 4]
    return fits(data) and sum(not fits(c) for c in chunks) <= rules.bad_chunks * len(chunks)


def leaks(text, items, rule, known):
    """True if an item's template windows are in the text, slots kept or renamed in one way."""
    h, at, kind, w = decontam.windows(text, rule, known)
    if not len(h):
        return False
    have = {}
    for x, p in zip(h.tolist(), at.tolist()):
        have.setdefault(x, []).append(p)
    for item in items:
        g, ats, kinds, v = decontam.windows(item, rule, known)
        if not len(g) or sum(x in have for x in g.tolist()) < rule.coverage * len(g):
            continue
        clean = lambda x: x.strip(decontam._EDGE.encode()).lower()
        places = {
            (p, tuple((int(kinds[p + k]), clean(v[p + k]), clean(w[q + k])) for k in range(min(rule.words, len(v))) if kinds[p + k]))
            for x, p in zip(g.tolist(), ats.tolist())
            for q in have.get(x, ())
        }
        votes = {}
        for p, slots in places:
            for s, asked, used in set(slots):
                votes.setdefault((s, asked), {}).setdefault(used, set()).add(p)
        best = {k: max((len(ps), k[1] == u, u) for u, ps in us.items())[2] for k, us in votes.items()}
        good = {p for p, slots in places if all(best[s, a] == u for s, a, u in slots)}
        if len(good) >= rule.coverage * len(g):
            return True
    return False


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")
def test_run_matches_plain_version(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    ids = {r.doc_id: r.h for r in docs.select("doc_id", row_hash(docs, hashable(docs)).alias("h")).collect()}
    rows = [r for r in docs.collect()]
    packer, rules = zstandard.ZstdCompressor(level=3), quality.Rules()
    rows = [r for r in rows if passes(r.text, packer, rules)]
    assert 0 < len(rows) < docs.count()
    prints = [fingerprint(r.text) for r in rows]
    near = [(i, j) for i, j in combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= 3]
    label = classes(len(rows), near)
    keep = {min(r.doc_id for r, k in zip(rows, label) if k == c) for c in set(label)}
    assert len(keep) < len(rows)
    rows = [r for r in rows if r.doc_id in keep]
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    known, rule = decontam._Words(), decontam.Templates()
    clean = [r for r in rows if not leaks(r.text, items, rule, known)]
    assert len(clean) < len(rows)
    taken = copies([(ids[r.doc_id], r.source, len(words(r.text))) for r in clean])
    want = {r.doc_id: taken[ids[r.doc_id], r.source, len(words(r.text))][0] for r in clean}

    out = corpus_pipeline.run(spark, FOLDER).collect()
    assert Counter(r.doc_id for r in out) == Counter({k: n for k, n in want.items() if n})
    text = {r.doc_id: r.text for r in clean}
    assert all(r.text == text[r.doc_id] for r in out)
    assert len({(r.shard, r.slot) for r in out}) == len(out)
    sizes = Counter(r.shard for r in out)
    assert len(sizes) == corpus_pipeline.SHARDS and max(sizes.values()) - min(sizes.values()) <= 1
    for source, n in Counter(r.source for r in out).items():
        held = Counter(r.shard for r in out if r.source == source)
        assert all(abs(held[s] - n / corpus_pipeline.SHARDS) < 2 for s in sizes)


def test_stages_take_odd_rows_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([(1, "never there at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd_documents(spark).withColumnRenamed("_id", "_row")
    for given in (docs, docs.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, given, str(tmp_path))
            out.collect()
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
