from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from plain import copies, key, odd_documents, targets, words
from pyspark.sql import functions as F

from tidewater.llm import mixing, sharding


@pytest.fixture(scope="module")
def rows():
    out = [(i, f"s{i % 7}" if i % 11 else None, (i * 37) % 90 if i % 5 else 0) for i in range(500)]
    out += [(1000 + i, "s0", 50) for i in range(400)]  # a source with half of all rows
    return out + [(3, "s3", 21)] * 4 + [(None, "s1", 7), (None, None, 7), (2000, "empty", 0)]


def test_mix_matches_plain_version(spark, rows):
    out = mixing.mixed(spark.createDataFrame(rows, "id long, source string, size long").repartition(6)).collect()
    got = defaultdict(list)
    for r in out:
        got[r.id, r.source, r.size].append(r.copies)
        assert r.taken == r.copies * r.size <= 2 * r.size
    assert {k: sorted(v) for k, v in got.items()} == copies(rows)
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in out:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    aims = targets(dict(sizes))
    assert abs(sum(aims.values()) - 1.5 * sum(sizes.values())) < 1e-6
    for r in out:
        assert abs(r.target - aims[r.source]) < 1e-6
    assert all(abs(taken[s] - aims[s]) <= largest[s] / 2 + 1e-6 for s in sizes)


def test_mix_documents_repeats_rows_and_keeps_columns(spark):
    more = [f"word{i} " * (i + 1) for i in range(40)]
    docs = odd_documents(spark, more).withColumnRenamed("lang", "copies")
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    given = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    sizes = Counter()
    for _, text, source in given:
        sizes[source] += len(words(text))
    got = [(r.doc_id, r.text, r.source) for r in out.collect()]
    assert all(n <= 2 * given.count(k) for k, n in Counter(got).items())
    taken = Counter()
    for _, text, source in got:
        taken[source] += len(words(text))
    aims = targets(dict(sizes))
    largest = {s: max(len(words(t)) for _, t, x in given if x == s) for s in sizes}
    assert all(abs(taken[s] - aims[s]) <= largest[s] / 2 for s in sizes)
    assert mixing.mix_documents(docs.limit(0)).count() == 0


def test_shards_match_plain_version(spark, rows):
    slim = spark.createDataFrame([r[:2] for r in rows], "id long, source string")
    out = sharding.interleaved(slim.repartition(5), shards=16).collect()
    counts = Counter(r[1] for r in rows)
    order = []
    for source, n in counts.items():
        inside = sorted((r[0] for r in rows if r[1] == source), key=lambda i: (key(i), i is None, i or 0))
        order += [((2 * k + 1) / (2 * n), source is None, source or "", key(i), i is None, i or 0, i, source) for k, i in enumerate(inside)]
    order.sort(key=lambda x: x[:6])
    total = len(order)
    want = [(x[6], x[7], p * 16 // total) for p, x in enumerate(order)]
    assert Counter((r.id, r.source, r.shard) for r in out) == Counter(want)
    by_shard = defaultdict(list)
    for r in out:
        by_shard[r.shard].append(r)
    for found in by_shard.values():
        assert sorted(r.slot for r in found) == list(range(len(found)))
        for source, n in Counter(r.source for r in found).items():
            assert abs(n - counts[source] / 16) < 2
    assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1


def test_shard_documents_with_copies_and_clashes(spark):
    docs = odd_documents(spark).withColumnRenamed("lang", "shard").withColumnRenamed("n_chars", "_place")
    out = sharding.shard_documents(docs, shards=4)
    assert out.columns == ["doc_id", "text", "source", "_place", "_id", "shard", "slot"]
    rows = out.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in docs.collect())
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)
    sizes = Counter(r.shard for r in rows).values()
    assert max(sizes) - min(sizes) <= 1
    assert sharding.shard_documents(docs.limit(0)).count() == 0
    few = sharding.interleaved(spark.createDataFrame([(1, "a"), (2, "a")], "id long, source string"), shards=16)
    assert {r.slot for r in few.collect()} == {0}


def test_main_path_of_shards_has_no_python(spark):
    out = sharding.interleaved(spark.range(50).select("id", F.lit("s").alias("source")))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
