from __future__ import annotations

import random
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
from plain import odd_documents, words

from tidewater.llm import audit


def failures(docs):
    """The filters that each row fails, by their definition."""
    ids = defaultdict(list)
    for r in docs:
        if r["doc_id"] is not None:
            ids[r["text"] or ""].append(r["doc_id"])
    out = []
    for r in docs:
        text = r["text"] or ""
        w = words(text)
        fails = "A" * (len(w) < 100) + "B" * (100 * len(set(w)) < 80 * len(w))
        fails += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text)) + "D" * any(c in "#$%&*|" for c in text)
        fails += "E" * (r["doc_id"] is not None and min(ids[text]) < r["doc_id"])
        out.append(fails)
    return out


def plain(docs, labels):
    """All orders applied one after the other, document by document."""
    good = {r["doc_id"] for r in labels if r["quality"] == 1} - {None}
    toxic = {r["doc_id"] for r in labels if r["toxic"] == 1} - {None}
    parts = defaultdict(list)
    for r, fails in zip(docs, failures(docs)):
        parts[r["lang"] or ""].append((r["doc_id"], fails))
    out = {}
    for part, rows in parts.items():
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                removed = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[f] += len(removed)
                out[part, order, step] = [
                    len(left), len(removed), sum(f in x[1] for x in rows) - len(removed), sum(x[1] == f for x in rows),
                    sum(x[0] in good for x in removed), sum(x[0] in toxic for x in removed),
                ]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(total[order[step - 1]])
    return out


def as_dict(out):
    return {
        (r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley]
        for r in out.collect()
    }


def test_odd_documents_match_plain_version(spark):
    rng = random.Random(12)
    more = ["", "Some text", "Some text"] + [
        " ".join(rng.choice(["a", "B", "c#", "dd", "EE", "f"]) + str(rng.randrange(99)) for _ in range(rng.choice([5, 99, 100, 101, 150]))) for _ in range(30)
    ]
    docs = odd_documents(spark, more + more[10:20])
    labels = spark.createDataFrame(
        [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 60, 2)] + [(4, 1, 1), (4, 0, None), (None, 1, 1)],
        "doc_id long, quality int, toxic int",
    )
    got = as_dict(audit.audited(audit.mask_cells(docs.withColumnRenamed("_id", "h1"), labels)))
    want = plain([r.asDict() for r in docs.collect()], [r.asDict() for r in labels.collect()])
    assert got == want


def test_empty_tables(spark):
    docs, labels = odd_documents(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audited(audit.mask_cells(docs.limit(0), labels)).count() == 0
    assert {r.part for r in audit.audited(audit.mask_cells(docs, labels)).select("part").distinct().collect()} == {"en", ""}


def test_walk_keeps_what_fails_no_active_filter():
    rng = np.random.default_rng(5)
    for k in (1, 2, 3, 6):
        cells = rng.integers(0, 50, (1 << k, 3))
        states = audit.survivors(cells)
        for active in range(1 << k):
            assert (states[active] == cells[(np.arange(1 << k) & active) == 0].sum(axis=0)).all()


def test_capitals_and_words_at_their_limits(spark):
    texts = ["A" * 1 + "b" * 9, "A" * 11 + "b" * 89, " ".join(f"w{i}" for i in range(99)), " ".join(f"w{i}" for i in range(100)),
             " ".join(f"w{i % 80}" for i in range(100)), " ".join(f"w{i % 79}" for i in range(100))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    masks = [r[0] for r in docs.orderBy("doc_id").select(audit.own_failures(docs["text"])).collect()]
    assert masks == [1, 5, 1, 0, 0, 2]
