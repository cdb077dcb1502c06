from __future__ import annotations

import random

import numpy as np
from plain import ODD_TEXTS, classes, fingerprint, near_classes, odd_documents

from tidewater.llm import components, simhash


def test_fingerprint_matches_plain_version():
    random.seed(1)
    texts = ODD_TEXTS[:12] + [" ".join(random.choice("aBcDé") * random.randrange(1, 4) for _ in range(random.randrange(40))) for _ in range(200)]
    assert [simhash.fingerprint(t) for t in texts] == [fingerprint(t) for t in texts]


def flipped(value, bits):
    for b in random.sample(range(64), bits):
        value ^= 1 << b
    return value


def test_links_connect_what_chains_of_three_bits_connect(spark):
    random.seed(2)
    prints = [0, (1 << 64) - 1]
    for _ in range(60):
        base = random.getrandbits(64)
        prints += [base, *[flipped(base, random.randrange(1, 8)) for _ in range(6)]]
    chain = random.getrandbits(64)
    for _ in range(30):
        chain = flipped(chain, 3)
        prints.append(chain)
    prints = sorted(set(prints))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = spark.createDataFrame([(signed(p),) for p in prints], "fingerprint long")
    for pairwise in (1024, 3):  # also by flips
        links = [(r.a, r.b) for r in simhash.fingerprint_links(rows, 3, pairwise).collect()]
        at = {signed(p): i for i, p in enumerate(prints)}
        got = classes(len(prints), [(at[a], at[b]) for a, b in links])
        assert got == near_classes(prints)


def test_a_list_by_flips_equals_all_pairs():
    random.seed(5)
    positions = (0, 2, 3, 6, 7)
    base = random.getrandbits(64)
    members = np.array(sorted({base ^ sum(random.getrandbits(1) << (8 * p + b) for p in (1, 4, 5) for b in range(8) if random.random() < 0.3) for _ in range(200)}), np.uint64)
    one = simhash.list_links(members, positions, 3, 10_000)
    two = simhash.list_links(members, positions, 3, 1)
    as_classes = lambda x: classes(len(members), [(i, int(np.nonzero(members == v)[0][0])) for i, v in enumerate(x)])
    assert as_classes(one) == as_classes(two) == near_classes(members.tolist())


def test_near_duplicates_on_odd_rows(spark):
    random.seed(6)
    text = " ".join(f"w{random.randrange(500)}" for _ in range(400))
    docs = odd_documents(spark, [text, text + " end", text.replace("w1 ", "q "), text]).repartition(5)
    rows = docs.collect()
    got = {}
    for r in simhash.near_duplicates(docs).collect():
        got.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    label = near_classes([fingerprint(r.text) for r in rows])
    for i, r in enumerate(rows):
        ids = [x.doc_id for x, k in zip(rows, label) if k == label[i] and x.doc_id is not None]
        assert (f"{fingerprint(r.text):016x}", min(ids, default=None)) in got[r.doc_id]
    assert simhash.near_duplicates(docs).count() == len(rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    want = sorted(str(min((x.doc_id is None, x.doc_id) for x, k in zip(rows, label) if k == c)[1]) for c in set(label))
    assert sorted(str(r.doc_id) for r in kept.collect()) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def test_components_of_stars_chains_and_cycles(spark):
    random.seed(7)
    n = 300
    links = [(0, i) for i in range(1, 80)] + [(i, i + 1) for i in range(100, 180)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    links += [(random.randrange(210, n), random.randrange(210, n)) for _ in range(60)]
    random.shuffle(links)
    df = spark.createDataFrame([*links, (None, 3), (4, None)], "a long, b long")
    want = classes(n, links)
    got = {r.node: r.label for r in components.components(df).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {i: want[i] for i in linked}
    assert components.components(df.limit(0)).count() == 0
