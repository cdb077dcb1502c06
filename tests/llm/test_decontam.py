from __future__ import annotations

import random

import numpy as np
from plain import odd_documents

from tidewater.llm import decontam

QUESTION = "A farmer near Paris sold 12 crates of ripe apples for 30 dollars each and then walked 5 km home; how many dollars did Thomas bring back after paying 7 dollars for bread?"


def question(number, price, town, name, unit="km"):
    return QUESTION.replace("12", number).replace("30", price).replace("Paris", town).replace("Thomas", name).replace("km", unit)


def filler(n, seed):
    random.seed(seed)
    return " ".join("".join(random.choices("abcdefgh", k=4)) for _ in range(n))


def found(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs, benchmark).collect()}


def test_copies_and_new_parameters_are_caught_and_others_left(spark):
    texts = [
        f"{filler(50, 1)} {QUESTION} {filler(40, 2)}",
        f"{filler(50, 3)} {question('48', '95', 'London', 'Peter', 'miles')} {filler(9, 4)}",
        QUESTION.lower().replace("paris", "Paris").replace("thomas", "Thomas"),
        " ".join(QUESTION.split()[: len(QUESTION.split()) // 2]),
        filler(400, 5),
        "A farmer sold 12 crates. " + filler(100, 6),
    ]
    got = found(spark, texts, [QUESTION, filler(30, 7)])
    assert set(got) == {(0, 0), (1, 0), (2, 0)}
    assert got[0, 0].coverage == 1 and got[0, 0].n_changed == 0
    assert got[1, 0].n_changed == 5 and got[1, 0].coverage >= 0.8


def test_windows_with_slots_that_contradict_each_other_do_not_count(spark):
    item = " ".join(f"we take 5 {a} then leave" for a in ("red", "blue", "green", "black", "white"))
    same = item.replace("5", "9")
    numbers = iter("123456789")
    mixed = " ".join(next(numbers) if w == "5" else w for w in item.split())
    got = found(spark, [same, mixed], [item])
    assert set(got) == {(0, 0)}


def test_names_that_start_sentences_are_slots(spark):
    item = "Tom has 3 apples. Tom buys 4 more apples. How many apples does Tom have?"
    other = item.replace("Tom", "Mary").replace("3", "5").replace("4", "9")
    mixed = "Ann has 5 apples. Bob buys 9 more apples. How many apples does Carl have?"
    got = found(spark, [f"{filler(30, 1)}. {other} {filler(20, 2)}", item, mixed], [item])
    assert set(got) == {(0, 0), (1, 0)}
    assert got[0, 0].coverage == 1 and got[0, 0].n_changed == 3 and got[1, 0].n_changed == 0


def test_variants_of_one_question_in_a_document_do_not_mix(spark):
    item = " ".join(f"we take 5 {a} then 7 leave" for a in ("red", "blue", "green", "black", "white"))
    # each variant is the only one that keeps a part: no substitution of the whole document holds
    variants = [item.replace("5", str(10 + k)).replace("7", str(30 - k)) for k in range(6)]
    got = found(spark, [" ".join(filler(6, k) + " " + v for k, v in enumerate(variants))], [item])
    assert set(got) == {(0, 0)}
    assert got[0, 0].coverage == 1 and got[0, 0].n_changed == 2


def test_items_without_usable_windows_are_found(spark):
    items = ["Sort 12 45 7 88 31 9", "John Mary Peter Susan Paul Anna Tom", "capital of zanzibar", "5 km"]
    texts = [f"{filler(20, k)} {item}. {filler(20, 9)}" for k, item in enumerate(items)]
    texts += [f"{filler(20, 8)} Sort 13 46 8 89 32 10 {filler(9, 7)} capital of mali 6 km", filler(30, 6)]
    got = found(spark, texts, items)
    assert set(got) == {(k, k) for k in range(4)}
    assert all(r.coverage == 1 and r.n_changed == 0 for r in got.values())


def test_brute_force_on_random_windows(spark):
    random.seed(8)
    rule, known = decontam.Templates(), decontam._Words()
    items = [" ".join(random.choice("aa bb cc dd ee ff 1 22 Xx km".split()) for _ in range(25)) for _ in range(12)]
    texts = [items[k % 12][: random.randrange(20, 90)] + " " + items[(k * 5) % 12] + " zz" * (k % 3) for k in range(40)] + items
    got = found(spark, texts, items)
    want = set()
    for d, text in enumerate(texts):
        h, at, kind, w = decontam.windows(text, rule, known)
        for i, item in enumerate(items):
            g, ats, kinds, v = decontam.windows(item, rule, known)
            clean = lambda x: x.strip(decontam._EDGE.encode()).lower()
            pairs, places = {}, []
            for x, p in zip(g, ats):
                for q in at[h == x]:
                    slots = [((int(kinds[p + k]), clean(v[p + k])), clean(w[q + k])) for k in range(5) if kinds[p + k]]
                    places.append((p, tuple(slots)))
            for p, slots in set(places):
                for s, value in set(slots):
                    pairs.setdefault((s, value), set()).add(p)
            best = {}
            for (s, value), ps in pairs.items():
                best[s] = max(best.get(s, (-1, False, b"")), (len(ps), s[1] == value, value))
            good = {p for p, slots in places if all(best[s][2] == value for s, value in slots)}
            if len(g) and len(good) / len(g) >= rule.coverage:
                want.add((d, i))
    assert set(got) == want and len(want) > 20


def test_short_items_drop_only_whole_lines_and_sentences(spark):
    texts = ["the cat sat on the mat", "What now? The. It ends", "a line\n the \nanother", "the", "5 km is far", "How far? 5 km", "see\n5 km!\nok", "so 5 km"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "the"), (2, "5 km")], "item_id long, text string")
    kept = {r.doc_id for r in decontam.drop_contaminated(docs, benchmark).collect()}
    assert kept == {0, 4, 7}
    assert {r.doc_id for r in decontam.contaminated(docs, benchmark).collect()} == set(range(8))


def test_filter_lets_every_asked_hash_through(spark):
    rule = decontam.Templates(filter_bits=15)
    hashes = [0, -1, 5, 1 << 49, -(1 << 60)] + [random.Random(9).getrandbits(63) for _ in range(200)]
    bits = decontam._filter(spark.createDataFrame([(h,) for h in hashes], "hash long"), rule)
    prefix = np.array(hashes, np.int64).view(np.uint64) >> np.uint64(64 - 15)
    assert all(bits[p >> np.uint64(3)] >> np.uint8(p & np.uint64(7)) & 1 for p in prefix)
    assert np.unpackbits(bits).sum() == len(set(prefix.tolist()))


def test_odd_rows_tables_and_dropping(spark):
    docs = odd_documents(spark, [QUESTION, QUESTION]).withColumnRenamed("lang", "key").withColumnRenamed("n_chars", "hash")
    items = [(1, QUESTION), (2, None), (3, ""), (None, "one"), (4, QUESTION), (5, "never there")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    kept = decontam.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    rows = docs.collect()
    want = [r.doc_id for r in rows if r.text not in (QUESTION, "one")]
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, want))
    got = decontam.contaminated(docs, benchmark).collect()
    assert {(r.item_id, r["items"]) for r in got} == {(1, 2), (None, 1)}
    assert decontam.drop_contaminated(docs, benchmark.limit(0)).count() == len(rows)
    assert decontam.contaminated(docs.limit(0), benchmark).count() == 0
