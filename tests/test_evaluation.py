"""Scores and splits on hand-made rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidewater.functions.hashing import permuted
from tidewater.operators import evaluation as E
from tidewater.operators import splits as P

SPAN = "path string, symbol string, start int, end int"


@pytest.mark.parametrize(
    ("anchor", "chunk", "hit"),
    [
        (("a/b.py", "f", None, None), ("src/a/b.py", "f", 1, 9), True),
        (("a/b.py", "f", None, None), ("b.py", "g", 1, 9), False),
        (("b.py", None, 5, 8), ("x/b.py", None, 8, 12), True),
        (("b.py", None, 5, 8), ("x/b.py", None, 9, 12), False),
        (("b.py", None, 5, 8), ("x/b.py", None, None, None), False),
        (("b.py", None, None, None), ("x/b.py", "g", 1, 2), True),
        (("c.py", None, None, None), ("x/b.py", "g", 1, 2), False),
        (("/", None, None, None), ("x", None, None, None), False),
    ],
)
def test_span_rule(spark, anchor, chunk, hit):
    a = spark.createDataFrame([anchor], SPAN).alias("a")
    c = spark.createDataFrame([chunk], SPAN).alias("c")
    assert a.join(c, E.span_hit("a", "c")).count() == int(hit)


def test_ranking_rules(spark):
    cases = spark.createDataFrame([("x",), ("lost",), ("bare",)], "case_id string")
    anchors = spark.createDataFrame(
        [("x", 0, True, "a.py", None, None, None), ("x", 1, False, "b.py", None, None, None),
         ("lost", 0, True, "a.py", None, None, None)],
        "case_id string, anchor_no int, must boolean, " + SPAN,
    )
    samples = spark.createDataFrame([("x", 0), ("bare", 0)], "case_id string, sample_no int")
    returned = spark.createDataFrame(
        [("x", 0, 1, "z.py", None, None, None), ("x", 0, 2, "b.py", None, None, None),
         ("x", 0, 3, "a.py", None, None, None), ("x", 0, 4, "a.py", None, None, None)],
        "case_id string, sample_no int, rank int, " + SPAN,
    )
    out = {(r.case_id, r.metric): (r.value, r.passed)
           for r in E.retrieval_ranking(cases, anchors, samples, returned, "r", k=2).collect()}
    assert out == {
        ("x", "r"): (0.0, False),  # the must anchor fell out of the top two
        ("x", "r_precision@2"): (0.5, None),
        ("x", "r_mrr"): (0.5, None),
        ("lost", "r"): (0.0, False),  # no output: recall only; a case without anchors has nothing
    }
    wide = {r.metric: r.value for r in E.retrieval_ranking(cases, anchors, samples, returned, "r", k=5).collect()
            if r.case_id == "x"}
    assert wide["r"] == 1.0 and wide["r_precision@5"] == 0.75


def test_votes(spark):
    cases = spark.createDataFrame(
        [(1, True), (2, True), (3, False), (4, None), (5, None)], "case_id long, expected boolean"
    )
    samples = spark.createDataFrame(
        [(1, True), (1, True), (1, False), (2, True), (2, False), (3, True), (3, False), (4, True)],
        "case_id long, flag boolean",
    )
    out = {r.case_id: r.passed for r in E.boolean_vote(cases, samples, "v").collect()}
    assert out == {1: True, 2: False, 3: True, 5: False}  # a tie is false, no expectation no score


def test_tolerance_and_keywords(spark):
    cases = spark.createDataFrame([(1, 10.0), (2, 10.0), (3, 1.0)], "case_id long, expected double")
    samples = spark.createDataFrame([(1, 9.0), (1, 12.0), (2, 20.0)], "case_id long, number double")
    out = {(r.case_id, r.metric): (r.value, r.passed)
           for r in E.numeric_tolerance(cases, samples, "n", 0.5).collect()}
    assert out == {(1, "n"): (1.0, True), (1, "n_mae"): (0.5, None), (2, "n"): (0.0, False),
                   (2, "n_mae"): (10.0, None), (3, "n"): (0.0, False)}
    cases = spark.createDataFrame([(1, ["Wind", "rain"]), (2, []), (3, ["x"])],
                                  "case_id long, required array<string>")
    texts = spark.createDataFrame([(1, 0, "the WIND blows"), (2, 0, "x")],
                                  "case_id long, sample_no int, text string")
    out = {r.case_id: (r.value, r.passed) for r in E.keyword_presence(cases, texts, "k").collect()}
    assert out == {1: (0.5, False), 2: (0.0, None), 3: (0.0, None)}


def test_keywords_equal_a_search_in_the_joined_texts(spark):
    rng = random.Random(6)
    words = ["a", "b a", "ab", "A  B", " ", "", "ba b", "a b a b", None, "zz", "b "]
    cases = [(i, rng.choices(words, k=rng.randrange(0, 9)) + (["x"] * 70 if i == 7 else [])) for i in range(60)]
    texts = [(i, n, rng.choice([None, "", "a", "b", "A", "ab a", "ba ba", "b  a", "x y"])) for i, _ in cases for n in range(rng.randrange(0, 7))]
    got = E.keyword_presence(
        spark.createDataFrame(cases, "case_id long, required array<string>"),
        spark.createDataFrame(texts, "case_id long, sample_no int, text string").repartition(5),
        "k",
    ).collect()
    assert len(got) == len(cases)
    for r in got:
        required = dict(cases)[r.case_id]
        sampled = [x for x in texts if x[0] == r.case_id]
        joined = " ".join(t.lower() for _, _, t in sampled if t is not None)
        hits = sum(w is not None and w.lower() in joined for w in required)
        if required and sampled:
            assert (r.value, r.passed) == (hits / len(required), hits == len(required)), (required, sampled)
        else:
            assert (r.value, r.passed) == (0.0, None)


def test_a_word_with_too_many_spaces_is_an_error(spark):
    cases = spark.createDataFrame([(1, ["a" + " a" * 65])], "case_id long, required array<string>")
    texts = spark.createDataFrame([(1, 0, "a")], "case_id long, sample_no int, text string")
    with pytest.raises(Exception, match="too many spaces"):
        E.keyword_presence(cases, texts, "k").collect()


def test_judge(spark):
    cases = spark.createDataFrame([(1, "r"), (2, ""), (3, "r")], "case_id long, reference string")
    graded = spark.createDataFrame(
        [(1, 0, 1.5, "good"), (1, 1, 0.5, ""), (2, 0, 1.0, "x")],
        "case_id long, sample_no int, score double, reason string",
    )
    out = {r.case_id: (r.value, r.passed, r.detail) for r in E.judge_rollup(cases, graded, "j").collect()}
    assert out == {1: (0.75, True, "good"), 3: (0.0, False, "all samples parse-failed")}


def scores(spark, genuine, impostor):
    rows = [("genuine", float(s)) for s in genuine] + [("impostor", float(s)) for s in impostor]
    return spark.createDataFrame(rows, "population string, score double")


def test_youden_takes_the_first_best(spark):
    df = scores(spark, [0.9, 0.8, 0.6, 0.4], [0.7, 0.5, 0.3, 0.2])
    sweep = {round(r.tau, 3): r for r in E.roc_sweep(df, step=0.25).collect()}
    assert (sweep[0.6].tpr, sweep[0.6].fpr, sweep[0.6].accuracy) == (0.75, 0.25, 0.75)
    best = E.youden_threshold(E.roc_sweep(df)).first()
    # 0.4, 0.6 and 0.8 all reach 0.5: the lowest wins
    assert (best.tau, best.youden_j) == (0.4, 0.5)
    grid = {r.tau: (r.tpr, r.fpr) for r in E.grid_sweep(df, [0.3, 0.6]).collect()}
    assert grid == {0.3: (1.0, 0.75), 0.6: (0.75, 0.25)}


def test_distribution_uses_half_even_ranks(spark):
    out = E.score_distribution(scores(spark, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6], [])).first()
    # positions 0.5 and 4.5 round to 0 and 4
    assert (out.p10, out.p90, out.median) == (0.1, 0.5, pytest.approx(0.35))


def test_metric_counts_differ_when_outputs_are_missing(spark):
    rows = spark.createDataFrame(
        [("a", "reid@5", 1.0, True), ("a", "reid@5_mrr", 1.0, None), ("b", "reid@5", 0.0, False)],
        "case_id string, metric string, value double, passed boolean",
    )
    out = {r.metric: (r["mean"], r.n_cases) for r in E.metric_means(rows).collect()}
    assert out == {"reid@5": (0.5, 2), "reid@5_mrr": (1.0, 1)}


@pytest.fixture(scope="module")
def sightings(spark):
    rows = [(who, who * 1000 + i) for who in range(60) for i in range(1 + who % 13)]
    rows += [(99, 990_000 + i) for i in range(2000)]  # one individual holds most rows
    return spark.createDataFrame(rows, "individual_id long, sighting_id long")


def test_split_is_disjoint_and_repeats(sightings):
    split = P.reid_split(sightings)
    assert tuple(P.split_leakage(split).first()) == (0, 0, 0)
    again = P.reid_split(sightings.repartition(7))
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, again.collect()))
    assert split.where("n_photos < 4 and split <> 'train'").count() == 0
    assert split.where("n_photos < 2").count() == 0


def test_test_split_is_sealed(sightings):
    split = P.reid_split(sightings)
    people = split.select("individual_id", F.lit("n").alias("name"))
    with pytest.raises(PermissionError):
        P.eval_cases(split, people, "test")
    assert P.eval_cases(split, people, "test", allow_test=True).count() == split.where("split = 'test'").count()


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 99, 101, 1000])
def test_keyed_permutations_meet_every_place_once(spark, n):
    rows = spark.range(n).select("id", *[permuted(F.col("id"), F.lit(n), seed, F.lit("k")).alias(f"p{seed}") for seed in (1, 2)]).collect()
    for name in ("p1", "p2"):
        assert sorted(r[name] for r in rows) == list(range(n))
    if n > 50:
        assert sum(r.p1 == r.p2 for r in rows) < 10 and sum(r.p1 == r.id for r in rows) < 10
        assert abs(sum(r.p1 * r.id for r in rows) / sum(r.id**2 for r in rows) - 0.75) < 0.1  # no order is left


def test_no_places_no_permutation(spark):
    assert spark.range(1).select(permuted(F.lit(0), F.lit(0).cast("long"), 1).alias("p")).first().p is None


def test_pk_batches(sightings):
    pool = sightings.join(P.eligible(sightings, 2).select("individual_id"), "individual_id")
    rows = P.pk_batches(pool, 20, 6, 4, seed=3).collect()
    assert len(rows) == 20 * 6 * 4
    sizes = {r.individual_id: r.n for r in pool.groupBy("individual_id").agg(F.count("*").alias("n")).collect()}
    batches: dict[int, dict[int, list[int]]] = {}
    for r in rows:
        batches.setdefault(r.batch, {}).setdefault(r.individual_id, []).append(r.sighting_id)
    for batch in batches.values():
        assert len(batch) == 6
        for who, picked in batch.items():
            assert len(picked) == 4
            assert len(set(picked)) == 4 if sizes[who] >= 4 else len(set(picked)) <= sizes[who]
    assert sorted(map(tuple, rows)) == sorted(map(tuple, P.pk_batches(pool, 20, 6, 4, seed=3).collect()))


def test_probe_and_label_index(sightings):
    pairs = P.probe_pairs(sightings, 10, seed=1).collect()
    assert len(pairs) == 10 and all(r.query_sighting_id != r.gallery_sighting_id for r in pairs)
    pool = sightings.withColumn("asset_ref", F.col("sighting_id").cast("string"))
    index = {r.individual_id: r.class_index for r in P.label_index(pool).collect()}
    assert [index[k] for k in sorted(index)] == list(range(len(index)))


def test_trajectory(spark):
    specs = spark.createDataFrame(
        [("c", ["a", "b"], ["z"], 3, [("a", "b")], False), ("n", ["a"], [], None, [], True)],
        "case_id string, required array<string>, forbidden array<string>, max_hops int, "
        "dependency array<struct<earlier:string,later:string>>, expect_abstain boolean",
    )
    steps = spark.createDataFrame(
        [("c", 0, 1, "a", False), ("c", 0, 2, "b", False), ("c", 1, 1, "b", False), ("c", 1, 2, "a", False),
         ("c", 1, 3, "z", False), ("n", 0, 1, "a", True), ("n", 1, 1, "a", False)],
        "case_id string, trace_no int, step_no int, tool string, abstain boolean",
    )
    traces = spark.createDataFrame(
        [("c", 0, "7"), ("c", 1, "7"), ("n", 0, "NOVEL"), ("n", 1, "7")],
        "case_id string, trace_no int, resolved string",
    )
    scored = E.trajectory_score(specs, steps, traces)
    out = {(r.case_id, r.trace_no): r for r in scored.collect()}
    assert out["c", 0].gate and not out["c", 1].dependency_ok and out["c", 1].tool_precision < 1
    assert out["n", 0].gate and not out["n", 1].recovery_ok
    rates = {r.case_id: (r.repeats, r.gate_rate) for r in E.trajectory_rates(scored).collect()}
    assert rates == {"c": (2, 0.5), "n": (2, 0.5)}
