"""Slices, briefs and views; one token is one character, as in the published cases."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import conversation as V
from tidewater.sources.schemas import MESSAGES


def chars(role, content):
    return F.length(content).cast("long")


def human(i, size):
    return (f"h{i}", "human", "x" * size, None, None)


def ai(i, size):
    return (f"a{i}", "ai", "y" * size, None, None)


def call(i, call_id, size=10):
    return (f"c{i}", "ai", "c" * size, [(call_id, "lookup", '{"q":1}')], None)


def result(i, call_id, size):
    return (f"t{i}", "tool", "r" * size, None, call_id)


@pytest.fixture(scope="module")
def make(spark):
    def build(*messages, conv=1):
        rows = [(conv, turn, *m) for turn, m in enumerate(messages)]
        return V.with_tokens(spark.createDataFrame(rows, MESSAGES), chars)

    return build


def one(df):
    rows = df.collect()
    assert len(rows) <= 1
    return rows[0] if rows else None


def test_prose_flag(make):
    rows = make(human(1, 5), ai(1, 5), call(1, "x"), result(1, "x", 5)).orderBy("turn").collect()
    assert [r.is_prose for r in rows] == [True, True, False, False]


def ids(make_df, segments):
    rows = V.sliced(make_df, segments).orderBy("segment", "turn").collect()
    out = {}
    for r in rows:
        out.setdefault(r.segment, []).append(r.msg_id)
    return list(out.values())


def test_slice_closes_at_budget(make):
    df = make(human(1, 10), ai(1, 10), human(2, 10), ai(2, 10), human(9, 10))
    assert ids(df, V.segment_numbers(df, 15, 1)) == [["h1", "a1"], ["h2", "a2"]]


def test_under_budget_and_inside_tail_give_nothing(make):
    df = make(human(1, 10), human(9, 10))
    assert V.prose_segments(df, 50, 1).count() == 0
    df = make(human(1, 100))
    assert V.prose_segments(df, 50, 1).count() == 0


def test_tool_rows_do_not_count(make):
    df = make(human(1, 10), call(1, "x"), result(1, "x", 100), ai(2, 10), human(9, 10))
    assert ids(df, V.segment_numbers(df, 15, 1)) == [["h1", "c1", "t1", "a2"]]


def test_big_message_closes_alone(make):
    df = make(human(1, 100), ai(1, 10), human(9, 10))
    assert ids(df, V.segment_numbers(df, 50, 1)) == [["h1"]]


def test_bookmark(make, spark):
    df = make(human(1, 10), ai(1, 10), human(2, 10), ai(2, 10), human(9, 10))
    mark = spark.createDataFrame([(1, "a1")], "conv_id long, bookmark_id string")
    assert ids(df, V.segment_numbers(df, 15, 1, mark)) == [["h2", "a2"]]
    assert V.after_bookmark(df, mark).count() == 3
    none = spark.createDataFrame([(1, None)], "conv_id long, bookmark_id string")
    assert V.after_bookmark(df, none).count() == 5
    lost = spark.createDataFrame([(1, "zz")], "conv_id long, bookmark_id string")
    with pytest.raises(Exception, match="bookmark not found"):
        V.after_bookmark(df, lost).collect()


@pytest.mark.parametrize("block", [3, 16, 50, 10_000])
def test_blocks_do_not_change_the_cuts(spark, block):
    rng = random.Random(block)
    rows, want = [], []
    for conv in range(4):
        sizes = [rng.choice([0, 0, 3, 7, 20, 90]) for _ in range(rng.choice([5, 40, 211]))]
        rows += [(conv, t, f"{conv}-{t}", "human", "x" * s, None, None) for t, s in enumerate(sizes)]
        held, start, number = 0, 0, 0
        for t, s in enumerate(sizes[:-2]):
            held += s
            if held >= 60:
                want.append((conv, number, start, t, held))
                held, start, number = 0, t + 1, number + 1
    df = V.with_tokens(spark.createDataFrame(rows, MESSAGES), chars)
    got = V.prose_segments(df, 60, 2, block=block).collect()
    assert sorted(
        (r.conv_id, r.segment, r.start_turn, r.end_turn, r.prose_tokens) for r in got
    ) == sorted(want)


def test_summaries_see_prose_only(make):
    df = make(human(1, 10), call(1, "x"), result(1, "x", 5), ai(2, 10), human(9, 10))
    rows = V.sliced(df, V.segment_numbers(df, 15, 1))
    out = one(V.summary_rows(rows, counter=chars))
    assert out.content == V.SUMMARY_FRAME + "x" * 10 + "\n" + "y" * 10
    assert out.tokens == 21 and out.role == "human"
    transcript = json.loads(one(V.transcript_json(rows)).transcript)
    assert [m["message_id"] for m in transcript] == ["h1", "a2"]
    assert transcript[0] == {"message_id": "h1", "type": "human", "content": "x" * 10}


def test_prepare_delta(make):
    df = make(human(1, 10), human(9, 10))
    assert [part.count() for part in V.prepare_delta(df, 50, 1, 10)] == [0, 0, 0]
    df = make(human(1, 10), ai(1, 10), human(9, 10))
    summaries, briefs, marks = V.prepare_delta(df, 15, 1, 10)
    assert (summaries.count(), briefs.count(), one(marks).bookmark_id) == (1, 0, "a1")


def briefed(df, max_chars, base=None):
    rows = df.withColumn("segment", F.lit(0).cast("long"))
    return {r.id: r for r in V.tool_briefs(rows, max_chars, base).collect()}


def test_briefs_merge_both_halves(make):
    out = briefed(make(call(1, "x"), result(1, "x", 5)), 100)
    assert len(out) == 1
    assert (out["x"].ordinal, out["x"].name, out["x"].summary) == (0, "lookup", "rrrrr")


def test_result_alone_is_cut_and_nameless(make):
    out = briefed(make(result(1, "x", 100)), 10)
    assert (len(out["x"].summary), out["x"].name) == (10, None)


def test_ordinals_go_on_from_the_base(make, spark):
    base = spark.createDataFrame([(1, 5)], "conv_id long, n long")
    out = briefed(make(call(1, "x"), result(1, "x", 5), call(2, "y"), result(2, "y", 5)), 10, base)
    assert {k: v.ordinal for k, v in out.items()} == {"x": 5, "y": 6}


def test_a_later_half_uses_no_ordinal_of_its_own(make):
    df = make(call(1, "x"), human(1, 9), result(1, "x", 5), call(2, "y"))
    rows = df.withColumn("segment", F.when(F.col("turn") < 2, 0).otherwise(1).cast("long"))
    briefs = V.tool_briefs(rows, 10)
    got = {(r.segment, r.id): r.ordinal for r in briefs.collect()}
    assert got == {(0, "x"): 0, (1, "x"): 1, (1, "y"): 2}
    state = {r.id: r for r in V.merge_briefs(briefs).collect()}
    assert state["x"].name is None and state["x"].summary == "rrrrr"  # the incoming brief wins


def budget(spark, n):
    return spark.createDataFrame([(1, n)], "conv_id long, budget long")


def kept(df):
    return [r.msg_id for r in df.where("kept").orderBy("turn").collect()]


def test_fit_tail(make, spark):
    df = make(human(1, 10), ai(1, 10), human(9, 10))
    out = V.fit_tail(df, budget(spark, 25))
    assert kept(out) == ["a1", "h9"]
    left = V.left_over(budget(spark, 25), out.where("kept").withColumn("size", F.col("tokens")))
    assert one(left).budget == 5


def test_fit_tail_overflow_and_orphan(make, spark):
    out = V.fit_tail(make(human(1, 10), human(9, 100)), budget(spark, 50))
    assert all(r.overflow for r in out.collect())
    df = make(call(1, "x"), result(1, "x", 5), human(9, 10))
    assert kept(V.fit_tail(df, budget(spark, 16))) == ["h9"]


def test_without_a_human_turn_all_is_mandatory(make, spark):
    assert kept(V.fit_tail(make(ai(1, 10), ai(2, 10)), budget(spark, 20))) == ["a1", "a2"]


def items(spark, *sizes):
    return spark.createDataFrame([(1, i, s) for i, s in enumerate(sizes)], "conv_id long, ord long, size long")


def test_budget_fit(spark):
    rows = V.budget_fit(items(spark, 10, 10, 10), budget(spark, 25))
    assert sorted(r.ord for r in rows.collect()) == [1, 2]
    assert one(V.left_over(budget(spark, 25), rows)).budget == 5
    # the run ends at the first item that does not fit, also if an older one would
    rows = V.budget_fit(items(spark, 1, 50, 10), budget(spark, 25))
    assert [r.ord for r in rows.collect()] == [2]


def test_ceiling_drops_briefs_first(make, spark):
    tail = make(human(9, 10))
    summaries = spark.createDataFrame([(1, 0, 10)], "conv_id long, segment long, tokens long")
    briefs = spark.createDataFrame([(1, 0, 5)], "conv_id long, ordinal long, size long")
    rows, texts, lines, lost = V.fit_to_ceiling(tail, summaries, briefs, budget(spark, 20))
    assert (rows.count(), texts.count(), lines.count(), lost.count()) == (1, 1, 0, 0)


def test_a_current_turn_over_the_ceiling_is_marked_or_refused(make, spark):
    tail = make(human(1, 10), human(9, 100))
    summaries = spark.createDataFrame([], "conv_id long, segment long, role string, content string, tokens long")
    briefs = spark.createDataFrame(
        [], "conv_id long, id string, ordinal long, name string, query string, summary string"
    )
    view = V.build_view(tail, summaries, briefs, budget(spark, 50), counter=chars).collect()
    assert [(r.conv_id, r.layer, r.role) for r in view] == [(1, -1, "overflow")]
    sized = briefs.withColumn("size", F.lit(1))
    rows = V.fit_to_ceiling(tail, summaries, sized, budget(spark, 50), refuse=True)[0]
    with pytest.raises(Exception, match="over the budget in conversation 1"):
        rows.collect()


def test_build_view_order(make, spark):
    df = make(human(1, 10), ai(1, 10), human(2, 10), ai(2, 10))
    summaries = spark.createDataFrame(
        [(1, 0, "human", "s1", 2)], "conv_id long, segment long, role string, content string, tokens long"
    )
    briefs = spark.createDataFrame(
        [(1, "b", 1, "n", "{}", "s"), (1, "a", 0, "n", "{}", "s")],
        "conv_id long, id string, ordinal long, name string, query string, summary string",
    )
    tail = df.where("turn >= 2")
    view = V.build_view(tail, summaries, briefs, counter=chars).orderBy("layer", "pos").collect()
    assert [r.layer for r in view] == [0, 1, 2, 2]
    first, second = view[0].content.removeprefix(V.MANIFEST_FRAME).split("\n")
    assert (json.loads(first)["id"], json.loads(second)["id"]) == ("a", "b")
    bare = V.build_view(tail, summaries, briefs.where("ordinal > 9"), counter=chars).collect()
    assert sorted(r.layer for r in bare) == [1, 2, 2]


def test_map_merge(spark):
    df = spark.sql("select map('a', 1, 'b', 0) as old, map('b', 2) as new")
    out = df.select(V.map_merge(F.col("old"), F.col("new")).alias("m"), "old").first()
    assert out.m == {"a": 1, "b": 2} and out.old == {"a": 1, "b": 0}


def test_orphans(make):
    out = V.orphan_tool_calls(make(call(1, "x"), result(1, "x", 5), call(2, "y"), result(3, "z", 5)))
    assert {(r.id, r.has_call, r.has_result) for r in out.collect()} == {("y", True, False), ("z", False, True)}


def test_retention(make, spark):
    rows = make(call(1, "x"), result(1, "x", 50), result(2, "y", 50), result(3, "z", 50))
    names = F.when(F.col("msg_id") == "t1", "big").when(F.col("msg_id") == "t2", "gone").otherwise("plain")
    policies = spark.createDataFrame(
        [("big", "external"), ("gone", "ephemeral")], "tool_name string, policy string"
    )
    out, payloads = V.retention_apply(rows.withColumn("tool_name", names), policies, 4)
    by_id = {r.msg_id: r for r in out.collect()}
    assert by_id["t1"].content == f"rrrr [{by_id['t1'].ref}]"
    assert "not retained" in by_id["t2"].content
    assert by_id["t3"].content == "r" * 50 and by_id["c1"].content == "c" * 10
    assert one(payloads).payload == "r" * 50
