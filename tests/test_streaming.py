"""Streaming jobs: several batches, replays, restarts."""

from __future__ import annotations

import json
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewater.operators.embedders import WORDS_64, WORDS_256
from tidewater.streaming import jobs


def chars(role, content):
    return F.length(content).cast("long")


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


LOG = "conv_id long, turn long, role string, content string, ts timestamp"
START = datetime(2024, 1, 1)


def turns(*numbers, conv=1, role="human", size=10):
    """Messages a minute apart."""
    return [(conv, t, role, "x" * size, START + timedelta(minutes=t)) for t in numbers]


def sliced(spark, source, out, *batches, tail=0, **given):
    """The slices after each batch was read by a query of its own."""
    for rows in batches:
        put(spark, source, rows, LOG)
        log = jobs.read_stream(spark, str(source))
        jobs.run_to_end(jobs.stream_segments(log, 15, tail, chars, **given), str(out))
    rows = spark.read.parquet(str(out)).collect()
    return sorted((r.segment, r.start_turn, r.end_turn, r.n_messages, r.prose_tokens) for r in rows)


def test_segments_over_batches_and_replays(spark, tmp_path):
    source, out = tmp_path / "log", tmp_path / "out"
    assert sliced(spark, source, out, turns(0, 1, 2, 3), tail=1) == [(0, 0, 1, 2, 20)]
    assert sliced(spark, source, out, turns(0, 1, 2, 3), tail=1) == [(0, 0, 1, 2, 20)]  # the same messages again
    assert sliced(spark, source, out, turns(3, 4, 5), tail=1) == [(0, 0, 1, 2, 20), (1, 2, 3, 2, 20)]


def test_segments_wait_for_late_turns(spark, tmp_path):
    """Turns that arrive out of order give the slices of the ordered log."""
    got = sliced(spark, tmp_path / "log", tmp_path / "out", turns(2, 3), turns(0, 1), turns(1, 4), turns(5, 4))
    assert got == [(0, 0, 1, 2, 20), (1, 2, 3, 2, 20), (2, 4, 5, 2, 20)]


@pytest.mark.parametrize("missing", [{0}, {3}, {0, 1, 7, 8}])
def test_a_gap_is_real_once_later_messages_have_passed(spark, tmp_path, missing):
    numbers = [t for t in range(21) if t not in missing]
    first = sliced(spark, tmp_path / "log", tmp_path / "out", turns(*numbers[:4]), late_by="2 minutes")
    assert len(first) <= 2
    got = sliced(spark, tmp_path / "log", tmp_path / "out", turns(*numbers[4:]), turns(0, conv=2), late_by="2 minutes")
    want = [(i, a, b, 2, 20) for i, (a, b) in enumerate(zip(numbers[::2], numbers[1::2]))]
    assert got == want


def test_turns_behind_a_gap_wait_while_the_missing_one_may_come(spark, tmp_path):
    source, out = tmp_path / "log", tmp_path / "out"
    assert sliced(spark, source, out, turns(1, 2, 3)) == []
    assert sliced(spark, source, out, turns(0)) == [(0, 0, 1, 2, 20), (1, 2, 3, 2, 20)]


def test_tool_rows_do_not_fill_a_slice(spark, tmp_path):
    rows = turns(0) + turns(1, role="tool", size=99) + turns(2, size=1)
    assert sliced(spark, tmp_path / "log", tmp_path / "out", rows) == []


RUNS = "run_id string, phase string, ts timestamp, tool string"


def timed(spark, source, out, *batches, **given):
    """Elapsed times after each batch of ``run, phase, second, tool`` was read by a query of its own."""
    for rows in batches:
        put(spark, source, [(r, p, START + timedelta(seconds=s), t) for r, p, s, t in rows], RUNS)
        jobs.run_to_end(jobs.stream_tool_elapsed(jobs.read_stream(spark, str(source)), **given), str(out))
    return {r.run_id: (r.elapsed_ms, r.tool) for r in spark.read.parquet(str(out)).collect()}


def test_tool_elapsed_keeps_starts_between_batches(spark, tmp_path):
    source, out = tmp_path / "runs", tmp_path / "out"
    first = [("a", "start", 0, "t"), ("b", "end", 1, "t"), ("c", "start", 2, "u")]
    assert timed(spark, source, out, first, late_by="0 seconds") == {"b": (-1, None)}
    then = [("a", "end", 5, "t"), ("c", "end", 4, "u")]
    assert timed(spark, source, out, then, late_by="0 seconds") == {"b": (-1, None), "a": (5000, "t"), "c": (2000, "u")}


def test_an_end_may_come_before_its_start(spark, tmp_path):
    source, out = tmp_path / "runs", tmp_path / "out"
    assert timed(spark, source, out, [("a", "end", 5, "t"), ("b", "end", 6, "t")]) == {}
    assert timed(spark, source, out, [("a", "start", 1, "t")]) == {"a": (4000, "t")}
    assert timed(spark, source, out, [(None, "tick", 3600, None)]) == {"a": (4000, "t"), "b": (-1, None)}


def test_a_long_run_keeps_its_start_until_it_is_given_up(spark, tmp_path):
    batches = (
        [("a", "start", 0, "t"), ("z", "start", 0, "t")],
        [("b", "start", 10_000, "t")],
        [("b", "end", 20_000, "t")],
        [("a", "end", 20_001, "t")],
        [(None, "tick", 200_000, None)],
        [("z", "end", 200_001, "t"), (None, "tick", 300_000, None)],
    )
    got = timed(spark, tmp_path / "runs", tmp_path / "out", *batches, open_for="1 day", buckets=2)
    assert got == {"a": (20_001_000, "t"), "b": (10_000_000, "t"), "z": (-1, None)}


def test_usage_over_batches(spark, tmp_path):
    source, out = tmp_path / "calls", str(tmp_path / "out")
    schema = "role string, input_tokens long, output_tokens long"
    prices = spark.createDataFrame([("a", 1.0, 1.0)], "role string, price_in double, price_out double")
    for n in (1, 2, 3, 4):
        put(spark, source, [("a", 10, 5)], schema)
        jobs.running_usage(jobs.read_stream(spark, str(source)), prices, out)
        row = jobs.latest(spark, out).first()
        assert (row.calls, row.total_tokens) == (n, 15 * n)
    assert len([x for x in Path(out).iterdir() if x.name.startswith("version=")]) <= 2


def test_embed_once(spark, tmp_path):
    source, out = tmp_path / "manifest", str(tmp_path / "out")
    schema = "sighting_id long, individual_id long, status string, text string"
    licenses = spark.createDataFrame([(1, "by/"), (2, "by/")], "sighting_id long, license string")
    for rows in ([(1, 1, "ok", "a")], [(1, 1, "ok", "a"), (2, 1, "ok", "b")], [(2, 1, "ok", "b")]):
        put(spark, source, rows, schema)
        jobs.stream_embed(jobs.read_stream(spark, str(source)), licenses, WORDS_64, "text", out)
    assert sorted(r.sighting_id for r in spark.read.parquet(out).collect()) == [1, 2]
    jobs.stream_embed(jobs.read_stream(spark, str(source)), licenses, WORDS_256, "text", out)  # another version starts anew
    got = sorted((r.sighting_id, r.embedder_ver) for r in spark.read.parquet(out).collect())
    assert got == [(i, e.version) for i in (1, 2) for e in (WORDS_256, WORDS_64)]


@pytest.mark.parametrize(
    ("kind", "data", "want"),
    [
        ("on_chat_model_stream", "hi", [("token", "hi")]),
        ("on_chat_model_stream", "", []),
        (
            "on_chat_model_stream",
            json.dumps([{"type": "text", "text": "a"}, {"type": "tool_use"}, {"type": "text", "text": ""}]),
            [("token", "a")],
        ),
        ("on_tool_start", '{"q":1}', [("tool_start", '{"q":1}')]),
        ("on_tool_end", "done", [("tool_end", "done")]),
        ("on_chain_start", "x", []),
    ],
)
def test_frames(spark, kind, data, want):
    rows = spark.createDataFrame([("s", kind, "n", data)], "session_id string, kind string, name string, data string")
    out = jobs.frames(rows.withColumn("ts", F.current_timestamp())).collect()
    assert [(r.frame, r.body) for r in out] == want
