"""Structured Streaming jobs: frames, usage, tool times, slices and embeddings.

Every job keeps its state below the shared checkpoint folder, so a restart on
other executors goes on where the last finished batch ended.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewater.functions.text import token_estimate
from tidewater.operators.conversation import prose_flag
from tidewater.operators.embedders import Embedder
from tidewater.operators.ingest import embed_pending
from tidewater.operators.usage import usage_rollup
from tidewater.session import discard

# fixed values: event kinds of a turn that reach the reader
MODEL_TEXT, TOOL_START, TOOL_END = "on_chat_model_stream", "on_tool_start", "on_tool_end"

def read_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet folder or file as a stream, with the schema of what is there now.

    The path is given as a pattern, which a stream accepts for a single file too.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    path = f"{path[:-1]}[{path[-1]}]"
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def frames(events: DataFrame) -> DataFrame:
    """Text, tool-start and tool-end frames of ``session_id, ts, kind, name, data``.

    Model text is a plain string or a JSON list of blocks, of which only
    non-empty text blocks are shown. Stateless, so it runs on batch and stream.
    """
    blocks = F.from_json("data", "array<struct<type:string,text:string>>")
    listed = F.transform(
        F.filter(blocks, lambda b: (b["type"] == "text") & (F.length(b["text"]) > 0)),
        lambda b: b["text"],
    )
    plain = F.when(F.length("data") > 0, F.array("data")).otherwise(F.array().cast("array<string>"))
    texts = F.when(F.col("data").startswith("["), listed).otherwise(plain)
    shown = F.when(F.col("kind") == MODEL_TEXT, texts).when(
        F.col("kind").isin(TOOL_START, TOOL_END), F.array("data")
    )
    frame = (
        F.when(F.col("kind") == MODEL_TEXT, "token")
        .when(F.col("kind") == TOOL_START, "tool_start")
        .otherwise("tool_end")
    )
    return events.where(F.col("kind").isin(MODEL_TEXT, TOOL_START, TOOL_END)).select(
        "session_id", "ts", frame.alias("frame"), "name", F.explode(shown).alias("body")
    )


def run_to_end(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Append everything available to a Parquet folder, then stop."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", f"{path}.checkpoint")
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()


def running_usage(calls: DataFrame, prices: DataFrame, path: str) -> None:
    """Tokens and cost per role after each batch, a new ``version`` of the table each time.

    :func:`latest` reads the last whole one. The one before it stays for readers that have
    begun, older ones are removed.
    """
    spark = calls.sparkSession

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={batch_id}")
        if batch_id > 1:
            discard(spark, f"{path}/version={batch_id - 2}")

    query = (
        usage_rollup(calls, prices)
        .writeStream.outputMode("complete")
        .foreachBatch(replace)
        .option("checkpointLocation", f"{path}.checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a table that :func:`running_usage` keeps."""
    versions = spark.read.parquet(path)
    return versions.where(F.col("version") == versions.agg(F.max("version").alias("v")).scalar()).drop("version")


def use_keyed_state(spark: SparkSession) -> None:
    """Keep state in the store that has timers and maps; it spills to disk and is checkpointed by difference."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


ELAPSED = "run_id string, tool string, elapsed_ms long"


class ToolRuns(StatefulProcessor):
    """Starts and ends of one bucket of runs, matched whichever comes first.

    Runs that begin and end in one batch never touch the state. ``open`` holds starts
    until their end or for ``open_for``; ``ended`` holds ends without a start until the
    watermark says that none will come.
    """

    def __init__(self, open_for: int):
        self.open_for = open_for  # microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "run_id string", "at long, tool string")
        self.ended = handle.getMapState("ended", "run_id string", "at long")

    def _wake(self, due: list[int]) -> None:
        if due:
            self.handle.registerTimer(min(due) // 1000 + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows))
        # filtered here: before, rows that only move the clock would not be seen by the watermark
        batch = batch[batch["phase"].isin(["start", "end"]) & batch["run_id"].notna() & batch["at"].notna()]
        batch = batch.sort_values(["at", "phase"], ascending=[True, False])
        found, started, unmatched = [], {}, []
        for run, phase, at, tool in zip(batch["run_id"], batch["phase"], batch["at"].astype("int64").tolist(), batch["tool"]):
            if phase == "start":
                started[run] = (at, tool)
            elif run in started:
                start, name = started.pop(run)
                found.append((run, name, round((at - start) / 1000)))
            else:
                unmatched.append((run, at))
        any_open, any_ended = self.open.exists(), self.ended.exists()
        due = []
        for run, at in unmatched:
            held = self.open.getValue((run,)) if any_open else None
            if held is not None and held[0] <= at:
                self.open.removeKey((run,))
                found.append((run, held[1], round((at - held[0]) / 1000)))
            else:
                self.ended.updateValue((run,), (at,))
                due.append(at)
        for run, (at, tool) in started.items():
            held = self.ended.getValue((run,)) if any_ended else None
            if held is not None and held[0] >= at:
                self.ended.removeKey((run,))
                found.append((run, tool, round((held[0] - at) / 1000)))
            else:
                self.open.updateValue((run,), (at, tool))
                due.append(at + self.open_for)
        self._wake(due)
        yield pd.DataFrame(found, columns=["run_id", "tool", "elapsed_ms"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        lost, due = [], []
        for (run,), (at,) in list(self.ended.iterator()):
            if at < now:
                lost.append((run, None, -1))
                self.ended.removeKey((run,))
            else:
                due.append(at)
        for (run,), (at, _) in list(self.open.iterator()):
            if at + self.open_for < now:
                self.open.removeKey((run,))
            else:
                due.append(at + self.open_for)
        self._wake(due)
        yield pd.DataFrame(lost, columns=["run_id", "tool", "elapsed_ms"])

    def close(self) -> None:
        pass


def _micros(duration: str) -> int:
    return int(pd.Timedelta(duration).value // 1000)


def stream_tool_elapsed(
    events: DataFrame, late_by: str = "10 minutes", open_for: str = "30 days", buckets: int = 64
) -> DataFrame:
    """Elapsed milliseconds per tool run from ``run_id, phase, ts, tool`` events.

    Events may be up to ``late_by`` out of order, also an end before its start; later ones
    are dropped. An end whose start has not come by then gives -1. A start stays open for
    ``open_for`` of event time. Runs are dealt to ``buckets``, so that a call handles many
    of them, and each has its own rows in the state. Other phases only move the clock.
    """
    use_keyed_state(events.sparkSession)
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late_by)
        .select(
            F.pmod(F.xxhash64("run_id"), F.lit(buckets)).cast("int").alias("bucket"),
            "run_id", "phase", F.unix_micros("ts").alias("at"), "tool",
        )
        .groupBy("bucket")
        .transformWithStateInPandas(ToolRuns(_micros(open_for)), ELAPSED, "Append", "EventTime")
    )


SLICES = "conv_id long, segment long, start_turn long, end_turn long, n_messages long, prose_tokens long"


class Slices(StatefulProcessor):
    """The open slice, the live tail and the turns of one conversation that came too early."""

    def __init__(self, budget: int, live_tail: int, first_turn: int, forget: int):
        self.budget, self.live_tail, self.first_turn, self.forget = budget, live_tail, first_turn, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "due long, segment long, first long, count long, held long, last long")
        self.tail = handle.getListState("tail", "turn long, tokens long")
        self.early = handle.getMapState("early", "turn long", "tokens long, at long")

    def _advance(self, key: tuple, new: dict[int, tuple[int, int]], now: int) -> pd.DataFrame:
        """Count all turns that are due; ``new`` and the early ones are ``turn: (tokens, time)``.

        A gap is taken as real once a turn behind it is older than the watermark ``now``.
        """
        due, segment, first, count, held, last = self.at.get() if self.at.exists() else (self.first_turn, 0, -1, 0, 0, 0)
        before = dict((turn, value) for (turn,), value in self.early.iterator()) if self.early.exists() else {}
        waiting = before | {turn: value for turn, value in new.items() if turn >= due}  # counted ones are replays
        last = max([last, *(at for _, at in new.values())])
        tail = deque(self.tail.get()) if self.tail.exists() else deque()
        out = []
        while waiting:
            if due not in waiting:
                if min(at for _, at in waiting.values()) >= now:
                    break
                due = min(waiting)
            tail.append((due, waiting.pop(due)[0]))
            due += 1
            while len(tail) > self.live_tail:
                turn, size = tail.popleft()
                first = turn if first < 0 else first
                count, held = count + 1, held + size
                if held >= self.budget:
                    out.append((key[0], segment, first, turn, count, held))
                    segment, first, count, held = segment + 1, -1, 0, 0
        for turn in before.keys() - waiting.keys():
            self.early.removeKey((turn,))
        for turn in waiting.keys() - before.keys():
            self.early.updateValue((turn,), waiting[turn])
        self.at.update((due, segment, first, count, held, last))
        self.tail.put(list(tail)) if tail else self.tail.clear()
        wake = min([last + self.forget, *(at for _, at in waiting.values())])
        self.handle.registerTimer(wake // 1000 + 1)
        return pd.DataFrame(out, columns=[x.split()[0] for x in SLICES.split(", ")])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = {}
        for batch in rows:
            new.update(zip(batch["turn"].tolist(), zip(batch["tokens"].tolist(), batch["at"].tolist())))
        yield self._advance(key, new, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        out = self._advance(key, {}, now)
        if self.at.get()[5] + self.forget < now:
            for state in (self.at, self.tail, self.early):
                state.clear()
        yield out

    def close(self) -> None:
        pass


def stream_segments(
    messages: DataFrame, budget: int, live_tail: int,
    counter: Callable[[Column, Column], Column] = token_estimate,
    first_turn: int = 0, late_by: str = "10 minutes", forget: str = "30 days",
) -> DataFrame:
    """Closed slices as they fill up, from messages with their time ``ts``.

    Turns are counted in order, from ``first_turn`` on: one that comes early waits for the
    missing ones, so the slices do not depend on how the log is cut into batches. Once
    messages ``late_by`` later than a waiting turn have been read, the turns missing before
    it are taken as never sent (what is later than that is dropped). A turn that has been
    counted is a replay and ignored, so a slice is written once. A conversation that was
    silent for ``forget`` leaves the state.
    """
    use_keyed_state(messages.sparkSession)
    tokens = F.when(prose_flag(messages), counter(F.col("role"), F.col("content"))).otherwise(0)
    return (
        messages.withWatermark("ts", late_by)
        .where("conv_id is not null and turn is not null")
        .select("conv_id", "turn", tokens.cast("long").alias("tokens"), F.unix_micros("ts").alias("at"))
        .groupBy("conv_id")
        .transformWithStateInPandas(
            Slices(budget, live_tail, first_turn, _micros(forget)), SLICES, "Append", "EventTime"
        )
    )


def stream_embed(
    manifest: DataFrame, sightings: DataFrame, embedder: Embedder, value: str, path: str
) -> None:
    """Embed readable manifest rows once and append them to ``path``; replays add nothing.

    The ids that were taken are keys of the state, of which a batch looks up its own: what
    it reads does not grow with the life of the stream. Another embedder version has its
    own state. A batch that is run again replaces what it wrote before.
    """
    spark = manifest.sparkSession
    use_keyed_state(spark)
    fresh = manifest.where((F.col("status") == "ok") & F.col("sighting_id").isNotNull()).dropDuplicates(["sighting_id"])
    nothing = spark.createDataFrame([], "sighting_id long, embedder_ver string")

    def append(batch: DataFrame, batch_id: int) -> None:
        new = embed_pending(batch, sightings, nothing, embedder, value)
        new.write.mode("overwrite").parquet(f"{path}/run={embedder.version}-{batch_id}")

    query = (
        fresh.writeStream.foreachBatch(append)
        .option("checkpointLocation", f"{path}.checkpoint/{embedder.version}")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
