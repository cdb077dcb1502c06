"""Streaming jobs run over the given tables until all input is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions.vectors import is_unit
from tidewater.operators.embedders import WORDS_64
from tidewater.plans import bindings as B
from tidewater.plans.conversation_queries import BUDGET, TAIL, fold_sql, segments_sql
from tidewater.plans.registry import query
from tidewater.plans.usage_queries import (
    ELAPSED_SQL,
    USAGE_SQL,
    calls,
    prices,
    text_licenses,
    tool_events,
)
from tidewater.session import scratch_path
from tidewater.sources.scans import table
from tidewater.streaming import jobs

# event types of the log as event kinds of a turn
KINDS = {"view": jobs.MODEL_TEXT, "click": jobs.TOOL_START, "purchase": jobs.TOOL_END}


def _stream(spark, d, name):
    return jobs.read_stream(spark, f"{d}/{name}.parquet")


BATCHES = 3


def _shuffled(spark, log, order, purpose):
    """The log as a stream of a few batches: in ``order`` as a whole, in none inside a batch.

    ``order`` is a number that rises with time; a few rows of each batch come with the
    next one, as late messages do. A last row far ahead moves the clock past the end.
    """
    path = scratch_path(spark, purpose)
    late = F.pmod(F.xxhash64(*log.columns), F.lit(5)) == 0
    ends = log.agg(F.expr(f"percentile_approx({order}, array({', '.join(str(i / BATCHES) for i in range(1, BATCHES))}))").alias("e")).first().e
    number = sum((F.expr(order) > end).cast("int") for end in ends)
    dealt = log.withColumn("_batch", F.least(number + late.cast("int"), F.lit(BATCHES - 1)))
    for i in range(BATCHES):
        dealt.where(F.col("_batch") == i).drop("_batch").repartition(1, F.xxhash64(*log.columns)).write.mode("append").parquet(path)
    return path


def _with_tick(spark, path, log, tick):
    """Appends the row that ends a stream: its columns as given, the others null."""
    columns = [(F.expr(tick[f.name]) if f.name in tick else F.lit(None)).cast(f.dataType).alias(f.name) for f in log.schema]
    log.agg(F.max("ts").alias("last")).select(*columns).write.mode("append").parquet(path)
    return jobs.read_stream(spark, path, files_per_batch=1)


@query(
    "stream_frames",
    """SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS name,
              CASE event_type WHEN 'view' THEN 'token' WHEN 'click' THEN 'tool_start' ELSE 'tool_end' END AS frame,
              CASE WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'text ' || CAST(event_id AS VARCHAR) ELSE props END AS body
       FROM events WHERE event_type IN ('view', 'click', 'purchase')""",
)
def _(spark, d):
    pairs = [F.lit(x) for pair in KINDS.items() for x in pair]
    text = F.concat(F.lit("text "), F.col("event_id").cast("string"))
    blocks = F.to_json(
        F.array(
            F.struct(F.lit("text").alias("type"), text.alias("text")),
            F.struct(F.lit("tool_use").alias("type"), F.lit("-").alias("text")),
            F.struct(F.lit("text").alias("type"), F.lit("").alias("text")),
        )
    )
    listed = (F.col("event_type") == "view") & (F.col("event_id") % 2 == 0)
    events = _stream(spark, d, "events").select(
        F.col("user_id").cast("string").alias("session_id"), "ts",
        F.try_element_at(F.create_map(*pairs), F.col("event_type")).alias("kind"),
        F.col("event_id").alias("name"),
        F.when(listed, blocks).otherwise(F.col("props")).alias("data"),
    )
    out = scratch_path(spark, "frames")
    jobs.run_to_end(jobs.frames(events), out)
    return spark.read.parquet(out).select("session_id", "name", "frame", "body")


@query("stream_usage", USAGE_SQL)
def _(spark, d):
    out = scratch_path(spark, "usage")
    jobs.running_usage(calls(_stream(spark, d, "events")), prices(spark), out)
    return jobs.latest(spark, out).withColumn("estimated_cost", B.rounded("estimated_cost"))


@query("stream_tool_elapsed", f"SELECT * FROM {ELAPSED_SQL}")
def _(spark, d):
    """Batches in time order, their rows in none; ends come before their starts as well."""
    out = scratch_path(spark, "elapsed")
    log = tool_events(table(spark, d, "events"))
    path = _shuffled(spark, log, "cast(run_id as bigint)", "runs")
    events = _with_tick(spark, path, log, {"ts": "last + interval 100 days", "phase": "'tick'"})
    jobs.run_to_end(jobs.stream_tool_elapsed(events, late_by="60 days", open_for="90 days"), out)
    return spark.read.parquet(out)


PLAIN_LOG_SQL = f"""(
  SELECT *, {B.TOKENS_SQL} AS tokens, true AS is_prose
  FROM (SELECT conv_id, turn, role, text AS content FROM conversations))"""


@query("stream_segments", segments_sql(fold_sql(PLAIN_LOG_SQL, BUDGET, TAIL)))
def _(spark, d):
    """A turn a minute, in a few batches with late turns; whatever turn a conversation starts with."""
    out = scratch_path(spark, "segments")
    at = F.timestamp_seconds(F.col("turn") * 60)
    log = table(spark, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"), at.alias("ts"))
    path = _shuffled(spark, log, "turn", "log")
    messages = _with_tick(spark, path, log, {"conv_id": "-1", "turn": "0", "role": "'human'", "content": "''", "ts": "last + interval 1 day"})
    jobs.run_to_end(jobs.stream_segments(messages, BUDGET, TAIL, late_by="12 hours"), out)
    return spark.read.parquet(out)


@query(
    "stream_embed",
    """SELECT doc_id AS sighting_id, 64 AS width, true AS unit FROM documents
       WHERE n_chars > 20 AND lang IN ('en', 'fr') AND len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) > 0""",
)
def _(spark, d):
    """Two batches, of which the second repeats rows of the first."""
    out, again = scratch_path(spark, "embedded"), scratch_path(spark, "manifest")
    docs = table(spark, d, "documents")
    for part in (docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 <> 1")):
        part.write.mode("append").parquet(again)
    manifest = jobs.read_stream(spark, again, files_per_batch=1).select(
        F.col("doc_id").alias("sighting_id"), F.col("doc_id").alias("individual_id"),
        F.when(F.col("n_chars") > 20, "ok").otherwise("failed").alias("status"), "text",
    )
    licenses = text_licenses(table(spark, d, "documents"))
    jobs.stream_embed(manifest, licenses, WORDS_64, "text", out)
    return spark.read.parquet(out).select(
        "sighting_id", F.size("embedding").alias("width"), is_unit(F.col("embedding")).alias("unit")
    )
