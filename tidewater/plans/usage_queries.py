"""Usage and ingest queries on the event log and the manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions.vectors import is_unit
from tidewater.operators import usage as U
from tidewater.operators.embedders import WORDS_64
from tidewater.operators.ingest import embed_pending, flag_unreadable
from tidewater.plans import bindings as B
from tidewater.plans.registry import query
from tidewater.sources.scans import table

K_SQL = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
PRICES = (("click", 3.0, 15.0), ("view", 0.25, 1.25), ("purchase", 1.0, 5.0))
PRICES_SQL = "(SELECT * FROM (VALUES " + ", ".join(
    f"('{r}', {a}::DOUBLE, {b}::DOUBLE)" for r, a, b in PRICES
) + ") AS p(role, price_in, price_out))"
USAGE_SQL = f"""
  SELECT role, calls, input_tokens, output_tokens, input_tokens + output_tokens AS total_tokens,
         round((input_tokens * price_in + output_tokens * price_out) / 1e6, 6) AS estimated_cost
  FROM (SELECT event_type AS role, count(*) AS calls, CAST(sum({K_SQL}) AS BIGINT) AS input_tokens,
               CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS output_tokens
        FROM events WHERE {K_SQL} <> 0 OR floor(value) <> 0 GROUP BY 1)
  LEFT JOIN {PRICES_SQL} USING (role)"""


def calls(events):
    return events.select(
        F.col("event_type").alias("role"),
        F.get_json_object("props", "$.k").cast("long").alias("input_tokens"),
        F.floor("value").cast("long").alias("output_tokens"),
    )


def prices(spark):
    return spark.createDataFrame(list(PRICES), "role string, price_in double, price_out double")


@query("usage_rollup", USAGE_SQL)
def _(spark, d):
    out = U.usage_rollup(calls(table(spark, d, "events")), prices(spark))
    return out.withColumn("estimated_cost", B.rounded("estimated_cost"))


@query(
    "node_rollup",
    f"""SELECT event_type AS node, CASE WHEN {K_SQL} % 7 = 0 THEN 'error' ELSE 'ok' END AS status, count(*) AS n,
               round(avg(value), 6) AS mean_ms, max(value) AS max_ms,
               count(*) FILTER ({K_SQL} % 7 = 0) AS errors,
               round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms
        FROM events GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY 1, 2"),
)
def _(spark, d):
    failed = F.get_json_object("props", "$.k").cast("long") % 7 == 0
    runs = table(spark, d, "events").select(
        F.col("event_type").alias("node"),
        F.when(failed, "error").otherwise("ok").alias("status"),
        F.col("value").alias("elapsed_ms"),
        F.when(failed, F.lit("failed")).alias("error"),
    )
    out = U.node_rollup(runs)
    return out.withColumns({c: B.rounded(c) for c in ("mean_ms", "p50_ms", "p95_ms")})


# every two following events are one tool run; each tenth run lost its start
RUNS_SQL = """(
  SELECT CAST(event_id // 2 AS VARCHAR) AS run_id, CASE WHEN event_id % 2 = 0 THEN 'start' ELSE 'end' END AS phase,
         ts, event_type AS tool FROM events WHERE NOT (event_id % 2 = 0 AND event_id // 2 % 10 = 3))"""
ELAPSED_SQL = f"""(
  SELECT run_id, max(tool) FILTER (phase = 'start') AS tool,
         coalesce(CAST(round_even((epoch_us(max(ts) FILTER (phase = 'end')) - epoch_us(max(ts) FILTER (phase = 'start')))
                       / 1000::DOUBLE, 0) AS BIGINT), -1) AS elapsed_ms
  FROM {RUNS_SQL} GROUP BY run_id HAVING count(*) FILTER (phase = 'end') > 0)"""


def tool_events(events):
    run = F.floor(F.col("event_id") / 2)
    start = F.col("event_id") % 2 == 0
    rows = events.select(
        run.cast("string").alias("run_id"),
        F.when(start, "start").otherwise("end").alias("phase"),
        "ts",
        F.col("event_type").alias("tool"),
    )
    return rows.where(~((F.col("phase") == "start") & (F.col("run_id").cast("long") % 10 == 3)))


@query("tool_elapsed", f"SELECT * FROM {ELAPSED_SQL}")
def _(spark, d):
    return U.tool_elapsed(tool_events(table(spark, d, "events")))


# documents as images to embed: the text is what the embedder reads
def text_manifest(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(
        F.col("doc_id").alias("sighting_id"), F.col("doc_id").alias("individual_id"),
        F.concat(F.lit("blobs/"), F.col("doc_id").cast("string")).alias("asset_ref"),
        F.when(F.col("n_chars") > 20, "ok").otherwise("failed").alias("status"), "text",
    )


def text_licenses(docs):
    return docs.select(
        F.col("doc_id").alias("sighting_id"),
        F.when(F.col("lang") == "de", B.BY_ND).when(F.col("lang") != "es", B.BY).alias("license"),
    )


def stored_labels(spark, d):
    return table(spark, d, "labels").select(
        F.col("doc_id").alias("sighting_id"), F.lit(WORDS_64.version).alias("embedder_ver")
    )


EMBED_SQL = """(
  SELECT doc_id AS sighting_id, 64 AS width, true AS unit FROM documents
  WHERE n_chars > 20 AND lang IN ('en', 'fr') AND len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) > 0
    AND doc_id NOT IN (SELECT doc_id FROM labels))"""


@query("embed_pending", f"SELECT * FROM {EMBED_SQL}")
def _(spark, d):
    new = embed_pending(
        text_manifest(spark, d), text_licenses(table(spark, d, "documents")), stored_labels(spark, d),
        WORDS_64, "text",
    )
    return new.select("sighting_id", F.size("embedding").alias("width"), is_unit(F.col("embedding")).alias("unit"))


@query(
    "flag_unreadable",
    """SELECT doc_id AS sighting_id, CASE WHEN n_chars > 20 AND NOT contains(text, '. ') THEN 'corrupt'
              WHEN n_chars > 20 THEN 'ok' ELSE 'failed' END AS status,
              n_chars > 20 AND NOT contains(text, '. ') AS changed FROM documents""",
)
def _(spark, d):
    """Texts without a sentence end count as unreadable here (files: the image check)."""
    manifest = text_manifest(spark, d)
    blobs = manifest.select("asset_ref", F.col("text").alias("content"))
    out = flag_unreadable(manifest, blobs, readable=F.col("content").contains(". "))
    return out.select("sighting_id", "status", "changed")
