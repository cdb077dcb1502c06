"""Message log queries on the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import conversation as V
from tidewater.plans import bindings as B
from tidewater.plans.registry import query
from tidewater.session import stored

BUDGET = 120
TAIL = 2

LOG_SQL = f"(SELECT *, {B.TOKENS_SQL} AS tokens, {B.PROSE_SQL} AS is_prose FROM {B.MESSAGES_SQL})"


def log(spark, d):
    return V.with_tokens(B.messages(spark, d))


@query("prose_flag", f"SELECT conv_id, turn, is_prose FROM {LOG_SQL}")
def _(spark, d):
    return log(spark, d).select("conv_id", "turn", "is_prose")


@query("token_estimate", f"SELECT conv_id, turn, tokens FROM {LOG_SQL}")
def _(spark, d):
    return log(spark, d).select("conv_id", "turn", "tokens")


def fold_sql(log_sql: str, budget: int, tail: int) -> str:
    """Greedy slices by a recursive fold over the turns outside the live tail."""
    return f"""(
      WITH RECURSIVE e AS (
        SELECT conv_id, turn, CASE WHEN is_prose THEN tokens ELSE 0 END AS t,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM {log_sql})
        WHERE back > {tail}),
      f AS (
        SELECT conv_id, i, turn, t, 0::BIGINT AS segment, t AS acc FROM e WHERE i = 1
        UNION ALL
        SELECT e.conv_id, e.i, e.turn, e.t, CASE WHEN f.acc >= {budget} THEN f.segment + 1 ELSE f.segment END,
               CASE WHEN f.acc >= {budget} THEN e.t ELSE f.acc + e.t END
        FROM f JOIN e ON e.conv_id = f.conv_id AND e.i = f.i + 1)
      SELECT * FROM f QUALIFY max(acc) OVER (PARTITION BY conv_id, segment) >= {budget})"""


NUMBERS_SQL = fold_sql(LOG_SQL, BUDGET, TAIL)


def numbers(spark, d):
    """Slice numbers, written once: every later step reads them."""
    return stored(V.segment_numbers(log(spark, d), BUDGET, TAIL), "slices")


def slices(spark, d):
    return V.sliced(log(spark, d), numbers(spark, d))


def segments_sql(numbers_sql: str) -> str:
    return f"""SELECT conv_id, segment, min(turn) AS start_turn, max(turn) AS end_turn, count(*) AS n_messages,
                      CAST(sum(t) AS BIGINT) AS prose_tokens FROM {numbers_sql} GROUP BY ALL"""


@query("prose_segments", segments_sql(NUMBERS_SQL))
def _(spark, d):
    return V.prose_segments(log(spark, d), BUDGET, TAIL)


@query("prose_segments_blocks", segments_sql(fold_sql(LOG_SQL, 60, 1)))
def _(spark, d):
    """The same slices with conversations cut into blocks of two turns (the path of huge logs)."""
    return V.prose_segments(log(spark, d), 60, 1, block=2)


@query(
    "transcript_json",
    f"""SELECT conv_id, segment, '[' || string_agg('{{"message_id":' || CAST(to_json(msg_id) AS VARCHAR)
               || ',"type":' || CAST(to_json(role) AS VARCHAR) || ',"content":' || CAST(to_json(content) AS VARCHAR) || '}}',
               ',' ORDER BY turn) || ']' AS transcript
        FROM {NUMBERS_SQL} JOIN (SELECT conv_id, turn, msg_id, role, content FROM {LOG_SQL} WHERE is_prose)
        USING (conv_id, turn) GROUP BY ALL""",
)
def _(spark, d):
    return V.transcript_json(slices(spark, d))


SUMMARIES_SQL = f"""(
  SELECT conv_id, segment, '{V.SUMMARY_FRAME}' || s AS content,
         CAST(ceil((length(s) + 5) / 4::DOUBLE) + 3 AS BIGINT) AS tokens FROM (
    SELECT conv_id, segment, string_agg(string_split(content, chr(10))[1], chr(10) ORDER BY turn) AS s
    FROM {NUMBERS_SQL} JOIN (SELECT conv_id, turn, content FROM {LOG_SQL} WHERE is_prose) USING (conv_id, turn)
    GROUP BY ALL))"""


@query("summary_rows", f"SELECT conv_id, segment, content, tokens, 'human' AS role FROM {SUMMARIES_SQL}")
def _(spark, d):
    return V.summary_rows(slices(spark, d)).select("conv_id", "segment", "content", "tokens", "role")


# calls and results of a slice; a call and its result may fall into two slices
HALVES_SQL = f"""(
  SELECT n.conv_id, n.segment, n.turn, call_id AS id, 'tool_' || CAST(n.turn AS VARCHAR) AS name,
         '{{"turn":' || CAST(n.turn AS VARCHAR) || '}}' AS query, NULL AS summary
  FROM {NUMBERS_SQL} n JOIN {B.MESSAGES_SQL} m USING (conv_id, turn) WHERE call_id IS NOT NULL AND role = 'assistant'
  UNION ALL
  SELECT n.conv_id, n.segment, n.turn, tool_call_id, NULL, NULL, left(content, 40)
  FROM {NUMBERS_SQL} n JOIN {B.MESSAGES_SQL} m USING (conv_id, turn) WHERE role = 'tool')"""
BRIEFS_SQL = f"""(
  WITH b AS (SELECT conv_id, segment, id, min(turn) AS first, max(name) AS name, max(query) AS query, max(summary) AS summary
             FROM {HALVES_SQL} GROUP BY ALL),
  fresh AS (SELECT conv_id, id, min(segment) AS s FROM b GROUP BY ALL)
  SELECT conv_id, segment, id, name, query, summary,
         (SELECT count(*) FROM fresh f WHERE f.conv_id = b.conv_id AND f.s < b.segment)
           + row_number() OVER (PARTITION BY conv_id, segment ORDER BY first, id) - 1 AS ordinal FROM b)"""


def briefs(spark, d):
    return V.tool_briefs(slices(spark, d), 40)


@query("tool_briefs", f"SELECT * FROM {BRIEFS_SQL}")
def _(spark, d):
    return briefs(spark, d)


@query("brief_ordinals", f"SELECT conv_id, id, ordinal + 5 AS ordinal, segment FROM {BRIEFS_SQL}")
def _(spark, d):
    """Ordinals go on from what is stored already (five briefs in every conversation)."""
    base = log(spark, d).select("conv_id").distinct().withColumn("n", F.lit(5))
    out = V.tool_briefs(slices(spark, d), 40, base)
    return out.select("conv_id", "id", "ordinal", "segment")


STATE_SQL = f"""(
  SELECT conv_id, id, max(segment) AS segment, last(ordinal ORDER BY segment) AS ordinal,
         last(name ORDER BY segment) AS name, last(query ORDER BY segment) AS query,
         last(summary ORDER BY segment) AS summary FROM {BRIEFS_SQL} GROUP BY conv_id, id)"""


@query("tool_pair_merge", f"SELECT conv_id, id, ordinal, name, query, summary FROM {STATE_SQL}")
def _(spark, d):
    return V.merge_briefs(briefs(spark, d))


@query(
    "orphan_tool_calls",
    f"""WITH h AS (SELECT conv_id, call_id AS id, true AS c FROM {B.MESSAGES_SQL} WHERE call_id IS NOT NULL AND role = 'assistant'
                   UNION ALL SELECT conv_id, tool_call_id, false FROM {B.MESSAGES_SQL} WHERE role = 'tool')
        SELECT conv_id, id, bool_or(c) AS has_call, bool_or(NOT c) AS has_result FROM h
        GROUP BY ALL HAVING NOT (bool_or(c) AND bool_or(NOT c))""",
)
def _(spark, d):
    return V.orphan_tool_calls(B.messages(spark, d))


def fit_sql(items: str, budgets: str, ord_col: str) -> str:
    """The newest run of ``items(conv_id, ord, size)`` within ``budgets(conv_id, budget)``."""
    return f"""(
      SELECT i.conv_id, {ord_col}, size, sum(size) OVER (PARTITION BY i.conv_id ORDER BY {ord_col} DESC) AS used, budget
      FROM {items} i JOIN {budgets} b USING (conv_id) QUALIFY used <= budget)"""


@query(
    "budget_fit",
    f"""SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM {fit_sql(
        f"(SELECT conv_id, turn, tokens AS size FROM {LOG_SQL})",
        "(SELECT DISTINCT conv_id, 250 AS budget FROM conversations)", "turn")}""",
)
def _(spark, d):
    rows = log(spark, d)
    budgets = rows.select("conv_id").distinct().withColumn("budget", F.lit(250))
    items = rows.select("conv_id", "turn", F.col("tokens").alias("size"))
    return V.budget_fit(items, budgets, "turn").select("conv_id", "turn", "used")


def tail_sql(budget: int) -> str:
    return f"""(
      WITH s AS (SELECT conv_id, coalesce(max(turn) FILTER (role = 'user'), min(turn)) AS start FROM {LOG_SQL} GROUP BY 1),
      m AS (SELECT conv_id, sum(tokens) AS must FROM {LOG_SQL} JOIN s USING (conv_id) WHERE turn >= start GROUP BY 1),
      o AS (SELECT conv_id, turn, role, tokens, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used
            FROM {LOG_SQL} JOIN s USING (conv_id) WHERE turn < start),
      k AS (SELECT o.* FROM o JOIN m USING (conv_id) WHERE used <= {budget} - must),
      h AS (SELECT conv_id, min(turn) FILTER (role <> 'tool') AS head FROM k GROUP BY 1)
      SELECT l.conv_id, l.turn, l.role, l.content, l.tokens,
             l.turn >= s.start OR (k.turn IS NOT NULL AND l.turn >= coalesce(h.head, 1e9)) AS kept,
             must > {budget} AS overflow
      FROM {LOG_SQL} l JOIN s USING (conv_id) JOIN m USING (conv_id) LEFT JOIN h USING (conv_id)
      LEFT JOIN k ON k.conv_id = l.conv_id AND k.turn = l.turn)"""


def ceilings(spark, d, budget):
    return log(spark, d).select("conv_id").distinct().withColumn("budget", F.lit(budget))


@query("fit_tail", f"SELECT conv_id, turn, kept, overflow FROM {tail_sql(260)}")
def _(spark, d):
    out = V.fit_tail(log(spark, d), ceilings(spark, d, 260))
    return out.select("conv_id", "turn", "kept", "overflow")


# view after the slices: tail after the last slice, summaries, and the state of the briefs
AFTER_SQL = f"""(
  SELECT l.* FROM {LOG_SQL} l LEFT JOIN (SELECT conv_id, max(turn) AS mark FROM {NUMBERS_SQL} GROUP BY 1) USING (conv_id)
  WHERE mark IS NULL OR l.turn > mark)"""


def view_parts(spark, d):
    """Tail, summaries and briefs; the deltas of the sweep are durable tables."""
    rows = log(spark, d)
    summaries, new_briefs, marks = V.delta_of(V.sliced(rows, numbers(spark, d)), 40)
    tail = stored(V.after_bookmark(rows, marks).drop("tool_calls"), "tail")
    return tail, stored(summaries, "summaries"), stored(V.merge_briefs(new_briefs), "briefs")


@query(
    "prepare_delta",
    f"""SELECT conv_id, CAST(conv_id AS VARCHAR) || '-' || CAST(max(turn) AS VARCHAR) AS bookmark_id,
               count(DISTINCT segment) AS n_summaries,
               (SELECT count(*) FROM {BRIEFS_SQL} b WHERE b.conv_id = n.conv_id) AS n_briefs
        FROM {NUMBERS_SQL} n GROUP BY conv_id""",
)
def _(spark, d):
    summaries, new_briefs, marks = V.prepare_delta(log(spark, d), BUDGET, TAIL, 40)
    count = lambda df, name: df.groupBy("conv_id").agg(F.count(F.lit(1)).alias(name))
    joined = marks.join(count(summaries, "n_summaries"), "conv_id", "left").join(
        count(new_briefs, "n_briefs"), "conv_id", "left"
    )
    return joined.na.fill(0, ["n_summaries", "n_briefs"])


BRIEF_LINE_SQL = """'{"id":' || CAST(to_json(id) AS VARCHAR) || ',"ordinal":' || CAST(ordinal AS VARCHAR)
  || CASE WHEN name IS NULL THEN '' ELSE ',"name":' || CAST(to_json(name) AS VARCHAR) END
  || CASE WHEN query IS NULL THEN '' ELSE ',"query":' || CAST(to_json(query) AS VARCHAR) END
  || CASE WHEN summary IS NULL THEN '' ELSE ',"summary":' || CAST(to_json(summary) AS VARCHAR) END || '}'"""


@query(
    "build_view",
    f"""SELECT conv_id, 0 AS layer, 0::BIGINT AS pos, 'human' AS role,
               '{V.MANIFEST_FRAME}' || string_agg({BRIEF_LINE_SQL}, chr(10) ORDER BY ordinal) AS content
        FROM {STATE_SQL} GROUP BY conv_id
        UNION ALL SELECT conv_id, 1, segment, 'human', content FROM {SUMMARIES_SQL}
        UNION ALL SELECT conv_id, 2, turn, role, content FROM {AFTER_SQL}""",
)
def _(spark, d):
    tail, summaries, state = view_parts(spark, d)
    return V.build_view(tail, summaries, state)


CEILING = 300
CEILING_TAIL_SQL = tail_sql(CEILING).replace(LOG_SQL, AFTER_SQL)
SIZED_BRIEFS_SQL = f"""(
  SELECT *, CAST(ceil((length({BRIEF_LINE_SQL}) + 5) / 4::DOUBLE) + 3 AS BIGINT) AS size FROM {STATE_SQL})"""


@query(
    "fit_to_ceiling",
    f"""WITH t AS (SELECT * FROM {CEILING_TAIL_SQL}),
        b1 AS (SELECT conv_id, {CEILING} - sum(tokens) AS budget FROM t WHERE kept AND NOT overflow GROUP BY 1),
        s AS (SELECT * FROM {fit_sql(f"(SELECT conv_id, segment, tokens AS size FROM {SUMMARIES_SQL})", "b1", "segment")}),
        b2 AS (SELECT conv_id, budget - coalesce((SELECT sum(size) FROM s WHERE s.conv_id = b1.conv_id), 0) AS budget FROM b1),
        m AS (SELECT * FROM {fit_sql(f"(SELECT conv_id, ordinal, size FROM {SIZED_BRIEFS_SQL})", "b2", "ordinal")})
        SELECT conv_id, 'tail' AS layer, turn AS pos FROM t WHERE kept AND NOT overflow
        UNION ALL SELECT conv_id, 'summary', segment FROM s UNION ALL SELECT conv_id, 'brief', ordinal FROM m
        UNION ALL SELECT DISTINCT conv_id, 'overflow', 0 FROM t WHERE overflow""",
)
def _(spark, d):
    tail, summaries, state = view_parts(spark, d)
    sized = state.withColumn("_line", V.brief_json()).withColumn(
        "size", (F.ceil((F.length("_line") + 5) / 4) + 3).cast("long")
    )
    rows, texts, lines, lost = V.fit_to_ceiling(tail, summaries, sized, ceilings(spark, d, CEILING))
    part = lambda df, name, pos: df.select(
        "conv_id", F.lit(name).alias("layer"), F.col(pos).cast("long").alias("pos")
    )
    return part(rows, "tail", "turn").unionByName(part(texts, "summary", "segment")).unionByName(
        part(lines, "brief", "ordinal")
    ).unionByName(part(lost.withColumn("pos", F.lit(0)), "overflow", "pos"))


@query(
    "retention_apply",
    f"""SELECT conv_id, msg_id, CASE
                 WHEN role = 'tool' AND conv_id % 3 = 1 THEN left(content, 20) || ' [ref_' || sha256(CAST(conv_id AS VARCHAR) || '/' || msg_id) || ']'
                 WHEN role = 'tool' AND conv_id % 3 = 2 THEN 'tool_2 result not retained (ref_'
                      || sha256(CAST(conv_id AS VARCHAR) || '/' || msg_id) || '); re-call to refresh'
                 ELSE content END AS content,
               role = 'tool' AND conv_id % 3 = 1 AS moved
        FROM {B.MESSAGES_SQL}""",
)
def _(spark, d):
    """Tools 0, 1, 2 by conversation: kept, moved out with a stub, and tombstoned."""
    cold = B.messages(spark, d).withColumn(
        "tool_name", F.concat(F.lit("tool_"), (F.col("conv_id") % 3).cast("string"))
    )
    policies = spark.createDataFrame(
        [("tool_1", "external"), ("tool_2", "ephemeral")], "tool_name string, policy string"
    )
    rows, payloads = V.retention_apply(cold, policies, extract_chars=20)
    moved = payloads.select("ref", F.lit(True).alias("_m"))
    return rows.join(moved, "ref", "left").select(
        "conv_id", "msg_id", "content", F.coalesce("_m", F.lit(False)).alias("moved")
    )


@query(
    "latest_token_count",
    "SELECT conv_id, last(length(text) ORDER BY turn) AS token_count FROM conversations GROUP BY conv_id",
)
def _(spark, d):
    rows = B.plain_messages(spark, d).withColumn("token_count", F.length("content").cast("long"))
    return V.latest_token_count(rows)
