"""Evaluation of re-identification, votes and calibration on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import evaluation as E
from tidewater.operators import similarity as S
from tidewater.plans import bindings as B
from tidewater.plans.registry import query
from tidewater.plans.similarity_queries import (
    HALF_PAIRS_SQL,
    PAIRS_SQL,
    PEOPLE_SQL,
    candidates,
    people_sql,
)
from tidewater.session import stored
from tidewater.sources.scans import table


def reid_cases(spark, d):
    return B.image_queries(spark, d).select(
        F.concat(F.lit("reid-"), F.col("query_id").cast("string")).alias("case_id"), "query_id", "true_id"
    )


def scores_sql(people: str) -> str:
    """Long scores of reid@1 and reid@5 per case."""
    return f"""(
      WITH h AS (SELECT vec_id AS query_id, min(rank) AS pos FROM embeddings
                 LEFT JOIN {people} p ON p.query_id = vec_id AND p.individual_id = label GROUP BY 1)
      SELECT 'reid-' || CAST(query_id AS VARCHAR) AS case_id, m.metric, CAST(m.value AS DOUBLE) AS value, m.passed
      FROM h, LATERAL (VALUES
        ('reid@1', CASE WHEN pos = 1 THEN 1 ELSE 0 END, coalesce(pos = 1, false)),
        ('reid@1_precision@1', CASE WHEN pos = 1 THEN 1 ELSE 0 END, NULL),
        ('reid@1_mrr', CASE WHEN pos = 1 THEN 1 ELSE 0 END, NULL),
        ('reid@5', CASE WHEN pos <= 5 THEN 1 ELSE 0 END, coalesce(pos <= 5, false)),
        ('reid@5_precision@5', CASE WHEN pos <= 5 THEN 1::DOUBLE / (
             SELECT count(*) FROM {people} x WHERE x.query_id = h.query_id) ELSE 0 END, NULL),
        ('reid@5_mrr', CASE WHEN pos <= 5 THEN 1::DOUBLE / pos ELSE 0 END, NULL)) AS m(metric, value, passed))"""


SCORES_SQL = scores_sql(PEOPLE_SQL)


def reid_scores(spark, d, ranked):
    """Scores of stored answers, at one and at five."""
    cases = reid_cases(spark, d)
    ranked = stored(ranked.select("query_id", "individual_id", "rank"), "ranked")
    at_1 = E.reid_scores(cases, ranked, "reid@1", 1)
    return at_1.unionByName(E.reid_scores(cases, ranked, "reid@5", 5))


@query("retrieval_ranking", f"SELECT case_id, metric, round(value, 6) AS value, passed FROM {SCORES_SQL}")
def _(spark, d):
    return reid_scores(spark, d, candidates(spark, d)).withColumn("value", B.rounded("value"))


@query(
    "metric_means",
    f"""SELECT metric, round(avg(value), 6) AS mean, count(*) AS n_cases,
               count(*) FILTER (passed) AS n_passed FROM {SCORES_SQL} GROUP BY metric""",
)
def _(spark, d):
    out = E.metric_means(reid_scores(spark, d, candidates(spark, d)))
    return out.withColumn("mean", B.rounded("mean"))


@query(
    "span_ranking",
    """WITH top AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM conversations
                   WHERE turn > 0 QUALIFY rank <= 3),
       a AS (SELECT conv_id, min(turn) AS t FROM conversations WHERE role = 'assistant' GROUP BY 1),
       s AS (SELECT a.conv_id, (SELECT count(*) FROM top WHERE top.conv_id = a.conv_id) AS n,
                    (SELECT min(rank) FROM top WHERE top.conv_id = a.conv_id AND top.turn = a.t) AS pos
             FROM a)
       SELECT conv_id AS case_id, m.metric, round(m.value, 6) AS value, m.passed FROM s, LATERAL (VALUES
         ('find', CAST(pos IS NOT NULL AS INT)::DOUBLE, pos IS NOT NULL),
         ('find_precision@3', CASE WHEN pos IS NULL THEN 0 ELSE 1::DOUBLE / n END, NULL),
         ('find_mrr', CASE WHEN pos IS NULL THEN 0 ELSE 1::DOUBLE / pos END, NULL)) AS m(metric, value, passed)""",
)
def _(spark, d):
    """Span rule: the first assistant turn of a conversation is the anchor, found by path and lines."""
    rows = table(spark, d, "conversations")
    path = F.concat(F.lit("log/"), F.col("conv_id").cast("string"), F.lit(".txt"))
    anchors = rows.where("role = 'assistant'").groupBy("conv_id").agg(F.min("turn").alias("t")).select(
        F.col("conv_id").alias("case_id"), F.lit(0).alias("anchor_no"), F.lit(True).alias("must"),
        path.alias("path"), F.lit(None).cast("string").alias("symbol"),
        (F.col("t") * 10).alias("start"), (F.col("t") * 10 + 4).alias("end"),
    )
    returned = rows.where("turn > 0").withColumn("_p", path).select(
        F.col("conv_id").alias("case_id"), F.lit(0).alias("sample_no"),
        F.col("turn").alias("rank"), F.concat(F.lit("/data/"), "_p").alias("path"),
        F.lit(None).cast("string").alias("symbol"),
        (F.col("turn") * 10 + 2).alias("start"), (F.col("turn") * 10 + 8).alias("end"),
    )
    cases = rows.select(F.col("conv_id").alias("case_id")).distinct()
    out = E.retrieval_ranking(
        cases, anchors, cases.withColumn("sample_no", F.lit(0)), returned, "find", k=3
    )
    return out.withColumn("value", B.rounded("value"))


# labels as repeated votes: eight neighbouring documents are the samples of one case
VOTES_SQL = "(SELECT doc_id // 8 AS case_id, doc_id, quality, toxic FROM labels)"


def votes(spark, d):
    return table(spark, d, "labels").withColumn("case_id", F.floor(F.col("doc_id") / 8))


def vote_cases(spark, d):
    """Every block of documents, also those without a label; some expect nothing."""
    blocks = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 8).alias("case_id")).distinct()
    return blocks.withColumn("expected", F.when(F.col("case_id") % 5 != 0, F.col("case_id") % 2 == 0))


CASES_SQL = """(SELECT DISTINCT doc_id // 8 AS case_id,
                       CASE WHEN doc_id // 8 % 5 <> 0 THEN doc_id // 8 % 2 = 0 END AS expected FROM documents)"""
BOOLEAN_SQL = f"""(
  WITH v AS (SELECT case_id, count(*) AS n, count(*) FILTER (quality = 1) AS t FROM {VOTES_SQL} GROUP BY 1)
  SELECT case_id, 'quality' AS metric, CAST(coalesce((t * 2 > n) = expected, false) AS INT)::DOUBLE AS value,
         coalesce((t * 2 > n) = expected, false) AS passed
  FROM {CASES_SQL} LEFT JOIN v USING (case_id) WHERE n IS NULL OR expected IS NOT NULL)"""


def boolean_scores(spark, d):
    samples = votes(spark, d).select("case_id", (F.col("quality") == 1).alias("flag"))
    return E.boolean_vote(vote_cases(spark, d), samples, "quality")


@query("boolean_vote", f"SELECT * FROM {BOOLEAN_SQL}")
def _(spark, d):
    return boolean_scores(spark, d)


@query(
    "numeric_tolerance",
    f"""WITH v AS (SELECT case_id, abs(avg(toxic) - 0.1::DOUBLE) AS e FROM {VOTES_SQL} GROUP BY 1),
        c AS (SELECT case_id, e FROM {CASES_SQL} LEFT JOIN v USING (case_id))
        SELECT case_id, 'toxic' AS metric, CAST(coalesce(e <= 0.2, false) AS INT)::DOUBLE AS value,
               coalesce(e <= 0.2, false) AS passed FROM c
        UNION ALL SELECT case_id, 'toxic_mae', round(e, 6), NULL FROM c WHERE e IS NOT NULL""",
)
def _(spark, d):
    cases = vote_cases(spark, d).withColumn("expected", F.lit(0.1))
    samples = votes(spark, d).select("case_id", F.col("toxic").alias("number"))
    out = E.numeric_tolerance(cases, samples, "toxic", 0.2)
    return out.withColumn("value", B.rounded("value"))


@query(
    "keyword_presence",
    """WITH h AS (SELECT conv_id, string_agg(lower(text), ' ' ORDER BY turn) FILTER (role = 'assistant') AS hay
                  FROM conversations GROUP BY 1),
       c AS (SELECT conv_id AS case_id, hay, list_transform(['the', 'La', 'der ', 'zzz'], lambda w: lower(w)) AS req FROM h)
       SELECT case_id, 'grounded' AS metric,
              CASE WHEN hay IS NULL THEN 0 ELSE len(list_filter(req, lambda w: contains(hay, w))) / 4::DOUBLE END AS value,
              CASE WHEN hay IS NOT NULL THEN len(list_filter(req, lambda w: contains(hay, w))) = 4 END AS passed FROM c""",
)
def _(spark, d):
    rows = table(spark, d, "conversations")
    cases = rows.select(F.col("conv_id").alias("case_id")).distinct().withColumn(
        "required", F.array(*[F.lit(w) for w in ("the", "La", "der ", "zzz")])
    )
    samples = rows.where("role = 'assistant'").select(
        F.col("conv_id").alias("case_id"), F.col("turn").alias("sample_no"), "text"
    )
    return E.keyword_presence(cases, samples, "grounded")


@query(
    "judge_rollup",
    f"""WITH g AS (SELECT case_id, avg(1 - toxic * 0.5::DOUBLE) AS m,
                          string_agg('doc ' || CAST(doc_id AS VARCHAR), ' | ' ORDER BY doc_id) FILTER (toxic = 1) AS r
                   FROM {VOTES_SQL} GROUP BY 1)
        SELECT case_id, 'judge' AS metric, round(coalesce(m, 0), 6) AS value, coalesce(m >= 0.9, false) AS passed,
               CASE WHEN m IS NULL THEN 'all samples parse-failed' ELSE coalesce(r, '(no reason given)') END AS detail
        FROM {CASES_SQL} LEFT JOIN g USING (case_id) WHERE m IS NULL OR expected IS NOT NULL""",
)
def _(spark, d):
    cases = vote_cases(spark, d).select(
        "case_id", F.when(F.col("expected").isNotNull(), "rubric").otherwise("").alias("reference")
    )
    graded = votes(spark, d).select(
        "case_id",
        F.col("doc_id").alias("sample_no"),
        (1 - F.col("toxic") * 0.5).alias("score"),
        F.when(F.col("toxic") == 1, F.concat(F.lit("doc "), F.col("doc_id").cast("string"))).alias("reason"),
    )
    out = E.judge_rollup(cases, graded, "judge", threshold=0.9)
    return out.withColumn("value", B.rounded("value"))


@query(
    "eval_report",
    f"""WITH s AS (SELECT case_id, count(*) AS n_samples, count(*) FILTER (quality = 0 AND toxic = 1) AS parse_failures,
                          CAST(sum(n_chars) AS BIGINT) AS total_tokens, round(avg(n_chars), 6) AS mean_latency_ms
                   FROM {VOTES_SQL} JOIN documents USING (doc_id) GROUP BY 1)
        SELECT case_id, coalesce(n_samples, 0) AS n_samples, coalesce(parse_failures, 0) AS parse_failures,
               coalesce(total_tokens, 0) AS total_tokens, mean_latency_ms,
               CAST(coalesce(b.passed, false) AS BIGINT) AS n_passed,
               CAST(coalesce(NOT b.passed, false) AS BIGINT) AS n_failed
        FROM {CASES_SQL} LEFT JOIN s USING (case_id) LEFT JOIN {BOOLEAN_SQL} b USING (case_id)""",
)
def _(spark, d):
    samples = votes(spark, d).join(
        table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id"
    ).select(
        "case_id",
        F.when(~((F.col("quality") == 0) & (F.col("toxic") == 1)), "ok").alias("output"),
        F.col("n_chars").alias("total_tokens"),
        F.col("n_chars").alias("latency_ms"),
    )
    out = E.eval_report(vote_cases(spark, d), samples, boolean_scores(spark, d))
    return out.withColumn("mean_latency_ms", B.rounded("mean_latency_ms"))


@query(
    "feedback_coverage",
    """WITH f AS (SELECT doc_id, 'quality' AS key FROM labels WHERE quality = 1
                  UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1)
       SELECT key, count(*) AS n_feedback, (SELECT count(DISTINCT doc_id) FROM documents) AS n_runs,
              (SELECT count(DISTINCT doc_id) FROM f) AS runs_with_feedback FROM f GROUP BY key""",
)
def _(spark, d):
    runs = table(spark, d, "documents").select(F.col("doc_id").alias("run_id"))
    marks = table(spark, d, "labels").select(
        F.col("doc_id").alias("run_id"),
        F.explode(
            F.array_compact(
                F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic"))
            )
        ).alias("key"),
    )
    return E.feedback_coverage(runs, marks)


ALL_PEOPLE_SQL = people_sql(PAIRS_SQL, 25)
CALIBRATION_SQL = f"""(
  SELECT p.query_id, max(score) AS genuine, max(score) FILTER (individual_id <> label) AS impostor
  FROM {ALL_PEOPLE_SQL} p JOIN embeddings ON vec_id = p.query_id GROUP BY 1)"""
POPULATIONS_SQL = f"""(
  SELECT 'genuine' AS population, genuine AS score FROM {CALIBRATION_SQL}
  UNION ALL SELECT 'impostor', impostor FROM {CALIBRATION_SQL} WHERE impostor IS NOT NULL)"""


def calibration(spark, d):
    ranked = S.nearest(
        B.image_queries(spark, d), B.images(spark, d), E.CALIBRATION_K, by="individual", hide="image",
        block_rows=1024,
    )
    truth = B.image_queries(spark, d).select("query_id", "true_id")
    return stored(E.calibration_scores(ranked, truth), "calibration")


def calibrated(spark, d):
    return E.populations(calibration(spark, d))


@query(
    "calibration_scores",
    f"SELECT query_id, round(genuine, 6) AS genuine, round(impostor, 6) AS impostor FROM {CALIBRATION_SQL}",
)
def _(spark, d):
    return calibration(spark, d).withColumns({c: B.rounded(c) for c in ("genuine", "impostor")})


_RANK = "list_sort(list(score))[CAST(round_even({p} * (count(*) - 1), 0) AS BIGINT) + 1]"


@query(
    "score_distribution",
    f"""SELECT population, count(*) AS n, round(min(score), 6) AS min, round({_RANK.format(p='0.1::DOUBLE')}, 6) AS p10,
               round(quantile_cont(score, 0.5), 6) AS median, round(avg(score), 6) AS mean,
               round({_RANK.format(p='0.9::DOUBLE')}, 6) AS p90, round(max(score), 6) AS max
        FROM {POPULATIONS_SQL} GROUP BY population""",
)
def _(spark, d):
    out = E.score_distribution(calibrated(spark, d))
    return out.withColumns({c: B.rounded(c) for c in ("min", "p10", "median", "mean", "p90", "max")})


ROC_SQL = f"""(
  WITH s AS (SELECT score AS tau, count(*) FILTER (population = 'genuine') AS g,
                    count(*) FILTER (population = 'impostor') AS i FROM {POPULATIONS_SQL} GROUP BY 1),
  r AS (SELECT tau, CAST(sum(g) OVER w AS BIGINT) AS kept_genuine, CAST(sum(i) OVER w AS BIGINT) AS kept_impostor,
               sum(g) OVER () AS ng, sum(i) OVER () AS ni FROM s WINDOW w AS (ORDER BY tau DESC))
  SELECT tau, kept_genuine, kept_impostor, kept_genuine / ng AS tpr, kept_impostor / ni AS fpr,
         (kept_genuine + ni - kept_impostor) / (ng + ni) AS accuracy,
         (kept_genuine / ng + 1 - kept_impostor / ni) / 2 AS balanced_accuracy FROM r)"""
_RATES = ("tpr", "fpr", "accuracy", "balanced_accuracy")
_ROUND_RATES = ", ".join(f"round({c}, 6) AS {c}" for c in _RATES)


@query("roc_sweep", f"SELECT round(tau, 9) AS tau, kept_genuine, kept_impostor, {_ROUND_RATES} FROM {ROC_SQL}")
def _(spark, d):
    out = E.roc_sweep(calibrated(spark, d)).withColumn("tau", F.round("tau", 9))
    return out.withColumns({c: B.rounded(c) for c in _RATES})


@query(
    "youden_threshold",
    f"""SELECT round(tau, 6) AS tau, round(tpr - fpr, 6) AS youden_j, {_ROUND_RATES} FROM {ROC_SQL} AS r
        ORDER BY r.tpr - r.fpr DESC, r.tau LIMIT 1""",
)
def _(spark, d):
    out = E.youden_threshold(E.roc_sweep(calibrated(spark, d)))
    return out.withColumns({c: B.rounded(c) for c in ("tau", "youden_j", *_RATES)})


GRID_TAUS = tuple(round(0.30 + 0.05 * i, 2) for i in range(10))


@query(
    "grid_sweep",
    f"""SELECT t.tau, round(count(*) FILTER (population = 'genuine' AND score >= t.tau)
                            / count(*) FILTER (population = 'genuine'), 6) AS tpr,
               round(count(*) FILTER (population = 'impostor' AND score >= t.tau)
                     / count(*) FILTER (population = 'impostor'), 6) AS fpr,
               round((count(*) FILTER (population = 'genuine' AND score >= t.tau)
                      + count(*) FILTER (population = 'impostor' AND score < t.tau)) / count(*), 6) AS accuracy
        FROM {POPULATIONS_SQL} CROSS JOIN (SELECT unnest({list(GRID_TAUS)}::DOUBLE[]) AS tau) t GROUP BY t.tau""",
)
def _(spark, d):
    out = E.grid_sweep(calibrated(spark, d), list(GRID_TAUS))
    return out.withColumns({c: B.rounded(c) for c in ("tpr", "fpr", "accuracy")})


# events as agent traces: one trace per user and day, tools are the event types
TRACE_SQL = """(
  SELECT user_id AS case_id, CAST(dayofyear(ts) AS BIGINT) AS trace_no, event_id AS step_no, event_type AS tool,
         CAST(json_extract_string(props, '$.k') AS INT) > 95 AS abstain FROM events)"""
TRAJECTORY_SQL = f"""(
  WITH s AS (SELECT * FROM {TRACE_SQL}),
  t AS (SELECT case_id, trace_no, list_sort(list(DISTINCT tool)) AS tools, count(*) AS hops, bool_or(abstain) AS abstained,
               min(step_no) FILTER (tool = 'view') AS v, max(step_no) FILTER (tool = 'click') AS c FROM s GROUP BY ALL)
  SELECT case_id, trace_no, len(list_intersect(['view', 'click'], tools)) / 2::DOUBLE AS tool_recall,
         1 - CAST(list_contains(tools, 'error') AS INT) / len(tools)::DOUBLE AS tool_precision,
         hops <= 40 AS within_hops, coalesce(v < c, false) AS dependency_ok,
         case_id % 10 <> 0 OR abstained AS recovery_ok,
         len(list_intersect(['view', 'click'], tools)) = 2 AND coalesce(v < c, false)
           AND (case_id % 10 <> 0 OR abstained) AS gate,
         array_to_string(tools, '>') AS path FROM t)"""


def trajectories(spark, d):
    events = table(spark, d, "events")
    steps = events.select(
        F.col("user_id").alias("case_id"), F.dayofyear("ts").cast("long").alias("trace_no"),
        F.col("event_id").alias("step_no"), F.col("event_type").alias("tool"),
        (F.get_json_object("props", "$.k").cast("int") > 95).alias("abstain"),
    )
    pair = F.struct(F.lit("view").alias("earlier"), F.lit("click").alias("later"))
    cases = steps.select("case_id").distinct()
    specs = cases.select(
        "case_id",
        F.array(F.lit("view"), F.lit("click")).alias("required"),
        F.array(F.lit("error")).alias("forbidden"),
        F.lit(40).alias("max_hops"),
        F.array(pair).alias("dependency"),
        (F.col("case_id") % 10 == 0).alias("expect_abstain"),
    )
    traces = steps.select("case_id", "trace_no").distinct().withColumn("resolved", F.lit("NOVEL"))
    return E.trajectory_score(specs, steps, traces)


@query("trajectory_score", f"SELECT * REPLACE (round(tool_precision, 6) AS tool_precision) FROM {TRAJECTORY_SQL}")
def _(spark, d):
    return trajectories(spark, d).withColumn("tool_precision", B.rounded("tool_precision"))


@query(
    "trajectory_rates",
    f"""WITH p AS (SELECT case_id, path, count(*) AS n FROM {TRAJECTORY_SQL} GROUP BY ALL),
        m AS (SELECT case_id, max(n) / sum(n) AS c FROM p GROUP BY 1)
        SELECT case_id, count(*) AS repeats, round(avg(CAST(gate AS INT)), 6) AS gate_rate,
               round(avg(tool_recall), 6) AS mean_tool_recall, round(any_value(c), 6) AS path_consistency
        FROM {TRAJECTORY_SQL} JOIN m USING (case_id) GROUP BY case_id""",
)
def _(spark, d):
    out = E.trajectory_rates(trajectories(spark, d))
    return out.withColumns({c: B.rounded(c) for c in ("gate_rate", "mean_tool_recall", "path_consistency")})


HALF_SCORES_SQL = scores_sql(people_sql(HALF_PAIRS_SQL, 5))
FULL_SCORES_SQL = scores_sql(people_sql(PAIRS_SQL, 5))


@query(
    "version_ab",
    f"""WITH a AS (SELECT metric, avg(value) AS v FROM {HALF_SCORES_SQL} GROUP BY 1),
        b AS (SELECT metric, avg(value) AS v FROM {FULL_SCORES_SQL} GROUP BY 1)
        SELECT metric, round(a.v, 6) AS base_mean, round(b.v, 6) AS other_mean, round(b.v - a.v, 6) AS lift
        FROM a JOIN b USING (metric)""",
)
def _(spark, d):
    """Half vectors as the old version against whole vectors as the new one."""
    parts = []
    for version, cut in (("v1", F.slice("embedding", 1, 32)), ("v2", F.col("embedding"))):
        ranked = S.nearest(
            B.image_queries(spark, d).withColumn("embedding", cut),
            B.images(spark, d).withColumn("embedding", cut),
            5, by="individual", hide="image", block_rows=1024,
        )
        parts.append(reid_scores(spark, d, ranked).withColumn("embedder_ver", F.lit(version)))
    out = E.version_ab(parts[0].unionByName(parts[1]), "v1", "v2")
    return out.withColumns({c: B.rounded(c) for c in ("base_mean", "other_mean", "lift")})
