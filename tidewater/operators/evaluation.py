"""Scores per case and their roll-ups: ranking, votes, tolerance, calibration."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewater.functions.ordered import quantiles, running_sum
from tidewater.functions.text import path_suffix_match

# fixed values: individuals per answer used for calibration, cells of a score histogram
CALIBRATION_K = 25
SCORE_STEP = 0.001


def span_hit(anchor: str, chunk: str) -> Column:
    """Whether a returned span answers an anchor (aliases of the two sides).

    The path must match by suffix, and then: the same symbol, overlapping lines,
    or an anchor that names neither.
    """
    a = lambda c: F.col(f"{anchor}.{c}")
    c = lambda c: F.col(f"{chunk}.{c}")
    symbol = a("symbol").isNotNull() & F.coalesce(a("symbol") == c("symbol"), F.lit(False))
    ranges = (
        a("start").isNotNull()
        & F.coalesce((a("start") <= c("end")) & (c("start") <= a("end")), F.lit(False))
    )
    whole_file = a("symbol").isNull() & a("start").isNull()
    return path_suffix_match(a("path"), c("path")) & (symbol | ranges | whole_file)


def _score(name: str, value: Column, passed: Column) -> Column:
    return F.struct(
        F.lit(name).alias("metric"),
        value.cast("double").alias("value"),
        passed.cast("boolean").alias("passed"),
    )


def retrieval_ranking(
    cases: DataFrame,
    anchors: DataFrame,
    samples: DataFrame,
    returned: DataFrame,
    name: str,
    k: int = 5,
    recall_threshold: float = 1.0,
    hit: Column | None = None,
) -> DataFrame:
    """Recall@k (gated), precision@k over the rows returned, and MRR within k, per case.

    cases: ``case_id``; anchors: ``case_id, anchor_no, must`` and the span
    columns; samples: ``case_id, sample_no``; returned: ``case_id, sample_no,
    rank`` and the span columns. A case without anchors has no score, a case
    without samples only a recall of 0.
    """
    top = returned.where(F.col("rank") <= k)
    sizes = top.groupBy("case_id", "sample_no").agg(F.count(F.lit(1)).alias("n_top"))
    on = (F.col("a.case_id") == F.col("c.case_id")) & (
        span_hit("a", "c") if hit is None else hit
    )
    hits = anchors.alias("a").join(top.alias("c"), on).select(
        "c.case_id", "c.sample_no", "c.rank", "a.anchor_no", "a.must"
    )
    found = hits.groupBy("case_id", "sample_no").agg(
        F.count_distinct("rank").alias("n_hits"),
        F.count_distinct(F.when(F.col("must"), F.col("anchor_no"))).alias("covered"),
        F.min("rank").alias("first"),
    )
    needed = anchors.groupBy("case_id").agg(F.sum(F.col("must").cast("long")).alias("n_must"))
    per_sample = (
        samples.join(needed, "case_id")
        .join(sizes, ["case_id", "sample_no"], "left")
        .join(found, ["case_id", "sample_no"], "left")
        .select(
            "case_id",
            F.coalesce(F.col("n_hits") / F.col("n_top"), F.lit(0.0)).alias("precision"),
            F.when(
                F.col("n_must") > 0, F.coalesce("covered", F.lit(0)) / F.col("n_must")
            ).otherwise(0.0).alias("recall"),
            F.coalesce(F.lit(1.0).cast("double") / F.col("first"), F.lit(0.0)).alias("rr"),
        )
    )
    means = per_sample.groupBy("case_id").agg(
        F.avg("recall").alias("recall"), F.avg("precision").alias("precision"), F.avg("rr").alias("rr")
    )
    scored = cases.join(needed, "case_id", "left_semi").join(means, "case_id", "left")
    none = F.lit(None)
    rows = F.when(
        F.col("recall").isNull(), F.array(_score(name, F.lit(0.0), F.lit(False)))
    ).otherwise(
        F.array(
            _score(name, F.col("recall"), F.col("recall") >= recall_threshold),
            _score(f"{name}_precision@{k}", F.col("precision"), none),
            _score(f"{name}_mrr", F.col("rr"), none),
        )
    )
    return scored.select("case_id", F.explode(rows).alias("s")).select("case_id", "s.*")


def reid_scores(
    cases: DataFrame, ranked: DataFrame, name: str, k: int, recall_threshold: float = 1.0
) -> DataFrame:
    """Ranking scores of identifications: one anchor per case, equal ids.

    cases: ``case_id, query_id, true_id``; ranked: ``query_id, individual_id, rank``.
    """
    anchors = cases.select(
        "case_id", F.lit(0).alias("anchor_no"), F.lit(True).alias("must"), "true_id"
    )
    keyed = cases.select("case_id", "query_id").join(
        ranked.select("query_id", "individual_id", "rank"), "query_id"
    )
    returned = keyed.withColumn("sample_no", F.lit(0))
    samples = cases.select("case_id", F.lit(0).alias("sample_no"))
    return retrieval_ranking(
        cases.select("case_id"), anchors, samples, returned, name, k, recall_threshold,
        hit=F.col("a.true_id") == F.col("c.individual_id"),
    )


def boolean_vote(cases: DataFrame, samples: DataFrame, name: str) -> DataFrame:
    """Strict majority of the samples against the expected flag.

    cases: ``case_id, expected``; samples: ``case_id, flag``. No expectation
    gives no score; no samples give a failed 0.
    """
    votes = samples.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col("flag").cast("int")).alias("_t")
    )
    joined = cases.join(votes, "case_id", "left").where(
        F.col("_n").isNull() | F.col("expected").isNotNull()
    )
    ok = F.col("_n").isNotNull() & ((F.coalesce("_t", F.lit(0)) * 2 > F.col("_n")) == F.col("expected"))
    ok = F.coalesce(ok, F.lit(False))
    return joined.select("case_id", F.lit(name).alias("metric"), ok.cast("double").alias("value"), ok.alias("passed"))


def numeric_tolerance(cases: DataFrame, samples: DataFrame, name: str, tolerance: float) -> DataFrame:
    """Mean of the samples within a tolerance, and the absolute error.

    cases: ``case_id, expected``; samples: ``case_id, number``.
    """
    means = samples.groupBy("case_id").agg(F.avg("number").alias("_m"))
    joined = cases.join(means, "case_id", "left").withColumn(
        "_e", F.abs(F.col("_m") - F.col("expected"))
    )
    ok = F.col("_e") <= tolerance
    rows = F.when(F.col("_m").isNull(), F.array(_score(name, F.lit(0.0), F.lit(False)))).otherwise(
        F.array(
            _score(name, ok.cast("double"), ok),
            _score(f"{name}_mae", F.col("_e"), F.lit(None)),
        )
    )
    return joined.select("case_id", F.explode(rows).alias("s")).select("case_id", "s.*")


MOST_SPACES = 64  # samples before a text that a required word can reach into
_MASK_BITS = 62


@lru_cache(maxsize=4096)
def _automaton(words: tuple[str, ...]) -> ahocorasick.Automaton:
    """All words at once, each with its place in the list."""
    out = ahocorasick.Automaton()
    for i, word in enumerate(words):
        if word:
            out.add_word(word, (*out.get(word, ()), i))
    if len(out):
        out.make_automaton()
    return out


def _found_masks(rows: DataFrame) -> DataFrame:
    """``case_id, block, mask``: bits of the words of ``required`` that each ``text`` holds."""
    schema = StructType([rows.schema["case_id"]]).add("block", "integer").add("mask", "long")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, blocks, masks = [], [], []
            for i, (required, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                words = tuple(w if w is not None else "\0" for w in required)
                automaton = _automaton(words)
                found: set[int] = set()
                for _, places in automaton.iter(text) if len(automaton) else ():
                    found.update(places)
                held: dict[int, int] = {}
                for place in found:
                    held[place // _MASK_BITS] = held.get(place // _MASK_BITS, 0) | 1 << place % _MASK_BITS
                row += [i] * len(held)
                blocks += held
                masks += held.values()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(blocks, pa.int32()), pa.array(masks, pa.int64())],
                ["case_id", "block", "mask"],
            )

    return rows.select("case_id", "required", "text").mapInArrow(search, schema)


def keyword_presence(cases: DataFrame, samples: DataFrame, name: str) -> DataFrame:
    """Share of the required words found in the joined sample texts of a case.

    cases: ``case_id, required ARRAY<STRING>``; samples: ``case_id, sample_no,
    text`` (the repeats of one case). Nothing required or no samples: 0, no gate.

    Texts are never joined: each is searched for all words of its case in one pass, and
    the bits of what was found are merged. A word with spaces can begin in the samples
    before, one more for each space (``MOST_SPACES`` at most, else an error), so their
    ends stand in front of the text.
    """
    wanted = cases.select(
        "case_id", F.transform(F.coalesce("required", F.array().cast("array<string>")), lambda w: F.lower(w)).alias("required")
    )
    long = F.coalesce(F.array_max(F.transform("required", lambda w: F.length(w))), F.lit(0))
    spaces = F.array_max(F.transform("required", lambda w: F.length(w) - F.length(F.replace(w, F.lit(" "), F.lit("")))))
    checked = F.when(spaces > MOST_SPACES, F.raise_error(F.lit("a required word has too many spaces")).cast("int")).otherwise(spaces)
    asked = wanted.where(F.size("required") > 0).withColumns({"_long": long, "_spaces": F.coalesce(checked, F.lit(0))})
    texts = samples.where("text is not null").select("case_id", "sample_no", F.lower("text").alias("text")).join(asked, "case_id")
    # the start of a text that was cut is marked, so that nothing seems to follow the sample before it
    cut = F.when(F.length("text") > F.col("_long"), F.concat(F.lit("\0"), F.right("text", F.col("_long")))).otherwise(F.col("text"))
    before = Window.partitionBy("case_id").orderBy("sample_no", "text").rowsBetween(-MOST_SPACES, -1)
    ends = F.when(F.col("_spaces") > 0, F.array_join(F.collect_list(cut).over(before), " "))
    reach = F.when(F.row_number().over(Window.partitionBy("case_id").orderBy("sample_no", "text")) > 1, F.concat(ends, F.lit(" "), "text"))
    found = _found_masks(texts.withColumn("text", F.coalesce(reach, F.col("text"))).select("case_id", "required", "text"))
    merged = found.groupBy("case_id", "block").agg(F.bit_or("mask").alias("mask"))
    hits = merged.groupBy("case_id").agg(F.sum(F.bit_count("mask")).alias("_hits"))
    sampled = samples.groupBy("case_id").agg(F.lit(True).alias("_sampled"))
    joined = cases.join(sampled, "case_id", "left").join(hits, "case_id", "left")
    n = F.size(F.coalesce("required", F.array().cast("array<string>")))
    always = F.size(F.filter(F.coalesce("required", F.array().cast("array<string>")), lambda w: w == ""))
    scored, share = (n > 0) & F.col("_sampled"), F.coalesce("_hits", F.lit(0)) + always
    return joined.select(
        "case_id",
        F.lit(name).alias("metric"),
        F.when(scored, share / n).otherwise(0.0).alias("value"),
        F.when(scored, share == n).alias("passed"),
    )


def judge_rollup(cases: DataFrame, graded: DataFrame, name: str, threshold: float = 0.7) -> DataFrame:
    """Mean of given scores against a threshold, with the reasons of the repeats.

    cases: ``case_id, reference``; graded: ``case_id, sample_no, score, reason``.
    """
    reason = F.when(F.length("reason") > 0, F.struct("sample_no", "reason"))
    rolled = graded.groupBy("case_id").agg(
        F.avg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))).alias("_m"),
        F.array_sort(F.collect_list(reason)).alias("_r"),
    )
    joined = cases.join(rolled, "case_id", "left").where(
        F.col("_m").isNull() | (F.length("reference") > 0)
    )
    reasons = F.array_join(F.transform("_r", lambda r: r["reason"]), " | ")
    text = F.when(F.size("_r") > 0, reasons).otherwise("(no reason given)")
    failed = F.col("_m").isNull()
    return joined.select(
        "case_id",
        F.lit(name).alias("metric"),
        F.coalesce("_m", F.lit(0.0)).alias("value"),
        F.when(failed, F.lit(False)).otherwise(F.col("_m") >= threshold).alias("passed"),
        F.when(failed, "all samples parse-failed").otherwise(text).alias("detail"),
    )


def eval_report(cases: DataFrame, samples: DataFrame, scores: DataFrame) -> DataFrame:
    """Per case: samples, parse failures, tokens, latency, scores passed and failed."""
    runs = samples.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.sum(F.col("output").isNull().cast("long")).alias("parse_failures"),
        F.sum("total_tokens").alias("total_tokens"),
        F.avg("latency_ms").alias("mean_latency_ms"),
    )
    gates = scores.groupBy("case_id").agg(
        F.sum(F.when(F.col("passed"), 1).otherwise(0)).alias("n_passed"),
        F.sum(F.when(~F.col("passed"), 1).otherwise(0)).alias("n_failed"),
    )
    return cases.select("case_id").join(runs, "case_id", "left").join(gates, "case_id", "left").select(
        "case_id",
        *[
            F.coalesce(c, F.lit(0)).cast("long").alias(c)
            for c in ("n_samples", "parse_failures", "total_tokens")
        ],
        "mean_latency_ms",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_passed", "n_failed")],
    )


def metric_means(scores: DataFrame) -> DataFrame:
    """Mean and count of every metric over the cases that have it."""
    return scores.groupBy("metric").agg(
        F.avg("value").alias("mean"),
        F.count(F.lit(1)).alias("n_cases"),
        F.sum(F.when(F.col("passed"), 1).otherwise(0)).cast("long").alias("n_passed"),
    )


def feedback_coverage(runs: DataFrame, feedback: DataFrame) -> DataFrame:
    """Per feedback key: its count, next to all runs and the runs with any feedback."""
    n_runs = runs.agg(F.count_distinct("run_id").alias("n")).scalar()
    covered = feedback.agg(F.count_distinct("run_id").alias("n")).scalar()
    return (
        feedback.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n_feedback"))
        .withColumn("n_runs", n_runs)
        .withColumn("runs_with_feedback", covered)
    )


def calibration_scores(ranked: DataFrame, truth: DataFrame, k: int = CALIBRATION_K) -> DataFrame:
    """Per case the best score, and the best score of any other individual within ``k``.

    ranked: ``query_id, individual_id, score, rank``; truth: ``query_id, true_id``.
    """
    other = F.when(F.col("individual_id") != F.col("true_id"), F.col("score"))
    return (
        ranked.where(F.col("rank") <= k)
        .join(truth, "query_id")
        .groupBy("query_id")
        .agg(F.max("score").alias("genuine"), F.max(other).alias("impostor"))
    )


def populations(calibration: DataFrame) -> DataFrame:
    """Calibration rows as ``population, score``."""
    both = F.expr("stack(2, 'genuine', genuine, 'impostor', impostor) as (population, score)")
    return calibration.select(both).where(F.col("score").isNotNull())


def score_distribution(scores: DataFrame, step: float = SCORE_STEP) -> DataFrame:
    """Count, minimum, p10, median, mean, p90 and maximum per population.

    p10 and p90 are nearest ranks with half-even rounding of the position.
    """
    at = lambda p: (lambda n: F.bround(F.lit(p) * (n - 1), 0))
    ranks = quantiles(
        scores, ["population"], F.col("score"), {"median": 0.5}, step, {"p10": at(0.1), "p90": at(0.9)}
    )
    base = scores.groupBy("population").agg(
        F.count("score").alias("n"),
        F.min("score").alias("min"),
        F.avg("score").alias("mean"),
        F.max("score").alias("max"),
    )
    return base.join(ranks, "population")


def roc_sweep(scores: DataFrame, step: float = SCORE_STEP) -> DataFrame:
    """True and false positive rate and accuracy at every observed score.

    Equal scores are counted first; the running counts from the top are cut at
    score cells, so the sweep is not one task.
    """
    flag = lambda p: F.sum(F.when(F.col("population") == p, 1).otherwise(0))
    per_score = scores.groupBy(F.col("score").alias("tau")).agg(
        flag("genuine").alias("_g"), flag("impostor").alias("_i")
    )
    totals = per_score.agg(F.sum("_g").alias("g"), F.sum("_i").alias("i"))
    cell = F.floor(F.col("tau") / step)
    order = [F.col("tau").desc()]
    up = running_sum(per_score, [], cell, order, F.col("_g"), "_tp", descending=True)
    up = running_sum(up, [], cell, order, F.col("_i"), "_fp", descending=True)
    n_g, n_i = totals.select("g").scalar(), totals.select("i").scalar()
    counted = up.withColumns({"_ng": n_g, "_ni": n_i})
    tpr, fpr = F.col("_tp") / F.col("_ng"), F.col("_fp") / F.col("_ni")
    return counted.select(
        "tau",
        F.col("_tp").alias("kept_genuine"),
        F.col("_fp").alias("kept_impostor"),
        tpr.alias("tpr"),
        fpr.alias("fpr"),
        ((F.col("_tp") + F.col("_ni") - F.col("_fp")) / (F.col("_ng") + F.col("_ni"))).alias("accuracy"),
        ((tpr + 1 - fpr) / 2).alias("balanced_accuracy"),
    )


def youden_threshold(sweep: DataFrame) -> DataFrame:
    """The threshold with the highest TPR - FPR, the lowest one on ties."""
    best = F.max(
        F.struct(
            (F.col("tpr") - F.col("fpr")).alias("j"), (-F.col("tau")).alias("neg"),
            "tpr", "fpr", "accuracy", "balanced_accuracy",
        )
    )
    return sweep.agg(best.alias("b")).select(
        (-F.col("b.neg")).alias("tau"),
        F.col("b.j").alias("youden_j"),
        "b.tpr", "b.fpr", "b.accuracy", "b.balanced_accuracy",
    )


def grid_sweep(scores: DataFrame, taus: list[float]) -> DataFrame:
    """Rates at given thresholds, in one pass over the scores."""
    up = lambda p: F.when(F.col("population") == p, F.col("score"))
    n_g, n_i = F.count(up("genuine")), F.count(up("impostor"))
    rows = []
    for tau in taus:
        tp = F.sum(F.when(up("genuine") >= tau, 1).otherwise(0))
        fp = F.sum(F.when(up("impostor") >= tau, 1).otherwise(0))
        rows.append(
            F.struct(
                F.lit(float(tau)).alias("tau"), (tp / n_g).alias("tpr"), (fp / n_i).alias("fpr"),
                ((tp + n_i - fp) / (n_g + n_i)).alias("accuracy"),
            )
        )
    return scores.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def trajectory_score(specs: DataFrame, steps: DataFrame, traces: DataFrame) -> DataFrame:
    """Per trace: tool recall (gate), precision, hop budget, dependency and recovery gates.

    specs: ``case_id, required, forbidden, max_hops, dependency, expect_abstain``
    where ``dependency`` is an array of ``struct<earlier, later>`` tool names;
    steps: ``case_id, trace_no, step_no, tool, abstain``; traces: ``case_id,
    trace_no, resolved``. Each tool contributes its first and last step only.
    """
    tools = steps.where(F.col("tool").isNotNull()).groupBy("case_id", "trace_no", "tool").agg(
        F.min("step_no").alias("first"), F.max("step_no").alias("last")
    )
    used = tools.groupBy("case_id", "trace_no").agg(
        F.map_from_entries(
            F.collect_list(F.struct("tool", F.struct("first", "last")))
        ).alias("_used")
    )
    flags = steps.groupBy("case_id", "trace_no").agg(
        F.count("tool").alias("hops"),
        F.bool_or(F.coalesce("abstain", F.lit(False))).alias("abstained"),
    )
    path = lambda d: F.try_element_at("_used", d)
    joined = (
        traces.join(specs, "case_id")
        .join(flags, ["case_id", "trace_no"], "left")
        .join(used, ["case_id", "trace_no"], "left")
        .withColumn("_tools", F.coalesce(F.map_keys("_used"), F.array().cast("array<string>")))
    )
    hit = F.size(F.array_intersect("required", "_tools"))
    recall = F.when(F.size("required") > 0, hit / F.size("required")).otherwise(1.0)
    bad = F.size(F.array_intersect("forbidden", "_tools"))
    precision = F.when(F.size("_tools") > 0, 1 - bad / F.size("_tools")).otherwise(1.0)
    ordered = F.forall(
        "dependency",
        lambda d: F.coalesce(
            path(d["earlier"])["first"] < path(d["later"])["last"], F.lit(False)
        ),
    )
    recovered = ~F.col("expect_abstain") | (
        F.coalesce("abstained", F.lit(False)) & (F.col("resolved") == "NOVEL")
    )
    within = F.col("max_hops").isNull() | (F.coalesce("hops", F.lit(0)) <= F.col("max_hops"))
    return joined.select(
        "case_id",
        "trace_no",
        recall.alias("tool_recall"),
        precision.alias("tool_precision"),
        within.alias("within_hops"),
        ordered.alias("dependency_ok"),
        recovered.alias("recovery_ok"),
        ((recall == 1.0) & ordered & recovered).alias("gate"),
        F.array_join(F.array_sort("_tools"), ">").alias("path"),
    )


def trajectory_rates(scores: DataFrame) -> DataFrame:
    """Gate rates over the repeats of a case, and how often its most common path occurs."""
    paths = scores.groupBy("case_id", "path").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.col("gate").cast("long")).alias("_g"),
        F.sum("tool_recall").alias("_r"),
    )
    return paths.groupBy("case_id").agg(
        F.sum("_n").alias("repeats"),
        (F.sum("_g") / F.sum("_n")).alias("gate_rate"),
        (F.sum("_r") / F.sum("_n")).alias("mean_tool_recall"),
        (F.max("_n") / F.sum("_n")).alias("path_consistency"),
    )


def version_ab(scores: DataFrame, base: str, other: str) -> DataFrame:
    """Mean of each metric under two embedding versions and the lift."""
    mean = lambda v: F.avg(F.when(F.col("embedder_ver") == v, F.col("value")))
    return (
        scores.groupBy("metric")
        .agg(mean(base).alias("base_mean"), mean(other).alias("other_mean"))
        .withColumn("lift", F.col("other_mean") - F.col("base_mean"))
    )
