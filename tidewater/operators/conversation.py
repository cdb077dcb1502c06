"""Message logs: budgeted slices, summaries, tool briefs and budget-fitted views.

Messages are rows ``conv_id, turn, msg_id, role, content, tool_calls,
tool_call_id`` with ``turn`` rising per conversation. One conversation may hold a
large share of the log: ordered work is cut into ranges of turns.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.ordered import ordinal, running_sum
from tidewater.functions.text import token_estimate
from tidewater.session import stored

HUMAN = ("human", "user")
ASSISTANT = ("ai", "assistant")
TOOL = "tool"

# fixed values: frames around summaries and the list of tool calls
SUMMARY_FRAME = "[Summary of earlier conversation]:\n"
MANIFEST_FRAME = "[Tools already called this session]\n"

TURN_BLOCK = 65_536  # turns of one conversation that meet in one task
GROUP_ROWS = 50_000  # rows of short conversations handed to one Python call


def prose_flag(messages: DataFrame) -> Column:
    """False for tool results and for assistant rows that call tools."""
    role = F.col("role")
    if "tool_calls" not in messages.columns:
        return role != TOOL
    calls = role.isin(*ASSISTANT) & (F.coalesce(F.size("tool_calls"), F.lit(0)) > 0)
    return (role != TOOL) & ~calls


def with_tokens(messages: DataFrame, counter: Callable[[Column, Column], Column] = token_estimate) -> DataFrame:
    """Prose flag and token count; the counter takes role and content."""
    return messages.withColumns(
        {"is_prose": prose_flag(messages), "tokens": counter(F.col("role"), F.col("content"))}
    )


def after_bookmark(messages: DataFrame, bookmarks: DataFrame | None) -> DataFrame:
    """Messages after the bookmark of their conversation; an unknown bookmark is an error."""
    if bookmarks is None:
        return messages
    set_marks = bookmarks.where(F.col("bookmark_id").isNotNull())
    where = messages.select("conv_id", F.col("msg_id").alias("bookmark_id"), F.col("turn").alias("_at"))
    missing = F.raise_error(F.concat(F.lit("bookmark not found: "), F.col("bookmark_id")))
    marks = set_marks.join(where, ["conv_id", "bookmark_id"], "left").select(
        "conv_id", F.when(F.col("_at").isNotNull(), F.col("_at")).otherwise(missing).alias("_mark")
    )
    kept = messages.join(marks, "conv_id", "left")
    return kept.where(F.col("_mark").isNull() | (F.col("turn") > F.col("_mark"))).drop("_mark")


def before_fence(messages: DataFrame, live_tail: int) -> DataFrame:
    """Messages outside the last ``live_tail`` of their conversation."""
    if live_tail <= 0:
        return messages
    newest = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    fence = (
        messages.select("conv_id", "turn")
        .withColumn("_r", F.row_number().over(newest))
        .where(F.col("_r") <= live_tail)
        .groupBy("conv_id")
        .agg(F.min("turn").alias("_fence"))
    )
    return messages.join(fence, "conv_id").where("turn < _fence").drop("_fence")


def _cuts(tokens: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Prefix sums, and for a cut at each row: the next cut, the last cut, the number of cuts."""
    prefix = np.cumsum(tokens)
    following = np.searchsorted(prefix, prefix + budget, side="left")
    rows = len(tokens)
    last, count = np.arange(rows), np.ones(rows, dtype=np.int64)
    for i in range(rows - 1, -1, -1):
        if following[i] < rows:
            last[i], count[i] = last[following[i]], count[following[i]] + 1
    return prefix, following, last, count


def _carry_runs(pdf: pd.DataFrame, budget: int) -> pd.DataFrame:
    """What a block does to the tokens carried into it, as a step function.

    For every carried amount the block gives the amount carried out and the
    number of cuts. Starts merge quickly, so few steps are left.
    """
    out = []
    for (conv, block), rows in pdf.groupby(["conv_id", "blk"], sort=False):
        tokens = rows.sort_values("turn")["tokens"].to_numpy(np.int64)
        prefix, _, last, count = _cuts(tokens, budget)
        carried = np.arange(budget)
        first = np.searchsorted(prefix, budget - carried, side="left")
        cut = first < len(tokens)
        at = np.where(cut, first, 0)
        rest = np.where(cut, prefix[-1] - prefix[last[at]], prefix[-1])
        cuts = np.where(cut, count[at], 0)
        start = np.flatnonzero(
            np.r_[True, (rest[1:] != rest[:-1]) | (cuts[1:] != cuts[:-1]) | (cut[1:] != cut[:-1])]
        )
        out.append(
            {
                "conv_id": conv,
                "blk": block,
                "from_carry": start.tolist(),
                "rest": rest[start].tolist(),
                "cuts": cuts[start].tolist(),
                "is_cut": cut[start].tolist(),
            }
        )
    return pd.DataFrame(out, columns=["conv_id", "blk", "from_carry", "rest", "cuts", "is_cut"])


def _chain_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Carry and cut count at the start of every block of one conversation."""
    carry, total, out = 0, 0, []
    for row in pdf.sort_values("blk").itertuples():
        out.append((row.conv_id, row.blk, carry, total))
        step = int(np.searchsorted(np.asarray(row.from_carry), carry, side="right")) - 1
        total += int(row.cuts[step])
        carry = int(row.rest[step]) + (0 if row.is_cut[step] else carry)
    return pd.DataFrame(out, columns=["conv_id", "blk", "carry", "cuts_before"])


def _assign(pdf: pd.DataFrame, budget: int) -> pd.DataFrame:
    """Segment number of every row, given what is carried into its block."""
    pdf = pdf.sort_values(["conv_id", "turn"], kind="stable")
    tokens = pdf["tokens"].to_numpy(np.int64)
    bounds = np.flatnonzero(np.r_[True, pdf["conv_id"].to_numpy()[1:] != pdf["conv_id"].to_numpy()[:-1]])
    carry = pdf["carry"].to_numpy(np.int64)
    before = pdf["cuts_before"].to_numpy(np.int64)
    segment = np.empty(len(pdf), dtype=np.int64)
    for a, b in zip(bounds, np.r_[bounds[1:], len(pdf)]):
        held, number = carry[a], before[a]
        for i in range(a, b):
            segment[i] = number
            held += tokens[i]
            if held >= budget:
                held, number = 0, number + 1
    return pd.DataFrame(
        {
            "conv_id": pdf["conv_id"].to_numpy(),
            "turn": pdf["turn"].to_numpy(),
            "tokens": tokens,
            "segment": segment,
        }
    )


def segment_numbers(
    messages: DataFrame, budget: int, live_tail: int, bookmarks: DataFrame | None = None,
    block: int = TURN_BLOCK,
) -> DataFrame:
    """``conv_id, turn, tokens, segment`` of every message in a closed slice.

    A slice starts after the bookmark or the last slice and closes with the
    prose message that brings it to ``budget`` tokens. Rows of a slice that does
    not fill up are left out. ``messages`` needs ``is_prose`` and ``tokens``.

    The cut resets the sum, so it depends on all earlier rows. Long
    conversations are cut into blocks of turns: each block is reduced to a small
    step function, the functions are chained, then every block is numbered on
    its own.
    """
    base = before_fence(after_bookmark(messages, bookmarks), live_tail).select(
        "conv_id",
        "turn",
        F.when(F.col("is_prose"), F.col("tokens")).otherwise(0).cast("long").alias("tokens"),
    )
    # long by rows, not by turn numbers, which may have gaps; few conversations are
    long_ones = (
        base.groupBy("conv_id")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > block)
        .select("conv_id", F.lit(True).alias("_long"))
    )
    eligible = base.join(long_ones, "conv_id", "left").withColumn(
        "blk", F.when(F.col("_long"), F.floor(F.col("turn") / block)).otherwise(F.lit(-1).cast("long"))
    )
    runs = (
        eligible.where("_long")
        .drop("_long")
        .groupBy("conv_id", "blk")
        .applyInPandas(
            lambda pdf: _carry_runs(pdf, budget),
            "conv_id long, blk long, from_carry array<long>, rest array<long>, "
            "cuts array<long>, is_cut array<boolean>",
        )
    )
    starts = runs.groupBy("conv_id").applyInPandas(
        _chain_blocks, "conv_id long, blk long, carry long, cuts_before long"
    )
    groups = messages.agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(GROUP_ROWS)), F.lit(1)).alias("n")
    ).scalar()
    placed = (
        eligible.drop("_long")
        .join(starts, ["conv_id", "blk"], "left")
        .na.fill(0, ["carry", "cuts_before"])
        .withColumn("_n", groups)
        .withColumn("_bucket", F.pmod(F.xxhash64("conv_id"), F.col("_n")))
        .drop("_n")
    )
    numbered = placed.groupBy("_bucket", "blk").applyInPandas(
        lambda pdf: _assign(pdf, budget), "conv_id long, turn long, tokens long, segment long"
    )
    whole = Window.partitionBy("conv_id", "segment")
    filled = numbered.withColumn("_t", F.sum("tokens").over(whole))
    return filled.where(F.col("_t") >= budget).drop("_t")


def prose_segments(
    messages: DataFrame, budget: int, live_tail: int, bookmarks: DataFrame | None = None,
    block: int = TURN_BLOCK,
) -> DataFrame:
    """One row per closed slice: its turns, message count and prose tokens."""
    return (
        segment_numbers(messages, budget, live_tail, bookmarks, block)
        .groupBy("conv_id", "segment")
        .agg(
            F.min("turn").alias("start_turn"),
            F.max("turn").alias("end_turn"),
            F.count(F.lit(1)).alias("n_messages"),
            F.sum("tokens").alias("prose_tokens"),
        )
    )


def sliced(messages: DataFrame, numbers: DataFrame) -> DataFrame:
    """Message rows with the number of their closed slice."""
    return messages.join(numbers.select("conv_id", "turn", "segment"), ["conv_id", "turn"])


def transcript_json(slice_rows: DataFrame) -> DataFrame:
    """Prose of each slice as a JSON array; a slice is bounded by its token budget."""
    item = F.struct(
        "turn",
        F.struct(
            F.col("msg_id").alias("message_id"), F.col("role").alias("type"), "content"
        ).alias("m"),
    )
    return (
        slice_rows.where("is_prose")
        .groupBy("conv_id", "segment")
        .agg(
            F.to_json(
                F.transform(F.array_sort(F.collect_list(item)), lambda i: i["m"])
            ).alias("transcript")
        )
    )


def first_lines(contents: Column) -> Column:
    """Extractive summary: the first line of every message."""
    return F.array_join(F.transform(contents, lambda c: F.substring_index(c, "\n", 1)), "\n")


def summary_rows(
    slice_rows: DataFrame,
    summarizer: Callable[[Column], Column] = first_lines,
    counter: Callable[[Column, Column], Column] = token_estimate,
) -> DataFrame:
    """One framed summary per slice; the summarizer maps the prose texts to a text."""
    texts = (
        slice_rows.where("is_prose")
        .groupBy("conv_id", "segment")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "content"))).alias("_rows"))
        .withColumn("_texts", F.transform("_rows", lambda r: r["content"]))
    )
    summary = texts.withColumn("_summary", summarizer(F.col("_texts")))
    return summary.select(
        "conv_id",
        "segment",
        F.concat_ws("-", F.lit("summary"), "conv_id", "segment").alias("msg_id"),
        F.lit("human").alias("role"),
        F.concat(F.lit(SUMMARY_FRAME), F.col("_summary")).alias("content"),
        counter(F.lit("human"), F.col("_summary")).alias("tokens"),
        F.current_timestamp().alias("created_at"),
    )


def _tool_halves(rows: DataFrame, max_chars: int, keys: list[str]) -> DataFrame:
    """Calls and results of the rows, one row each, in one pass."""
    none = F.lit(None).cast("string")

    def half(pos, id_, name, query, summary, is_call):
        return F.struct(
            pos.alias("pos"), id_.alias("id"), name.alias("name"), query.alias("query"),
            summary.alias("summary"), F.lit(is_call).alias("is_call"),
        )

    calls = F.transform(
        "tool_calls", lambda c, i: half(i, c["id"], c["name"], c["args"], none, True)
    )
    result = half(
        F.lit(0), F.col("tool_call_id"), none, none, F.left("content", F.lit(max_chars)), False
    )
    halves = F.when(F.col("role").isin(*ASSISTANT), calls).when(
        F.col("role") == TOOL, F.array(result)
    )
    listed = rows.select(*keys, "turn", F.explode_outer(halves).alias("h")).where("h is not null")
    return listed.select(*keys, "turn", "h.*")


def tool_briefs(slice_rows: DataFrame, max_chars: int, base: DataFrame | None = None) -> DataFrame:
    """One brief per tool call and slice: both halves merged, missing halves NULL.

    Both halves are one aggregation by call id; on repeats the later half wins.
    Ordinals run on without gaps over slices, from the stored count ``base``
    (``conv_id, n``); an id met in an earlier slice does not use up a number.
    """
    at = F.struct("turn", "pos")
    calls = F.when(F.col("is_call"), F.struct("turn", "pos", "name", "query"))
    results = F.when(~F.col("is_call"), F.struct("turn", "pos", "summary"))
    merged = (
        _tool_halves(slice_rows, max_chars, ["conv_id", "segment"])
        .groupBy("conv_id", "segment", "id")
        .agg(F.min(at).alias("_first"), F.max(calls).alias("_call"), F.max(results).alias("_result"))
        .select(
            "conv_id", "segment", "id", F.col("_first.turn").alias("_turn"),
            F.col("_first.pos").alias("_pos"), F.col("_call.name").alias("name"),
            F.col("_call.query").alias("query"), F.col("_result.summary").alias("summary"),
        )
    )
    local = ordinal(
        merged, ["conv_id", "segment"], F.floor(F.col("_turn") / 4096),
        [F.col("_turn"), F.col("_pos"), F.col("id")], "_local",
    )
    fresh = merged.groupBy("conv_id", "id").agg(F.min("segment").alias("segment"))
    added = fresh.groupBy("conv_id", "segment").agg(F.count(F.lit(1)).alias("_added"))
    segments = merged.select("conv_id", "segment").distinct().join(
        added, ["conv_id", "segment"], "left"
    ).na.fill(0, ["_added"])
    earlier = running_sum(
        segments, ["conv_id"], F.floor(F.col("segment") / 4096), [F.col("segment")],
        F.col("_added"), "_upto",
    ).select("conv_id", "segment", (F.col("_upto") - F.col("_added")).alias("_seen"))
    out = local.join(earlier, ["conv_id", "segment"])
    if base is not None:
        out = out.join(base.select("conv_id", F.col("n").alias("_base")), "conv_id", "left")
    else:
        out = out.withColumn("_base", F.lit(0))
    number = F.coalesce("_base", F.lit(0)) + F.col("_seen") + F.col("_local") - 1
    return out.select(
        "conv_id", "segment", "id", number.cast("long").alias("ordinal"), "name", "query", "summary"
    )


def merge_briefs(briefs: DataFrame) -> DataFrame:
    """State after all slices: per call id the brief of the latest slice wins."""
    last = F.max(F.struct("segment", "ordinal", "name", "query", "summary")).alias("b")
    return briefs.groupBy("conv_id", "id").agg(last).select(
        "conv_id", "id", "b.ordinal", "b.name", "b.query", "b.summary"
    )


def map_merge(existing: Column, incoming: Column) -> Column:
    """Merge two maps; the incoming value wins."""
    kept = F.map_filter(existing, lambda k, v: ~F.map_contains_key(incoming, k))
    return F.when(existing.isNull(), incoming).otherwise(F.map_concat(kept, incoming))


def orphan_tool_calls(messages: DataFrame) -> DataFrame:
    """Call ids without a result, and results without a call."""
    halves = _tool_halves(messages, 0, ["conv_id"])
    per = halves.groupBy("conv_id", "id").agg(
        F.bool_or("is_call").alias("has_call"), F.bool_or(~F.col("is_call")).alias("has_result")
    )
    return per.where(~(F.col("has_call") & F.col("has_result")))


def budget_fit(items: DataFrame, budgets: DataFrame, ord_col: str = "ord", cell: int = 4096) -> DataFrame:
    """The newest run of items per conversation that fits its budget.

    items: ``conv_id, <ord>, size`` with sizes of at least 0; budgets: ``conv_id,
    budget``. Walking from the newest item, the first that does not fit ends
    the run; for such sizes this is a running sum up to the budget.
    """
    summed = running_sum(
        items, ["conv_id"], F.floor(F.col(ord_col) / cell), [F.col(ord_col).desc()],
        F.col("size"), "used", descending=True,
    )
    return summed.join(budgets, "conv_id").where(F.col("used") <= F.col("budget"))


def left_over(budgets: DataFrame, kept: DataFrame) -> DataFrame:
    """Budget of every conversation minus the size of what was kept."""
    used = kept.groupBy("conv_id").agg(F.sum("size").alias("_u"))
    return budgets.join(used, "conv_id", "left").select(
        "conv_id", (F.col("budget") - F.coalesce("_u", F.lit(0))).alias("budget")
    )


def fit_tail(tail: DataFrame, budgets: DataFrame, cell: int = 4096) -> DataFrame:
    """Rows of the tail with ``kept`` and ``overflow``.

    The current turn, from the last human message on, always stays; if it alone
    is over the budget, ``overflow`` is set. Older rows follow newest first, and
    tool results at the head of the kept run are dropped again. Without a human
    message the whole tail is the current turn.
    """
    summed = running_sum(
        tail, ["conv_id"], F.floor(F.col("turn") / cell), [F.col("turn").desc()],
        F.col("tokens"), "_used", descending=True,
    )
    human = F.max(F.when(F.col("role").isin(*HUMAN), F.col("turn")))
    starts = tail.groupBy("conv_id").agg(F.coalesce(human, F.min("turn")).alias("_start"))
    placed = summed.join(starts.join(budgets, "conv_id"), "conv_id")
    older = (F.col("turn") < F.col("_start")) & (F.col("_used") <= F.col("budget"))
    bounds = placed.groupBy("conv_id").agg(
        F.max(F.when(F.col("turn") >= F.col("_start"), F.col("_used"))).alias("_must"),
        F.min(F.when(older & (F.col("role") != TOOL), F.col("turn"))).alias("_head"),
    )
    fits = older & F.coalesce(F.col("turn") >= F.col("_head"), F.lit(False))
    return (
        placed.join(bounds, "conv_id")
        .withColumn("kept", (F.col("turn") >= F.col("_start")) | fits)
        .withColumn("overflow", F.col("_must") > F.col("budget"))
        .drop("_used", "_start", "_must", "_head", "budget")
    )


def overflows(fitted: DataFrame) -> DataFrame:
    """``conv_id`` of the conversations whose current turn alone is over the budget."""
    return fitted.where("overflow").select("conv_id").distinct()


def refuse_overflow(fitted: DataFrame) -> DataFrame:
    """The rows of :func:`fit_tail`; the job fails if a current turn is over its budget."""
    text = F.concat(F.lit("the current turn is over the budget in conversation "), F.col("conv_id").cast("string"))
    checked = F.when(F.col("overflow"), F.raise_error(text).cast("boolean")).otherwise(F.col("overflow"))
    return fitted.withColumn("overflow", checked)


def fit_to_ceiling(
    tail: DataFrame, summaries: DataFrame, briefs: DataFrame, ceilings: DataFrame,
    refuse: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Fill each budget in the order tail, summaries, briefs; returns the kept rows.

    summaries: ``conv_id, segment, tokens``; briefs: ``conv_id, ordinal, size``. The last
    table lists the conversations that keep nothing, since their current turn alone is
    over the ceiling; with ``refuse`` such a conversation fails the job instead.
    """
    fitted = fit_tail(tail, ceilings)
    if refuse:
        fitted = refuse_overflow(fitted)
    kept_tail = fitted.where("kept and not overflow")
    sized = kept_tail.withColumn("size", F.col("tokens"))
    rest = left_over(ceilings, sized)
    alive = fitted.where("not overflow").select("conv_id").distinct()
    rest = rest.join(alive, "conv_id", "left_semi")
    kept_summaries = budget_fit(
        summaries.withColumn("size", F.col("tokens")), rest, "segment"
    ).drop("budget", "used")
    rest = left_over(rest, kept_summaries)
    kept_briefs = budget_fit(briefs, rest, "ordinal").drop("budget", "used")
    return kept_tail, kept_summaries, kept_briefs, overflows(fitted)


def brief_json() -> Column:
    return F.to_json(F.struct("id", "ordinal", "name", "query", "summary"))


def build_view(
    tail: DataFrame, summaries: DataFrame, briefs: DataFrame, ceilings: DataFrame | None = None,
    counter: Callable[[Column, Column], Column] = token_estimate,
) -> DataFrame:
    """The outgoing view: one manifest row, then summaries, then the tail.

    With ``ceilings`` the three layers are fitted first; a conversation whose current
    turn is over its ceiling is one row of role ``overflow`` in layer -1. The manifest
    lists all kept briefs in one message, in call order.
    """
    rendered = briefs.withColumn("content", brief_json())
    rendered = rendered.withColumn("size", counter(F.lit("human"), F.col("content")))
    if ceilings is not None:
        tail, summaries, rendered, lost = fit_to_ceiling(tail, summaries, rendered, ceilings)
    lines = F.transform(
        F.array_sort(F.collect_list(F.struct("ordinal", "content"))), lambda b: b["content"]
    )
    manifest = rendered.groupBy("conv_id").agg(
        F.concat(F.lit(MANIFEST_FRAME), F.array_join(lines, "\n")).alias("content")
    )
    view = (
        manifest.select("conv_id", F.lit(0).alias("layer"), F.lit(0).cast("long").alias("pos"),
                        F.lit("human").alias("role"), "content")
        .unionByName(summaries.select("conv_id", F.lit(1).alias("layer"),
                                      F.col("segment").cast("long").alias("pos"), "role", "content"))
        .unionByName(tail.select("conv_id", F.lit(2).alias("layer"),
                                 F.col("turn").cast("long").alias("pos"), "role", "content"))
    )
    if ceilings is None:
        return view
    mark = lost.select(
        "conv_id", F.lit(-1).alias("layer"), F.lit(0).cast("long").alias("pos"),
        F.lit("overflow").alias("role"), F.lit(None).cast("string").alias("content"),
    )
    return view.unionByName(mark)


def delta_of(
    slice_rows: DataFrame, max_chars: int, base: DataFrame | None = None,
    summarizer: Callable[[Column], Column] = first_lines,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Summaries, briefs and new bookmarks of closed slices."""
    marks = slice_rows.groupBy("conv_id").agg(F.max_by("msg_id", "turn").alias("bookmark_id"))
    return summary_rows(slice_rows, summarizer), tool_briefs(slice_rows, max_chars, base), marks


def prepare_delta(
    messages: DataFrame, budget: int, live_tail: int, max_chars: int,
    bookmarks: DataFrame | None = None, base: DataFrame | None = None,
    summarizer: Callable[[Column], Column] = first_lines,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New summaries, new briefs and new bookmarks; all empty where no slice closes.

    The slice numbers feed all three, so they are written to the shared folder.
    """
    numbers = stored(segment_numbers(messages, budget, live_tail, bookmarks), "slices")
    return delta_of(sliced(messages, numbers), max_chars, base, summarizer)


# fixed values: what happens to an old tool result
RETENTION = ("checkpoint", "external", "ephemeral")


def retention_apply(cold: DataFrame, policies: DataFrame, extract_chars: int = 200) -> tuple[DataFrame, DataFrame]:
    """Apply the retention policy of each tool to old results.

    cold: messages with ``tool_name``; policies: ``tool_name, policy`` (one row
    per tool). Kept results stay, external ones move to the payload table and
    leave a stub, ephemeral ones leave a tombstone. A tool without a policy is kept;
    a policy of another name fails the job.
    """
    unknown = F.concat(F.lit("unknown retention policy "), F.col("policy"))
    known = F.when(F.col("policy").isin(*RETENTION), F.col("policy")).when(
        F.col("policy").isNotNull(), F.raise_error(unknown).cast("string")
    )
    joined = cold.join(policies, "tool_name", "left")
    policy = F.when(F.col("role") == TOOL, F.coalesce(known, F.lit(RETENTION[0])))
    ref = F.concat(F.lit("ref_"), F.sha2(F.concat_ws("/", "conv_id", "msg_id"), 256))
    judged = joined.withColumns({"policy": policy, "ref": F.when(policy != RETENTION[0], ref)})
    stub = F.concat(F.left("content", F.lit(extract_chars)), F.lit(" ["), F.col("ref"), F.lit("]"))
    tombstone = F.concat(
        F.col("tool_name"), F.lit(" result not retained ("), F.col("ref"), F.lit("); re-call to refresh")
    )
    content = (
        F.when(F.col("policy") == RETENTION[1], stub)
        .when(F.col("policy") == RETENTION[2], tombstone)
        .otherwise(F.col("content"))
    )
    payloads = judged.where(F.col("policy") == RETENTION[1]).select(
        "ref", "conv_id", "msg_id", F.col("content").alias("payload")
    )
    return judged.withColumn("content", content).drop("policy"), payloads


def latest_token_count(messages: DataFrame) -> DataFrame:
    """Last reported token count per conversation."""
    return messages.groupBy("conv_id").agg(F.max_by("token_count", "turn").alias("token_count"))
