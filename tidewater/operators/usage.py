"""Usage logs: tokens and cost per role, node durations, tool times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.ordered import quantiles


def usage_rollup(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls, tokens and estimated cost per role; NULL cost without a price.

    calls: ``role, input_tokens, output_tokens`` (a call without tokens does not
    count); prices: ``role, price_in, price_out`` per million tokens.
    """
    counted = calls.where((F.col("input_tokens") != 0) | (F.col("output_tokens") != 0))
    totals = counted.groupBy("role").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    )
    cost = (
        F.col("input_tokens") * F.col("price_in") + F.col("output_tokens") * F.col("price_out")
    ) / 1e6
    return totals.join(prices, "role", "left").select(
        "role", "calls", "input_tokens", "output_tokens",
        (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        cost.alias("estimated_cost"),
    )


def node_rollup(runs: DataFrame, step: float = 1.0) -> DataFrame:
    """Count, mean, median, p95 and maximum duration by node and status."""
    keys = ["node", "status"]
    base = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("elapsed_ms").alias("mean_ms"),
        F.max("elapsed_ms").alias("max_ms"),
        F.sum(F.col("error").isNotNull().cast("long")).alias("errors"),
    )
    shares = quantiles(runs, keys, F.col("elapsed_ms"), {"p50_ms": 0.5, "p95_ms": 0.95}, step)
    return base.join(shares, keys, "left")


def tool_elapsed(events: DataFrame) -> DataFrame:
    """Elapsed milliseconds per tool run; -1 for an end without a start.

    events: ``run_id, phase ('start' | 'end'), ts, tool``.
    """
    time = F.col("ts").cast("timestamp")
    at = lambda p: F.min(F.when(F.col("phase") == p, time))
    per = events.groupBy("run_id").agg(
        F.min(F.when(F.col("phase") == "start", F.col("tool"))).alias("tool"),
        at("start").alias("_s"),
        at("end").alias("_e"),
    )
    micros = F.unix_micros("_e") - F.unix_micros("_s")
    elapsed = F.when(F.col("_s").isNull(), -1).otherwise(F.bround(micros / 1000, 0))
    return per.where(F.col("_e").isNotNull()).select(
        "run_id", "tool", elapsed.cast("long").alias("elapsed_ms")
    )
