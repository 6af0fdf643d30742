"""LLM usage: calls, tokens, cost and latency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import mean_long, ns_to_ms, ratio, round_even, split_fixed, sum_fixed
from ..functions.ordered import running_total
from ..functions.quantiles import exact_quantiles
from ..functions.spread import null_safe_join
from ..functions.times import day_key
from .topk import top_per_group
from .traces import is_error

DIMENSIONS = ("service_name", "agent_name", "llm_model")


def usage(ai_spans: DataFrame, by: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Calls, tokens, cost, error share, mean and p95 latency per group."""
    by = list(by)
    sums = ai_spans.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
        round_even(sum_fixed("cost_usd"), 6).alias("cost_usd"),
        round_even(ratio(F.count_if(is_error()), F.count(F.lit(1))), 6).alias("error_ratio"),
        round_even(mean_long("duration_ns") / F.lit(1000000), 3).alias("mean_ms"),
    )
    slow = exact_quantiles(ai_spans, by, "duration_ns", {"p95_ns": 0.95})
    return null_safe_join(sums, slow, by).withColumn("p95_ms", ns_to_ms("p95_ns", 3)).drop("p95_ns")


def usage_subtotals(ai_spans: DataFrame, by: Sequence[str] = DIMENSIONS, cube: bool = False) -> DataFrame:
    """Usage per group with sub-totals; ``level`` tells them from real NULLs.

    Rows are summed to the finest groups first, so the copies a roll-up or
    cube makes are copies of groups, not of spans.
    """
    by = list(by)
    finest = ai_spans.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("total_tokens").alias("total_tokens"),
        sum_fixed("cost_usd").alias("_cost"),
        F.count_if(is_error()).alias("errors"),
    )
    grouped = finest.cube(*by) if cube else finest.rollup(*by)
    return grouped.agg(
        F.grouping_id().cast("bigint").alias("level"),
        F.sum("calls").alias("calls"),
        F.sum("total_tokens").alias("total_tokens"),
        round_even(sum_fixed("_cost"), 6).alias("cost_usd"),
        F.sum("errors").alias("errors"),
    )


def costliest_models(ai_spans: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` models each service spends most on."""
    cost = ai_spans.groupBy("service_name", "llm_model").agg(round_even(sum_fixed("cost_usd"), 6).alias("cost_usd"))
    return top_per_group(cost, ["service_name"], [F.col("cost_usd").desc(), F.col("llm_model")], k, ["llm_model"])


def running_cost(ai_spans: DataFrame) -> DataFrame:
    """Cost of a service so far in the day, at each instant it had a span."""
    fixed, rest = split_fixed("cost_usd")
    per_instant = (
        ai_spans.withColumn("dt", day_key("timestamp"))
        .groupBy("service_name", "dt", "timestamp")
        .agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum(fixed), F.lit(0)).alias("cost"), F.coalesce(F.sum(rest), F.lit(0.0)).alias("rest"))
    )
    line = running_total(per_instant, ["service_name", "dt"], "timestamp", ["calls", "cost", "rest"])
    return line.select(
        "service_name", "dt", "timestamp", "calls", round_even(F.col("cost").cast("double") + F.col("rest"), 6).alias("cost_usd")
    )
