"""The nine dashboard queries: four totals and five newest-rows tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ns_to_ms, round_even, sum_fixed


def total_tokens(ai_spans: DataFrame) -> DataFrame:
    return ai_spans.agg(F.coalesce(F.sum("total_tokens"), F.lit(0)).cast("bigint").alias("total_tokens"))


def total_cost(ai_spans: DataFrame) -> DataFrame:
    return ai_spans.agg(round_even(sum_fixed("cost_usd"), 4).alias("total_cost"))


def total_logs(logs: DataFrame) -> DataFrame:
    return logs.agg(F.count(F.lit(1)).alias("total_logs"))


def total_spans(traces: DataFrame) -> DataFrame:
    return traces.agg(F.count(F.lit(1)).alias("total_traces"))


def newest(df: DataFrame, n: int, *tie_breakers: str, days: list[int] | None = None) -> DataFrame:
    """Newest ``n`` rows. Each task keeps its own best ``n``; only those move.

    Given the ``days`` a stored table holds, only the newest days needed are read.
    """
    if days is not None:
        return newest_days(df, n, days, *tie_breakers)
    return df.orderBy(F.col("timestamp").desc(), *[F.col(c) for c in tie_breakers]).limit(n)


def recent_ai_spans(ai_spans: DataFrame, n: int = 50, days: list[int] | None = None) -> DataFrame:
    return newest(ai_spans, n, "trace_id", "span_id", days=days).select(
        "timestamp", "service_name", "agent_name", "llm_model", "prompt_tokens", "completion_tokens", "total_tokens",
        round_even("cost_usd", 5).alias("cost_usd"), ns_to_ms("duration_ns", 1).alias("latency_ms"), "status_code",
    )


def recent_logs(logs: DataFrame, n: int = 50, days: list[int] | None = None) -> DataFrame:
    return newest(logs, n, "log_id", days=days).select("timestamp", "service_name", "severity", "body", "env")


def recent_spans(traces: DataFrame, n: int = 50, days: list[int] | None = None) -> DataFrame:
    return newest(traces, n, "trace_id", "span_id", days=days).select(
        "timestamp", "service_name", "operation_name", "span_kind",
        ns_to_ms("duration_ns", 2).alias("duration_ms"), "status_code", "trace_id",
    )


def recent_incidents(incidents: DataFrame, n: int = 20, days: list[int] | None = None) -> DataFrame:
    return newest(incidents, n, "incident_id", days=days).select("timestamp", "service_name", "title", "severity", "status")


def recent_triggers(alert_triggers: DataFrame, n: int = 20, days: list[int] | None = None) -> DataFrame:
    return newest(alert_triggers, n, "trigger_id", days=days).select(
        "timestamp", "service_name", "status", "message", "trigger_count"
    )


def newest_days(df: DataFrame, n: int, days: list[int], *tie_breakers: str) -> DataFrame:
    """Newest ``n`` rows of a day-partitioned table, reading only the days needed.

    ``days`` are the days the table holds. The range doubles, newest first,
    until it has ``n`` rows; counting stops at ``n``.
    """
    recent, width = sorted(days, reverse=True), 1
    while width < len(recent) and df.filter(F.col("dt") >= recent[width - 1]).limit(n).count() < n:
        width *= 2
    if width < len(recent):
        df = df.filter(F.col("dt") >= recent[width - 1])
    return newest(df, n, *tie_breakers)
