"""Windowed roll-ups. Each works on a table and on a stream alike.

On a stream a window is written once, when the watermark has passed its end;
rows behind the watermark are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.numeric import ratio, round_even, sum_fixed
from ..operators.traces import is_error
from .ingest import trigger


def _windowed(df: DataFrame, delay: str, window: Column, keys: list[str], *aggs: Column) -> DataFrame:
    out = df.withWatermark("timestamp", delay).groupBy(window.alias("_w"), *keys).agg(*aggs)
    names = [c for c in out.columns if c != "_w"]
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *names)


def red_windows(traces: DataFrame, width: str = "1 minute", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Spans, errors and error ratio per service and window."""
    out = _windowed(
        traces, delay, F.window("timestamp", width, slide), ["service_name"],
        F.count(F.lit(1)).alias("spans"), F.count_if(is_error()).alias("errors"),
    )
    return out.withColumn("error_ratio", round_even(ratio(F.col("errors"), F.col("spans")), 6))


def log_windows(logs: DataFrame, width: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Log lines per service, severity and window."""
    return _windowed(
        logs, delay, F.window("timestamp", width), ["service_name", "severity"], F.count(F.lit(1)).alias("lines")
    )


def cost_windows(ai_spans: DataFrame, width: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """LLM calls, tokens and cost per service and window."""
    return _windowed(
        ai_spans, delay, F.window("timestamp", width), ["service_name"],
        F.count(F.lit(1)).alias("calls"), F.sum("total_tokens").alias("total_tokens"),
        round_even(sum_fixed("cost_usd"), 6).alias("cost_usd"),
    )


def error_bursts(logs: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Session windows over ERROR lines of a service."""
    return _windowed(
        logs.filter("severity = 'ERROR'"), delay, F.session_window("timestamp", gap), ["service_name"],
        F.count(F.lit(1)).alias("lines"),
    )


def append_to(
    rows: DataFrame, path: str, checkpoint: str, live: bool = True, interval: str = "1 minute"
) -> StreamingQuery:
    """Append finished rows of a stream to Parquet files, each exactly once."""
    return (
        rows.writeStream.format("parquet").outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger(live, interval))
        .start()
    )
