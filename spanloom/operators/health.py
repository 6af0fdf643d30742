"""Service health over time, and metrics beside it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio, round_even, sum_fixed
from ..functions.ordered import asof_lookup
from ..functions.times import slot_start
from .traces import is_error


def error_buckets(traces: DataFrame, bucket_seconds: int) -> DataFrame:
    """Spans and errors per service and time bucket."""
    return traces.groupBy("service_name", slot_start("timestamp", bucket_seconds).alias("bucket")).agg(
        F.count(F.lit(1)).alias("spans"), F.count_if(is_error()).alias("errors")
    )


def errors_beside_metric(
    traces: DataFrame, metrics: DataFrame, metric_name: str, bucket_seconds: int = 3600
) -> DataFrame:
    """Span error ratio and a metric's total by service and time bucket.

    Service and time are all that spans and metrics share. Both sides are
    summed to buckets before they meet.
    """
    totals = (
        metrics.filter(F.col("metric_name") == metric_name)
        .groupBy("service_name", slot_start("timestamp", bucket_seconds).alias("bucket"))
        .agg(sum_fixed("value").alias("metric_total"))
    )
    return (
        error_buckets(traces, bucket_seconds)
        .join(totals, ["service_name", "bucket"], "left")
        .withColumn("error_ratio", round_even(ratio(F.col("errors"), F.col("spans")), 6))
        .fillna(0.0, ["metric_total"])
    )


def moving_error_ratio(traces: DataFrame, bucket_seconds: int = 300, window_seconds: int = 3600) -> DataFrame:
    """Error ratio over the trailing window, at each bucket that has spans."""
    buckets = error_buckets(traces, bucket_seconds).withColumn("_s", F.unix_seconds("bucket"))
    # One row per service and bucket: bounded by time, not by spans.
    trailing = Window.partitionBy("service_name").orderBy("_s").rangeBetween(bucket_seconds - window_seconds, 0)
    spans, errors = F.sum("spans").over(trailing), F.sum("errors").over(trailing)
    return buckets.select(
        "service_name", "bucket", spans.alias("spans"), errors.alias("errors"),
        round_even(ratio(errors, spans), 6).alias("error_ratio"),
    )


def with_latest_metric(
    rows: DataFrame, metrics: DataFrame, metric_name: str, spread: Sequence[str]
) -> DataFrame:
    """Each row with its service's latest sample of a gauge at or before it.

    Where several series have a sample at one instant, the largest counts.
    """
    line = (
        metrics.filter((F.col("metric_name") == metric_name) & (F.col("metric_type") == "gauge"))
        .groupBy("service_name", F.col("timestamp").alias("sampled_at"))
        .agg(F.max("value").alias("metric_value"))
    )
    return asof_lookup(
        rows, "timestamp", line, "sampled_at", ["service_name"], ["sampled_at", "metric_value"], spread
    )
