"""Counters, gauges, histograms and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.histograms import histogram_quantile
from ..functions.maps import label_key, zip_pairs
from ..functions.numeric import round_even, sum_fixed
from ..functions.ordered import previous
from ..functions.times import slot_start

SERIES = ("service_name", "metric_name", "metric_type", "series")


def of_type(metrics: DataFrame, metric_type: str) -> DataFrame:
    """Samples of one metric type with their ``series`` key, the labels as text."""
    return metrics.filter(F.col("metric_type") == metric_type).withColumn("series", label_key("labels"))


def counter_samples(metrics: DataFrame, temporality: str = "delta") -> DataFrame:
    """How much each counter sample adds.

    ``delta``: the sample's own value. ``cumulative``: the rise since the
    previous sample of the series; a fall means the counter was reset and
    started from 0, and the first sample adds nothing. Repeated samples of one
    instant count once, the largest.
    """
    if temporality == "delta":
        return of_type(metrics, "counter").select(*SERIES, "timestamp", "value", F.col("value").alias("increase"))
    if temporality != "cumulative":
        raise ValueError("temporality is 'delta' or 'cumulative'")
    samples = of_type(metrics, "counter").groupBy(*SERIES, "timestamp").agg(F.max("value").alias("value"))
    before = F.col("prev_value")
    rise = F.when(before.isNull(), 0.0).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
    return previous(samples, SERIES, "timestamp", ["value"]).select(
        *SERIES, "timestamp", "value", rise.alias("increase")
    )


def counter_totals(metrics: DataFrame, temporality: str = "delta") -> DataFrame:
    """Samples and total increase per series."""
    return counter_samples(metrics, temporality).groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("samples"), sum_fixed("increase").alias("increase")
    )


def counter_rates(metrics: DataFrame, bucket_seconds: int = 3600, temporality: str = "delta") -> DataFrame:
    """Increase per second by series and time bucket."""
    return (
        counter_samples(metrics, temporality)
        .groupBy(*SERIES, slot_start("timestamp", bucket_seconds).alias("bucket"))
        .agg((sum_fixed("increase") / F.lit(float(bucket_seconds))).alias("per_second"))
    )


def gauge_buckets(metrics: DataFrame, bucket_seconds: int = 86400) -> DataFrame:
    """Least, greatest, mean and last value by series and time bucket."""
    return (
        of_type(metrics, "gauge")
        .groupBy(*SERIES, slot_start("timestamp", bucket_seconds).alias("bucket"))
        .agg(
            F.count(F.lit(1)).alias("samples"),
            F.min("value").alias("min_value"),
            F.max("value").alias("max_value"),
            (sum_fixed("value") / F.count("value")).alias("mean_value"),
            F.max_by("value", F.struct("timestamp", "value")).alias("last_value"),
        )
    )


def merge_histograms(metrics: DataFrame, by: Sequence[str] = SERIES, bucket_seconds: int = 86400) -> DataFrame:
    """Histograms of equal bounds added up per group and time bucket."""
    keys = [*by, "bucket", "bucket_bounds"]
    rows = of_type(metrics, "histogram").withColumn("bucket", slot_start("timestamp", bucket_seconds))
    # Sum and count belong to the row, so only its first entry carries them.
    first = F.coalesce(F.col("_pos"), F.lit(0)) == 0
    entries = rows.select(*keys, "sum", "count", F.posexplode_outer("bucket_counts").alias("_pos", "_n"))
    per_entry = entries.groupBy(*keys, "_pos").agg(
        F.sum("_n").alias("_n"),
        sum_fixed(F.when(first, F.col("sum"))).alias("_sum"),
        F.sum(F.when(first, F.col("count"))).alias("_count"),
        F.count_if(first).alias("_rows"),
    )
    # One entry per bound, so the list is as long as the histogram.
    merged = per_entry.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("_pos").isNotNull(), F.struct("_pos", "_n")))).alias("_entries"),
        F.sum("_rows").alias("histograms"),
        F.sum("_sum").alias("sum"),
        F.sum("_count").alias("count"),
    )
    return merged.select(
        *keys, F.transform("_entries", lambda e: e["_n"]).alias("bucket_counts"), "histograms", "sum", "count"
    )


def histogram_quantiles(
    merged: DataFrame, quantiles: dict[str, float], cumulative: bool = True, digits: int = 6
) -> DataFrame:
    """Add quantile columns to histograms."""
    return merged.withColumns(
        {
            name: round_even(histogram_quantile("bucket_bounds", "bucket_counts", "count", q, cumulative), digits)
            for name, q in quantiles.items()
        }
    )


def summary_quantiles(metrics: DataFrame) -> DataFrame:
    """One row per sample and quantile of a summary."""
    return of_type(metrics, "summary").select(
        *SERIES, "timestamp", "sum", "count",
        F.inline(zip_pairs("quantiles", "quantile_values")).alias("quantile", "quantile_value"),
    )


def series_cardinality(metrics: DataFrame, approximate: bool = False) -> DataFrame:
    """Series and samples per metric."""
    keyed = metrics.withColumn("series", label_key("labels"))
    if approximate:
        return keyed.groupBy("metric_name", "metric_type").agg(
            F.approx_count_distinct(F.xxhash64("service_name", "series")).alias("series_count"),
            F.count(F.lit(1)).alias("samples"),
        )
    per_series = keyed.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n"))
    return per_series.groupBy("metric_name", "metric_type").agg(
        F.count(F.lit(1)).alias("series_count"), F.sum("n").alias("samples")
    )


def attribute_usage(df: DataFrame, column: str = "attributes") -> DataFrame:
    """How many rows carry each attribute key."""
    return df.select(F.explode(F.map_keys(column)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
