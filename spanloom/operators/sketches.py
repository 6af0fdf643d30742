"""Mergeable daily sketches: quantiles and distinct counts over any range of days.

One row per group and day is kept; a question over months merges those rows and reads no
span or sample. Rank errors do not grow with the number of days merged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.maps import label_key
from ..functions.numeric import ratio, round_even
from ..functions.times import day_key
from .traces import is_error

# Size of a quantile sketch: ranks are off by at most about 0.4 % at this size.
KLL_K = 1000
# Registers of a distinct-count sketch as a power of two: about 0.8 % standard error.
HLL_LG_K = 14
QUANTILES = {"p50_ns": 0.5, "p95_ns": 0.95, "p99_ns": 0.99}


def red_by_day(traces: DataFrame, by: Sequence[str] = ("service_name", "operation_name")) -> DataFrame:
    """Per group and day: spans, errors and a sketch of their durations."""
    return traces.groupBy(*by, day_key("timestamp").alias("dt")).agg(
        F.count(F.lit(1)).alias("spans"), F.count_if(is_error()).alias("errors"), F.kll_sketch_agg_double(F.col("duration_ns").cast("double"), F.lit(KLL_K)).alias("durations"),
    )


def red_over(days: DataFrame, by: Sequence[str] = ("service_name", "operation_name")) -> DataFrame:
    """Rate, errors and duration quantiles per group, from rows of :func:`red_by_day`."""
    merged = days.groupBy(*by).agg(
        F.sum("spans").alias("spans"), F.sum("errors").alias("errors"), F.kll_merge_agg_double("durations").alias("_all")
    )
    return merged.select(
        *by, "spans", "errors", round_even(ratio(F.col("errors"), F.col("spans")), 6).alias("error_ratio"),
        *[F.kll_sketch_get_quantile_double("_all", F.lit(q)).alias(name) for name, q in QUANTILES.items()],
    )


def cardinality_by_day(metrics: DataFrame) -> DataFrame:
    """Per metric and day: samples and a sketch of its series."""
    series = F.xxhash64("service_name", label_key("labels"))
    return metrics.groupBy("metric_name", "metric_type", day_key("timestamp").alias("dt")).agg(
        F.count(F.lit(1)).alias("samples"), F.hll_sketch_agg(series, F.lit(HLL_LG_K)).alias("series")
    )


def cardinality_over(days: DataFrame) -> DataFrame:
    """Series and samples per metric, from rows of :func:`cardinality_by_day`."""
    return days.groupBy("metric_name", "metric_type").agg(
        F.hll_sketch_estimate(F.hll_union_agg("series")).alias("series_count"), F.sum("samples").alias("samples")
    )
