"""Data-quality checks: table in, violations out.

Every check yields (check, signal, row_id, service_name, timestamp); a row that
breaks several rules of a table appears once per rule, from one scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import content_id
from ..functions.maps import label_key
from ..functions.spread import lookup_join
from .traces import is_root, with_parent


def _violations(df: DataFrame, signal: str, row_id: Column, checks: Mapping[str, Column]) -> DataFrame:
    broken = F.filter(
        F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(bad, F.lit(False)).alias("bad")) for n, bad in checks.items()]),
        lambda c: c["bad"],
    )
    return df.select(
        F.explode(F.transform(broken, lambda c: c["check"])).alias("check"),
        F.lit(signal).alias("signal"), row_id.alias("row_id"), "service_name", "timestamp",
    )


def check_tokens(ai_spans: DataFrame) -> DataFrame:
    """Total tokens that are not prompt plus completion tokens."""
    wrong = F.col("total_tokens") != F.col("prompt_tokens") + F.col("completion_tokens")
    return _violations(ai_spans, "ai_spans", F.col("span_id"), {"token_sum": wrong})


def check_cost(ai_spans: DataFrame, prices: DataFrame, tolerance: float = 0.00001) -> DataFrame:
    """Cost that differs from tokens times price, or a model without a price.

    ``prices`` has one row per ``llm_model``: ``prompt_price``, ``completion_price``.
    """
    priced = lookup_join(ai_spans, prices, ["llm_model"])
    expected = F.col("prompt_tokens") * F.col("prompt_price") + F.col("completion_tokens") * F.col("completion_price")
    return _violations(
        priced, "ai_spans", F.col("span_id"),
        {"cost": F.abs(F.col("cost_usd") - expected) > tolerance, "unknown_model": F.col("prompt_price").isNull()},
    )


def _rises(values: str, strictly: bool) -> Column:
    """Whether each entry of an array is above (or not below) the one before."""
    v = F.col(values)
    steps = F.zip_with(
        F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))),
        lambda a, b: (a < b) if strictly else (a <= b),
    )
    return F.forall(steps, lambda ok: ok)


def metric_row_id() -> Column:
    """Samples have no id; this one names a sample by series and time."""
    return content_id(
        F.col("service_name"), F.col("metric_name"), label_key("labels"), F.unix_micros("timestamp")
    )


def check_metric_arrays(metrics: DataFrame, cumulative: bool = True) -> DataFrame:
    """Bucket and quantile arrays that do not fit together or their metric type."""
    bounds, counts = F.col("bucket_bounds"), F.col("bucket_counts")
    names, values = F.col("quantiles"), F.col("quantile_values")
    is_hist = F.col("metric_type") == "histogram"
    last = F.try_element_at(counts, F.lit(-1)) if cumulative else F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)
    plain = F.col("metric_type").isin("counter", "gauge")
    checks = {
        "bucket_length": is_hist & (F.size(bounds) != F.size(counts)),
        "bounds_order": is_hist & ~_rises("bucket_bounds", strictly=True),
        "bucket_total": is_hist & (F.size(counts) > 0) & (last != F.col("count")),
        "quantile_length": F.size(names) != F.size(values),
        "quantile_range": F.exists(names, lambda q: (q < 0) | (q > 1)),
        "plain_with_arrays": plain & (F.size(bounds) + F.size(counts) + F.size(names) + F.size(values) > 0),
    }
    if cumulative:
        checks["counts_order"] = is_hist & ~_rises("bucket_counts", strictly=False)
    return _violations(metrics, "metrics", metric_row_id(), checks)


def check_spans(traces: DataFrame) -> DataFrame:
    """Spans longer than their parent, and spans whose parent is missing: one join tells both."""
    longer = F.col("duration_ns") > F.col("parent_duration_ns")
    missing = ~is_root() & F.col("parent_timestamp").isNull()
    return _violations(
        with_parent(traces), "traces", F.col("span_id"), {"longer_than_parent": longer, "missing_parent": missing}
    )


def check_incidents(incidents: DataFrame) -> DataFrame:
    """Status and ``resolved_at`` that contradict each other."""
    resolved, at = F.col("status") == "resolved", F.col("resolved_at")
    return _violations(
        incidents, "incidents", F.col("incident_id"),
        {
            "resolved_without_time": resolved & at.isNull(),
            "time_without_resolved": ~resolved & at.isNotNull(),
            "resolved_before_start": at < F.col("timestamp"),
        },
    )


def check_values(df: DataFrame, signal: str, row_id: str, allowed: Mapping[str, Sequence[str]]) -> DataFrame:
    """Empty service names, and values outside a column's list."""
    checks = {"empty_service_name": F.col("service_name") == ""}
    for column, values in allowed.items():
        checks[f"unknown_{column}"] = ~F.col(column).isin(*values)
    return _violations(df, signal, F.col(row_id), checks)
