"""Trace structure: spans with their parents, logs and LLM spans, per-trace summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio, round_even
from ..functions.quantiles import exact_quantiles
from ..functions.spread import lookup_join, null_safe_join

SPAN_KEY = ("trace_id", "span_id")


def is_error() -> Column:
    return F.col("status_code") == "ERROR"


def is_root() -> Column:
    return F.coalesce(F.col("parent_span_id"), F.lit("")) == ""


SPAN_COLUMNS = ("service_name", "operation_name", "status_code", "duration_ns", "timestamp")


def span_index(traces: DataFrame, prefix: str, columns: Sequence[str] = SPAN_COLUMNS) -> DataFrame:
    """One row per (trace_id, span_id) with ``columns``, prefixed.

    Span ids can repeat when a producer sends a request twice; the earliest row
    stands for the span, so joins to this table never multiply rows.
    """
    order = F.struct("timestamp", "service_name", "operation_name", "duration_ns", "status_code")
    index = traces.groupBy(*SPAN_KEY).agg(F.min_by(F.struct(*columns), order).alias("_s"))
    return index.select(*SPAN_KEY, *[F.col(f"_s.{c}").alias(f"{prefix}{c}") for c in columns])


def logs_with_spans(logs: DataFrame, traces: DataFrame) -> DataFrame:
    """Each log line once, with the span it was written in (NULLs when unknown)."""
    linked = (F.col("trace_id") != "") & (F.col("span_id") != "")
    return lookup_join(logs, span_index(traces, "span_"), SPAN_KEY, match_if=linked)


def with_parent(traces: DataFrame) -> DataFrame:
    """Each span once, with its parent's columns (NULLs for roots and orphans)."""
    parents = span_index(traces, "parent_").withColumnRenamed("span_id", "parent_span_id")
    return lookup_join(traces, parents, ["trace_id", "parent_span_id"], match_if=~is_root())


def self_times(traces: DataFrame) -> DataFrame:
    """Each span with the time not covered by its direct children, floored at 0."""
    children = (
        traces.filter(~is_root())
        .groupBy("trace_id", F.col("parent_span_id").alias("span_id"))
        .agg(
            F.count(F.lit(1)).alias("children"),
            F.sum(F.col("duration_ns").cast("decimal(20,0)")).alias("_child_ns"),
        )
    )
    joined = lookup_join(traces, children, SPAN_KEY)
    own = F.col("duration_ns") - F.coalesce(F.col("_child_ns"), F.lit(0))
    return joined.withColumns(
        {
            "children": F.coalesce(F.col("children"), F.lit(0)).cast("bigint"),
            "self_ns": F.greatest(own, F.lit(0)).cast(traces.schema["duration_ns"].dataType),
        }
    ).drop("_child_ns")


def orphan_spans(traces: DataFrame) -> DataFrame:
    """Spans that name a parent their trace does not hold."""
    known = traces.select("trace_id", F.col("span_id").alias("parent_span_id")).distinct()
    return lookup_join(traces.filter(~is_root()), known, ["trace_id", "parent_span_id"], how="left_anti")


def trace_summary(traces: DataFrame, gather: bool = False) -> DataFrame:
    """One row per trace: size, time span, root, slowest span, error flag, services.

    Spans without a trace id belong to no trace. Times are decimals: a long duration
    added to a time in nanoseconds leaves the range of a bigint. With ``gather``, for
    spans that do not lie by trace, narrow rows are brought together by trace first:
    aggregating where they lie sorts whole scan tasks, which spill, and saves little,
    as the spans of a trace are few and lie apart. They move by a hash of the trace,
    which the aggregate does not know, so a giant trace may be split over tasks and its
    parts are aggregated before they meet.
    """
    start_ns = F.unix_micros("timestamp").cast("decimal(38,0)") * 1000
    spans = traces.filter("trace_id <> ''").select(
        "trace_id", "span_id", "timestamp", "service_name", "duration_ns", is_root().alias("_root"), is_error().alias("_error")
    )
    if gather:
        spans = spans.withColumn("_at", F.xxhash64("trace_id")).hint("rebalance", "_at")
    return (
        spans.groupBy("trace_id")
        .agg(
            F.count(F.lit(1)).alias("spans"),
            F.count_if("_root").alias("roots"),
            F.min("timestamp").alias("started_at"),
            (F.max(start_ns + F.col("duration_ns")) - F.min(start_ns)).cast("decimal(38,0)").alias("wall_ns"),
            F.min_by(F.when(F.col("_root"), F.col("service_name")), F.when(F.col("_root"), F.struct("timestamp", "span_id"))).alias(
                "root_service"
            ),
            F.max_by("span_id", F.struct("duration_ns", "span_id")).alias("slowest_span_id"),
            F.max("duration_ns").alias("slowest_ns"),
            F.max("_error").alias("has_error"),
            F.array_sort(F.collect_set("service_name")).alias("services"),
        )
    )


def ai_spans_with_trace(ai_spans: DataFrame, traces: DataFrame, gather: bool = False) -> DataFrame:
    """Each LLM span once, with its trace's summary.

    LLM spans share only the trace id with spans, so the spans are reduced to
    one row per trace first; joining them directly would multiply tokens.
    """
    summary = trace_summary(traces, gather).select(
        "trace_id", F.col("spans").alias("trace_spans"), F.col("wall_ns").alias("trace_wall_ns"),
        F.col("root_service").alias("trace_root_service"), F.col("has_error").alias("trace_has_error"),
    )
    return lookup_join(ai_spans, summary, ["trace_id"], match_if=F.col("trace_id") != "")


def traces_with_errors(traces: DataFrame, logs: DataFrame, ai_spans: DataFrame) -> DataFrame:
    """Ids of traces that have an ERROR log or a failed LLM span."""
    failed = (
        logs.filter("severity = 'ERROR'").select("trace_id")
        .unionByName(ai_spans.filter(is_error()).select("trace_id"))
        .filter("trace_id <> ''").distinct()
    )
    return traces.select("trace_id").distinct().join(failed, "trace_id", "left_semi")


def service_edges(traces: DataFrame) -> DataFrame:
    """Calls and errors from parent service to child service."""
    return (
        with_parent(traces)
        .filter(F.col("parent_service_name").isNotNull())
        .groupBy(F.col("parent_service_name").alias("parent_service"), F.col("service_name").alias("child_service"))
        .agg(F.count(F.lit(1)).alias("calls"), F.count_if(is_error()).alias("errors"))
    )


def red(traces: DataFrame, by: Sequence[str] = ("service_name", "operation_name")) -> DataFrame:
    """Rate, errors and duration quantiles per group, the quantiles exact."""
    by = list(by)
    observed = F.greatest(F.unix_seconds(F.max("timestamp")) - F.unix_seconds(F.min("timestamp")), F.lit(1))
    counts = traces.groupBy(*by).agg(
        F.count(F.lit(1)).alias("spans"),
        F.count_if(is_error()).alias("errors"),
        round_even(F.count(F.lit(1)) / observed, 6).alias("spans_per_second"),
    )
    quantiles = exact_quantiles(traces, by, "duration_ns", {"p50_ns": 0.5, "p95_ns": 0.95, "p99_ns": 0.99})
    return null_safe_join(counts, quantiles, by).withColumn("error_ratio", round_even(ratio(F.col("errors"), F.col("spans")), 6))


def red_approximate(
    traces: DataFrame, by: Sequence[str] = ("service_name", "operation_name"), accuracy: int = 10000
) -> DataFrame:
    """As :func:`red` in one pass, quantile ranks off by at most ``1 / accuracy``."""
    marks = F.percentile_approx("duration_ns", [0.5, 0.95, 0.99], accuracy)
    out = traces.groupBy(*by).agg(
        F.count(F.lit(1)).alias("spans"), F.count_if(is_error()).alias("errors"), marks.alias("_q")
    )
    return out.select(
        *by, "spans", "errors", round_even(ratio(F.col("errors"), F.col("spans")), 6).alias("error_ratio"),
        *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(("p50_ns", "p95_ns", "p99_ns"))],
    )
