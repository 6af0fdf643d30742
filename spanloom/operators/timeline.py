"""All signals on one time line, and which services send which."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timeline(
    traces: DataFrame,
    logs: DataFrame,
    ai_spans: DataFrame,
    triggers: DataFrame,
    trace_id: str | None = None,
    service_name: str | None = None,
) -> DataFrame:
    """Spans, logs, LLM spans and triggers as rows of one shape, of a trace, a service or all.

    Triggers belong to no trace and are left out when one trace is asked for.
    Sort it with :func:`in_order` to read it.
    """

    def part(df: DataFrame, kind: str, row_id: str, what: str, trace: bool = True) -> DataFrame:
        return df.select(
            "timestamp", "service_name", F.lit(kind).alias("kind"),
            (F.col("trace_id") if trace else F.lit("")).alias("trace_id"),
            F.col(row_id).alias("row_id"), F.col(what).alias("what"),
        )

    rows = (
        part(traces, "span", "span_id", "operation_name")
        .unionByName(part(logs, "log", "log_id", "body"))
        .unionByName(part(ai_spans, "ai_span", "span_id", "llm_model"))
        .unionByName(part(triggers, "trigger", "trigger_id", "message", trace=False))
    )
    if trace_id is not None:
        rows = rows.filter(F.col("trace_id") == trace_id)
    if service_name is not None:
        rows = rows.filter(F.col("service_name") == service_name)
    return rows


def in_order(rows: DataFrame) -> DataFrame:
    """Time order; the ids are in the key so that one busy instant can be split."""
    return rows.orderBy("timestamp", "kind", "trace_id", "row_id")


def services_without(first: DataFrame, second: DataFrame) -> DataFrame:
    """Services seen in ``first`` and not in ``second``."""
    return first.select("service_name").distinct().exceptAll(second.select("service_name").distinct())


def services_in_both(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.select("service_name").distinct().intersect(second.select("service_name").distinct())
