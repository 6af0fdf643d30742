"""The six signals derived from the star-schema test tables.

``load(name)`` returns one of those tables, batch or streaming. Orders become
root spans and incidents, line items child spans and alert triggers, events
become logs and metrics, conversation turns become LLM spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.folders import is_folder
from ..signals import NIL_UUID, SIGNALS

Load = Callable[[str], DataFrame]

_ORIGIN = "timestamp_ntz'2024-01-01 00:00:00'"


def _at(seconds: str) -> str:
    return f"timestampadd(SECOND, CAST({seconds} AS int), {_ORIGIN})"


def _traces(load: Load) -> DataFrame:
    roots = load("orders").selectExpr(
        "md5(concat('t', CAST(o_orderkey AS string))) AS trace_id",
        "md5(concat('s', CAST(o_orderkey AS string))) AS span_id",
        "'' AS parent_span_id",
        f"{_at('o_orderkey * 7919 % 2592000')} AS timestamp",
        "concat('svc-', CAST(o_custkey % 6 AS string)) AS service_name",
        "'order.process' AS operation_name",
        "'SERVER' AS span_kind",
        "CAST(floor(o_totalprice * 1000) AS bigint) AS duration_ns",
        "CASE o_orderstatus WHEN 'P' THEN 'ERROR' ELSE 'OK' END AS status_code",
        "map('priority', o_orderpriority) AS attributes",
    )
    children = load("lineitem").selectExpr(
        "md5(concat('t', CAST(l_orderkey AS string))) AS trace_id",
        "md5(concat('l', CAST(l_orderkey AS string), '-', CAST(l_linenumber AS string), '-',"
        " CAST(l_partkey AS string), '-', CAST(l_suppkey AS string))) AS span_id",
        "md5(concat('s', CAST(l_orderkey AS string))) AS parent_span_id",
        f"{_at('l_orderkey * 7919 % 2592000 + l_linenumber')} AS timestamp",
        "concat('svc-', CAST(l_suppkey % 6 AS string)) AS service_name",
        "concat('line.', l_linestatus) AS operation_name",
        "'INTERNAL' AS span_kind",
        "CAST(floor(l_extendedprice * 1000) AS bigint) AS duration_ns",
        "CASE l_returnflag WHEN 'R' THEN 'ERROR' ELSE 'OK' END AS status_code",
        "map('returnflag', l_returnflag) AS attributes",
    )
    return roots.unionByName(children)


def _logs(load: Load) -> DataFrame:
    return load("events").selectExpr(
        "md5(concat('log-', CAST(event_id AS string))) AS log_id",
        "date_trunc('MILLISECOND', ts) AS timestamp",
        "md5(concat('t', CAST(event_id AS string))) AS trace_id",
        "md5(concat('s', CAST(event_id AS string))) AS span_id",
        "concat('svc-', CAST(user_id % 6 AS string)) AS service_name",
        "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN'"
        " WHEN 'click' THEN 'DEBUG' ELSE 'INFO' END AS severity",
        "CASE user_id % 3 WHEN 0 THEN 'prod' WHEN 1 THEN 'staging' ELSE 'dev' END AS env",
        "concat('cluster-', CAST(user_id % 3 AS string)) AS k8s_cluster",
        "'core' AS k8s_namespace_name",
        "concat('pod-', CAST(user_id AS string)) AS k8s_resource_name",
        "'lib' AS instrumentation_library_name",
        "'1.0.0' AS instrumentation_library_version",
        "concat(event_type, ' by user ', CAST(user_id AS string)) AS body",
        "map('k', coalesce(get_json_object(props, '$.k'), '')) AS attributes",
    )


def _ai_spans(load: Load) -> DataFrame:
    turns = load("conversations").selectExpr(
        "md5(concat('t', CAST(conv_id AS string))) AS trace_id",
        "md5(concat('c', CAST(conv_id AS string), '-', CAST(turn AS string))) AS span_id",
        f"{_at('conv_id * 60 + turn')} AS timestamp",
        "concat('svc-', CAST(conv_id % 6 AS string)) AS service_name",
        "concat('agent-', CAST(conv_id % 4 AS string)) AS agent_name",
        "concat('model-', CAST((conv_id + turn) % 4 AS string)) AS llm_model",
        "role",
        "CASE WHEN role = 'assistant' THEN CAST(0 AS bigint) ELSE CAST(length(text) AS bigint) END AS prompt_tokens",
        "CASE WHEN role = 'assistant' THEN CAST(length(text) AS bigint) ELSE CAST(0 AS bigint) END AS completion_tokens",
    )
    return turns.selectExpr(
        "trace_id", "span_id", "timestamp", "service_name", "agent_name", "'LLM' AS span_kind", "llm_model",
        "prompt_tokens", "completion_tokens", "prompt_tokens + completion_tokens AS total_tokens",
        "prompt_tokens * 0.000003D + completion_tokens * 0.000012D AS cost_usd",
        "(prompt_tokens + completion_tokens) * 1000003 AS duration_ns",
        "CASE WHEN (prompt_tokens + completion_tokens) % 7 = 0 THEN 'ERROR' ELSE 'OK' END AS status_code",
        "map('role', role) AS attributes",
    )


def _metrics(load: Load) -> DataFrame:
    hourly = load("events").selectExpr(
        "date_trunc('HOUR', ts) AS timestamp",
        "concat('svc-', CAST(user_id % 6 AS string)) AS service_name",
        "event_type",
        "value AS v",
    )
    none_d, none_l = "CAST(array() AS array<double>)", "CAST(array() AS array<bigint>)"
    no_labels = "CAST(map() AS map<string,string>)"
    counters = hourly.groupBy("timestamp", "service_name", "event_type").agg(F.count(F.lit(1)).alias("n")).selectExpr(
        "timestamp", "'events_total' AS metric_name", "service_name", "'counter' AS metric_type",
        "CAST(n AS double) AS value", f"{none_d} AS bucket_bounds", f"{none_l} AS bucket_counts",
        f"{none_d} AS quantiles", f"{none_d} AS quantile_values", "0.0D AS sum", "CAST(0 AS bigint) AS count",
        "map('event_type', event_type) AS labels",
    )
    per_hour = hourly.groupBy("timestamp", "service_name").agg(
        F.max("v").alias("hi"), F.min("v").alias("lo"), F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("v") <= b).alias(f"le_{b}") for b in (1, 5, 10, 25, 50, 500)],
    )
    gauges = per_hour.selectExpr(
        "timestamp", "'event_value_max' AS metric_name", "service_name", "'gauge' AS metric_type", "hi AS value",
        f"{none_d} AS bucket_bounds", f"{none_l} AS bucket_counts", f"{none_d} AS quantiles",
        f"{none_d} AS quantile_values", "0.0D AS sum", "CAST(0 AS bigint) AS count", f"{no_labels} AS labels",
    )
    histograms = per_hour.selectExpr(
        "timestamp", "'event_value' AS metric_name", "service_name", "'histogram' AS metric_type", "0.0D AS value",
        "array(1.0D, 5.0D, 10.0D, 25.0D, 50.0D, 500.0D) AS bucket_bounds",
        "array(le_1, le_5, le_10, le_25, le_50, le_500) AS bucket_counts",
        f"{none_d} AS quantiles", f"{none_d} AS quantile_values", "rint(s * 100) / 100 AS sum", "n AS count",
        f"{no_labels} AS labels",
    )
    summaries = per_hour.selectExpr(
        "timestamp", "'event_value_range' AS metric_name", "service_name", "'summary' AS metric_type",
        "0.0D AS value", f"{none_d} AS bucket_bounds", f"{none_l} AS bucket_counts",
        "array(0.0D, 1.0D) AS quantiles", "array(lo, hi) AS quantile_values",
        "rint(s * 100) / 100 AS sum", "n AS count", f"{no_labels} AS labels",
    )
    return counters.unionByName(gauges).unionByName(histograms).unionByName(summaries)


def _incidents(load: Load) -> DataFrame:
    return load("orders").filter("o_orderpriority IN ('1-URGENT', '2-HIGH')").selectExpr(
        "md5(concat('inc-', CAST(o_orderkey AS string))) AS incident_id",
        f"{_at('o_orderkey * 7919 % 2592000')} AS timestamp",
        "concat('svc-', CAST(o_custkey % 6 AS string)) AS service_name",
        "concat('Order ', CAST(o_orderkey AS string)) AS title",
        "CASE WHEN o_totalprice >= 300000 THEN 'critical' WHEN o_totalprice >= 150000 THEN 'high'"
        " ELSE 'medium' END AS severity",
        "CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'P' THEN 'acknowledged' ELSE 'open' END AS status",
        "concat('rule-', CAST(o_custkey % 6 AS string)) AS alert_rule_id",
        f"CASE WHEN o_orderstatus = 'F' THEN {_at('o_orderkey * 7919 % 2592000 + 600 + o_orderkey % 7200')} END"
        " AS resolved_at",
        "map('priority', o_orderpriority) AS labels",
    )


def _alert_triggers(load: Load) -> DataFrame:
    return load("lineitem").selectExpr(
        "md5(concat('trg-', CAST(l_orderkey AS string), '-', CAST(l_linenumber AS string), '-',"
        " CAST(l_partkey AS string), '-', CAST(l_suppkey AS string))) AS trigger_id",
        f"CASE WHEN l_returnflag = 'N' THEN '{NIL_UUID}'"
        " ELSE md5(concat('inc-', CAST(l_orderkey AS string))) END AS incident_id",
        f"{_at('l_orderkey * 7919 % 2592000 + l_linenumber * 60')} AS timestamp",
        "CASE l_linestatus WHEN 'O' THEN 'firing' ELSE 'resolved' END AS status",
        "concat('line ', CAST(l_linenumber AS string), ' alert') AS message",
        "concat('svc-', CAST(l_suppkey % 6 AS string)) AS service_name",
        "CAST(l_quantity AS bigint) AS trigger_count",
    )


_VIEWS: dict[str, Callable[[Load], DataFrame]] = {
    "traces": _traces,
    "logs": _logs,
    "metrics": _metrics,
    "ai_spans": _ai_spans,
    "incidents": _incidents,
    "alert_triggers": _alert_triggers,
}


def sample_view(signal: str, load: Load) -> DataFrame:
    """One signal, columns and types as in its table."""
    view = _VIEWS[signal](load)
    return view.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SIGNALS[signal].schema.fields])


def batch_load(spark: SparkSession, folder: str) -> Load:
    return lambda name: spark.read.parquet(f"{folder}/{name}.parquet")


def stream_load(spark: SparkSession, folder: str) -> Load:
    """The same tables as file streams. A table is one file of the folder, or a folder of files."""

    def load(name: str) -> DataFrame:
        path = f"{folder}/{name}.parquet"
        stream = spark.readStream.schema(spark.read.parquet(path).schema)
        if is_folder(spark, path):
            return stream.parquet(path)
        return stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)

    return load
