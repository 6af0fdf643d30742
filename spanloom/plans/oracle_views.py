"""The sample views of ``sources.sample_views`` in DuckDB SQL."""

from __future__ import annotations

import re

from ..signals import NIL_UUID


def _at(seconds: str) -> str:
    return f"(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST({seconds} AS int)))"


_EVENTS = """(SELECT date_trunc('HOUR', ts) AS h, concat('svc-', CAST(user_id % 6 AS varchar)) AS service_name,
                     event_type, value AS v FROM events) e"""
_NO_D = "CAST([] AS double[])"
_NO_L = "CAST([] AS bigint[])"
_NO_LABELS = "CAST(map() AS map(varchar, varchar))"

VIEWS: dict[str, str] = {
    "traces": f"""
SELECT md5(concat('t', CAST(o_orderkey AS varchar))) AS trace_id,
       md5(concat('s', CAST(o_orderkey AS varchar))) AS span_id,
       '' AS parent_span_id,
       {_at("o_orderkey * 7919 % 2592000")} AS timestamp,
       concat('svc-', CAST(o_custkey % 6 AS varchar)) AS service_name,
       'order.process' AS operation_name, 'SERVER' AS span_kind,
       CAST(floor(o_totalprice * 1000) AS bigint) AS duration_ns,
       CASE o_orderstatus WHEN 'P' THEN 'ERROR' ELSE 'OK' END AS status_code,
       map(['priority'], [o_orderpriority]) AS attributes
FROM orders
UNION ALL
SELECT md5(concat('t', CAST(l_orderkey AS varchar))),
       md5(concat('l', CAST(l_orderkey AS varchar), '-', CAST(l_linenumber AS varchar), '-', CAST(l_partkey AS varchar),
                  '-', CAST(l_suppkey AS varchar))),
       md5(concat('s', CAST(l_orderkey AS varchar))),
       {_at("l_orderkey * 7919 % 2592000 + l_linenumber")},
       concat('svc-', CAST(l_suppkey % 6 AS varchar)),
       concat('line.', l_linestatus), 'INTERNAL',
       CAST(floor(l_extendedprice * 1000) AS bigint),
       CASE l_returnflag WHEN 'R' THEN 'ERROR' ELSE 'OK' END,
       map(['returnflag'], [l_returnflag])
FROM lineitem""",
    "logs": """
SELECT md5(concat('log-', CAST(event_id AS varchar))) AS log_id,
       date_trunc('MILLISECOND', ts) AS timestamp,
       md5(concat('t', CAST(event_id AS varchar))) AS trace_id,
       md5(concat('s', CAST(event_id AS varchar))) AS span_id,
       concat('svc-', CAST(user_id % 6 AS varchar)) AS service_name,
       CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'click' THEN 'DEBUG' ELSE 'INFO' END
           AS severity,
       CASE user_id % 3 WHEN 0 THEN 'prod' WHEN 1 THEN 'staging' ELSE 'dev' END AS env,
       concat('cluster-', CAST(user_id % 3 AS varchar)) AS k8s_cluster,
       'core' AS k8s_namespace_name,
       concat('pod-', CAST(user_id AS varchar)) AS k8s_resource_name,
       'lib' AS instrumentation_library_name, '1.0.0' AS instrumentation_library_version,
       concat(event_type, ' by user ', CAST(user_id AS varchar)) AS body,
       map(['k'], [coalesce(json_extract_string(props, '$.k'), '')]) AS attributes
FROM events""",
    "ai_spans": f"""
SELECT trace_id, span_id, timestamp, service_name, agent_name, 'LLM' AS span_kind, llm_model,
       prompt_tokens, completion_tokens, prompt_tokens + completion_tokens AS total_tokens,
       prompt_tokens * 0.000003::double + completion_tokens * 0.000012::double AS cost_usd,
       (prompt_tokens + completion_tokens) * 1000003 AS duration_ns,
       CASE WHEN (prompt_tokens + completion_tokens) % 7 = 0 THEN 'ERROR' ELSE 'OK' END AS status_code,
       map(['role'], [role]) AS attributes
FROM (SELECT md5(concat('t', CAST(conv_id AS varchar))) AS trace_id,
             md5(concat('c', CAST(conv_id AS varchar), '-', CAST(turn AS varchar))) AS span_id,
             {_at("conv_id * 60 + turn")} AS timestamp,
             concat('svc-', CAST(conv_id % 6 AS varchar)) AS service_name,
             concat('agent-', CAST(conv_id % 4 AS varchar)) AS agent_name,
             concat('model-', CAST((conv_id + turn) % 4 AS varchar)) AS llm_model, role,
             CASE WHEN role = 'assistant' THEN 0::bigint ELSE CAST(length(text) AS bigint) END AS prompt_tokens,
             CASE WHEN role = 'assistant' THEN CAST(length(text) AS bigint) ELSE 0::bigint END AS completion_tokens
      FROM conversations) q""",
    "metrics": f"""
SELECT h AS timestamp, 'events_total' AS metric_name, service_name, 'counter' AS metric_type,
       CAST(count(*) AS double) AS value, {_NO_D} AS bucket_bounds, {_NO_L} AS bucket_counts,
       {_NO_D} AS quantiles, {_NO_D} AS quantile_values,
       0.0::double AS sum, CAST(0 AS bigint) AS count, map(['event_type'], [event_type]) AS labels
FROM {_EVENTS} GROUP BY h, service_name, event_type
UNION ALL
SELECT h, 'event_value_max', service_name, 'gauge', max(v), {_NO_D}, {_NO_L}, {_NO_D}, {_NO_D},
       0.0::double, CAST(0 AS bigint), {_NO_LABELS}
FROM {_EVENTS} GROUP BY h, service_name
UNION ALL
SELECT h, 'event_value', service_name, 'histogram', 0.0::double,
       CAST([1, 5, 10, 25, 50, 500] AS double[]),
       [CAST(count(*) FILTER (WHERE v <= 1) AS bigint), CAST(count(*) FILTER (WHERE v <= 5) AS bigint), CAST(count(*) FILTER (WHERE v <= 10) AS bigint),
        CAST(count(*) FILTER (WHERE v <= 25) AS bigint), CAST(count(*) FILTER (WHERE v <= 50) AS bigint), CAST(count(*) FILTER (WHERE v <= 500) AS bigint)],
       {_NO_D}, {_NO_D}, round_even(sum(v) * 100, 0) / 100, count(*), {_NO_LABELS}
FROM {_EVENTS} GROUP BY h, service_name
UNION ALL
SELECT h, 'event_value_range', service_name, 'summary', 0.0::double, {_NO_D}, {_NO_L},
       [0.0::double, 1.0::double], [min(v), max(v)], round_even(sum(v) * 100, 0) / 100, count(*), {_NO_LABELS}
FROM {_EVENTS} GROUP BY h, service_name""",
    "incidents": f"""
SELECT md5(concat('inc-', CAST(o_orderkey AS varchar))) AS incident_id,
       {_at("o_orderkey * 7919 % 2592000")} AS timestamp,
       concat('svc-', CAST(o_custkey % 6 AS varchar)) AS service_name,
       concat('Order ', CAST(o_orderkey AS varchar)) AS title,
       CASE WHEN o_totalprice >= 300000 THEN 'critical' WHEN o_totalprice >= 150000 THEN 'high' ELSE 'medium' END
           AS severity,
       CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'P' THEN 'acknowledged' ELSE 'open' END AS status,
       concat('rule-', CAST(o_custkey % 6 AS varchar)) AS alert_rule_id,
       CASE WHEN o_orderstatus = 'F' THEN {_at("o_orderkey * 7919 % 2592000 + 600 + o_orderkey % 7200")} END
           AS resolved_at,
       map(['priority'], [o_orderpriority]) AS labels
FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""",
    "alert_triggers": f"""
SELECT md5(concat('trg-', CAST(l_orderkey AS varchar), '-', CAST(l_linenumber AS varchar), '-',
                  CAST(l_partkey AS varchar), '-', CAST(l_suppkey AS varchar))) AS trigger_id,
       CASE WHEN l_returnflag = 'N' THEN '{NIL_UUID}'
            ELSE md5(concat('inc-', CAST(l_orderkey AS varchar))) END AS incident_id,
       {_at("l_orderkey * 7919 % 2592000 + l_linenumber * 60")} AS timestamp,
       CASE l_linestatus WHEN 'O' THEN 'firing' ELSE 'resolved' END AS status,
       concat('line ', CAST(l_linenumber AS varchar), ' alert') AS message,
       concat('svc-', CAST(l_suppkey % 6 AS varchar)) AS service_name,
       CAST(l_quantity AS bigint) AS trigger_count
FROM lineitem""",
}


def with_views(sql: str) -> str:
    """``sql`` with the views it names in front."""
    named = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not named:
        return sql
    views = ",\n".join(f"{v} AS ({VIEWS[v].strip()})" for v in named)
    body = sql.strip()
    return f"WITH {views},\n{body[4:].lstrip()}" if body[:5].upper() == "WITH " else f"WITH {views}\n{body}"


def round_even(value: str, digits: int) -> str:
    return f"(round_even(({value})::double * 1e{digits}, 0) / 1e{digits})"


def fixed_sum(value: str) -> str:
    return f"coalesce(fsum(({value})::double), 0)"


def label_text(labels: str) -> str:
    """Label maps of the sample views as Spark writes them: at most one entry."""
    return (
        f"CASE WHEN cardinality({labels}) = 0 THEN '[]' ELSE concat('[{{\"key\":\"', map_keys({labels})[1],"
        f" '\",\"value\":\"', map_values({labels})[1], '\"}}]') END"
    )


def uuid_text(hex32: str) -> str:
    return f"regexp_replace({hex32}, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"


def content_id(*parts: str) -> str:
    return uuid_text("md5(concat_ws(chr(31), " + ", ".join(parts) + "))")


def nearest_rank(by: str, value: str, source: str, quantiles: dict[str, float]) -> str:
    """Sub-query with the smallest value whose rank reaches q * n, per group."""
    picks = ", ".join(
        f"max(CASE WHEN _r = greatest(ceil({q}::double * _n), 1) THEN {value} END) AS {name}"
        for name, q in quantiles.items()
    )
    return (
        f"SELECT {by}, {picks} FROM (SELECT {by}, {value}, row_number() OVER (PARTITION BY {by} ORDER BY {value}) AS _r,"
        f" count(*) OVER (PARTITION BY {by}) AS _n FROM {source}) GROUP BY {by}"
    )
