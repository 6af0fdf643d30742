"""Every operator as a named query over the sample views, with its SQL twin.

Names start with the inventory id of the operator. Queries of operators that
read or write files do so in the shared work folder; those on streams read the
test tables as file streams and run until all input is taken.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import ids, maps, numeric, times
from ..functions.maps import attribute, label_key
from ..functions.quantiles import exact_quantiles
from ..functions.spread import lookup_join
from ..operators import (
    dedup, filters, health, incidents, logvolume, metrics, panels, quality, sessions, sketches, timeline, topk, traces, usage,
)
from ..session import tune, work_folder, written
from ..signals import NIL_UUID, SIGNALS
from ..sinks import upkeep
from ..sinks.colocated import buckets_for, read_by_trace, write_by_trace
from ..sinks.counters import CounterTable
from ..sinks.tables import write_rejected, write_signal
from ..sources import payloads
from ..sources.sample_views import batch_load, sample_view, stream_load
from ..sources.tables import count_rows, read_range, read_signal
from ..streaming import alerts, ingest, rollups, totals
from .oracle_views import content_id, fixed_sum, label_text, nearest_rank, round_even, uuid_text, with_views


class Inputs:
    """The six sample views of one test folder, as tables or as streams."""

    def __init__(self, spark: SparkSession, folder: str, streaming: bool = False):
        self.spark = tune(spark)
        self.folder = folder
        self.load = (stream_load if streaming else batch_load)(spark, folder)

    @cached_property
    def streams(self) -> "Inputs":
        return Inputs(self.spark, self.folder, streaming=True)

    def view(self, signal: str) -> DataFrame:
        return sample_view(signal, self.load)

    def __getattr__(self, name: str) -> DataFrame:
        if name in SIGNALS:
            return self.view(name)
        raise AttributeError(name)

    def new_folder(self, label: str) -> str:
        return work_folder(self.spark, label)

    def table(self, signal: str) -> str:
        """The view written as a day-partitioned table; returns its path."""
        path = self.new_folder(signal)
        write_signal(self.view(signal), signal, path, "all")
        return path


Query = Callable[[Inputs], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return add


def plain(df: DataFrame) -> DataFrame:
    """Timestamps without zone and whole numbers as bigint, as the test tables have them."""

    def shown(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.TimestampType):
            return F.col(f.name).cast("timestamp_ntz").alias(f.name)
        if isinstance(f.dataType, T.DecimalType) and f.dataType.scale == 0:
            return F.col(f.name).cast("bigint").alias(f.name)
        return F.col(f.name)

    return df.select(*[shown(f) for f in df.schema.fields])


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return plain(QUERIES[name](Inputs(spark, folder)))


def finish(query: StreamingQuery) -> StreamingQuery:
    query.awaitTermination()
    return query


# --- dashboard queries ---------------------------------------------------------------
# The columns these queries show, their names, rounding and row limits.

register("q1_total_tokens", "SELECT coalesce(sum(total_tokens), 0)::bigint AS total_tokens FROM ai_spans")(
    lambda i: panels.total_tokens(i.ai_spans)
)
register("q2_total_cost", f"SELECT {round_even(fixed_sum('cost_usd'), 4)} AS total_cost FROM ai_spans")(
    lambda i: panels.total_cost(i.ai_spans)
)
register("q3_total_logs", "SELECT count(*) AS total_logs FROM logs")(lambda i: panels.total_logs(i.logs))
register("q4_spans_per_day_stored", "SELECT CAST(strftime(timestamp, '%Y%m%d') AS int) AS dt, count(*) AS n FROM traces GROUP BY 1")(
    lambda i: count_rows(i.spark, i.table("traces"), "traces")
)
register("q4_total_spans", "SELECT count(*) AS total_traces FROM traces")(lambda i: panels.total_spans(i.traces))
register(
    "q5_recent_ai_spans",
    f"""SELECT timestamp, service_name, agent_name, llm_model, prompt_tokens, completion_tokens, total_tokens,
        {round_even('cost_usd', 5)} AS cost_usd, {round_even('duration_ns / 1000000', 1)} AS latency_ms, status_code
        FROM ai_spans ORDER BY timestamp DESC, trace_id, span_id LIMIT 50""",
)(lambda i: panels.recent_ai_spans(i.ai_spans))
register(
    "q6_recent_logs",
    "SELECT timestamp, service_name, severity, body, env FROM logs ORDER BY timestamp DESC, log_id LIMIT 50",
)(lambda i: panels.recent_logs(i.logs))
_RECENT_SPANS = f"""SELECT timestamp, service_name, operation_name, span_kind,
        {round_even('duration_ns / 1000000', 2)} AS duration_ms, status_code, trace_id
        FROM traces ORDER BY timestamp DESC, trace_id, span_id LIMIT 50"""
register("q7_recent_spans", _RECENT_SPANS)(lambda i: panels.recent_spans(i.traces))
register(
    "q8_recent_incidents",
    "SELECT timestamp, service_name, title, severity, status FROM incidents ORDER BY timestamp DESC, incident_id LIMIT 20",
)(lambda i: panels.recent_incidents(i.incidents))
register(
    "q9_recent_triggers",
    """SELECT timestamp, service_name, status, message, trigger_count FROM alert_triggers
       ORDER BY timestamp DESC, trigger_id LIMIT 20""",
)(lambda i: panels.recent_triggers(i.alert_triggers))


def _live(i: Inputs, total: DataFrame) -> DataFrame:
    path = i.new_folder("totals")
    finish(totals.keep_total(total, f"{path}/out", f"{path}/checkpoint", live=False))
    return totals.latest_total(i.spark, f"{path}/out")


@register(
    "q10_live_panels",
    f"""SELECT coalesce(sum(total_tokens), 0)::bigint AS total_tokens, {round_even(fixed_sum('cost_usd'), 4)} AS total_cost,
        count(*) AS calls FROM ai_spans""",
)
def _q10(i: Inputs) -> DataFrame:
    live = i.streams.ai_spans.agg(
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
        numeric.round_even(numeric.sum_fixed("cost_usd"), 4).alias("total_cost"),
        F.count(F.lit(1)).alias("calls"),
    )
    return _live(i, live)


register("q10_live_log_total", "SELECT count(*) AS total_logs FROM logs")(
    lambda i: _live(i, panels.total_logs(i.streams.logs))
)


# --- payload decoding -----------------------------------------------------------------

_ATTRIBUTES = {"traces": ("priority", "returnflag"), "logs": ("k",), "ai_spans": ("role",), "incidents": ("priority",)}


def _as_payloads(i: Inputs, signal: str, key: str) -> DataFrame:
    """One payload per view row: a lone object or a list of one, by turns of its id."""
    rows = payloads.encode(i.view(signal), signal)
    listed = F.when(F.ascii(key) % 2 == 0, F.concat(F.lit("["), "json", F.lit("]"))).otherwise(F.col("json"))
    return rows.select(F.col(key).alias("payload_id"), F.lit("view").alias("source"), listed.alias("value"))


def _decoded(i: Inputs, signal: str, key: str) -> DataFrame:
    return payloads.decode(_as_payloads(i, signal, key), signal)


def _flat(df: DataFrame, labels: str, keys: tuple[str, ...]) -> DataFrame:
    return df.select(
        *[c for c in df.columns if c != labels], *[attribute(labels, k).alias(f"label_{k}") for k in keys]
    )


def _labels_sql(labels: str, keys: tuple[str, ...]) -> str:
    return ", ".join(f"coalesce({labels}['{k}'], '') AS label_{k}" for k in keys)


_TRACES_FLAT = f"SELECT * EXCLUDE (attributes), {_labels_sql('attributes', ('priority', 'returnflag'))} FROM traces"
_LOGS_FLAT = f"""SELECT * EXCLUDE (log_id, attributes), {_labels_sql('attributes', ('k',))},
    {content_id("'logs'", 'log_id', "'0'")} AS log_id FROM logs"""
_AI_FLAT = f"""SELECT * EXCLUDE (cost_usd, attributes), {round_even('cost_usd', 9)} AS cost_usd,
    {_labels_sql('attributes', ('role',))} FROM ai_spans"""
_INCIDENTS_FLAT = f"""SELECT * EXCLUDE (incident_id, labels), {uuid_text('incident_id')} AS incident_id,
    {_labels_sql('labels', ('priority',))} FROM incidents"""
_TRIGGERS_FLAT = f"""SELECT * EXCLUDE (trigger_id, incident_id), {uuid_text('trigger_id')} AS trigger_id,
    CASE WHEN incident_id = '{NIL_UUID}' THEN incident_id ELSE {uuid_text('incident_id')} END AS incident_id
    FROM alert_triggers"""

# Arrays as text of whole numbers, so both engines print them alike.
_METRIC_ARRAYS = {"bucket_bounds": 1, "bucket_counts": 1, "quantiles": 1, "quantile_values": 100}


def _flat_metrics(df: DataFrame) -> DataFrame:
    def text(column: str, scale: int) -> Column:
        whole = F.transform(column, lambda x: F.rint(x * F.lit(float(scale))).cast("bigint").cast("string"))
        return F.array_join(whole, ",")

    texts = {c: text(c, k) for c, k in _METRIC_ARRAYS.items()}
    return df.withColumns(texts).withColumn("labels", label_key("labels"))


_METRICS_FLAT = (
    "SELECT * EXCLUDE (bucket_bounds, bucket_counts, quantiles, quantile_values, labels), "
    + ", ".join(
        f"array_to_string([round_even(x * {k}.0::double, 0)::bigint::varchar FOR x IN {c}], ',') AS {c}"
        for c, k in _METRIC_ARRAYS.items()
    )
    + f", {label_text('labels')} AS labels FROM metrics"
)


@register("s1_read_logs", _LOGS_FLAT)
def _s1(i: Inputs) -> DataFrame:
    return _flat(payloads.accepted_rows(_decoded(i, "logs", "log_id"), "logs"), "attributes", ("k",))


@register("s2_read_traces", _TRACES_FLAT)
def _s2(i: Inputs) -> DataFrame:
    rows = payloads.accepted_rows(_decoded(i, "traces", "span_id"), "traces")
    return _flat(rows, "attributes", ("priority", "returnflag"))


@register("s3_read_metrics", _METRICS_FLAT)
def _s3(i: Inputs) -> DataFrame:
    rows = payloads.encode(i.metrics, "metrics")
    texts = rows.select(F.md5("json").alias("payload_id"), F.lit("view").alias("source"), F.col("json").alias("value"))
    return _flat_metrics(payloads.accepted_rows(payloads.decode(texts, "metrics"), "metrics"))


@register("s4_read_ai_spans", _AI_FLAT)
def _s4(i: Inputs) -> DataFrame:
    rows = payloads.accepted_rows(_decoded(i, "ai_spans", "span_id"), "ai_spans")
    return _flat(rows.withColumn("cost_usd", numeric.round_even("cost_usd", 9)), "attributes", ("role",))


@register("s5_read_incidents", _INCIDENTS_FLAT)
def _s5(i: Inputs) -> DataFrame:
    return _flat(payloads.accepted_rows(_decoded(i, "incidents", "incident_id"), "incidents"), "labels", ("priority",))


@register("s6_read_triggers", _TRIGGERS_FLAT)
def _s6(i: Inputs) -> DataFrame:
    return payloads.accepted_rows(_decoded(i, "alert_triggers", "trigger_id"), "alert_triggers")


@register(
    "s7_one_or_many",
    """SELECT trace_id, span_id, parent_span_id, timestamp FROM traces
       UNION ALL SELECT trace_id, concat(span_id, '-again'), span_id, timestamp FROM traces""",
)
def _s7(i: Inputs) -> DataFrame:
    """Two elements per payload: the span and a copy that is its child."""
    again = F.concat(
        F.lit("[ "), "json", F.lit(" , "),
        F.to_json(F.struct("trace_id", F.concat("span_id", F.lit("-again")).alias("span_id"),
                           F.col("span_id").alias("parent_span_id"),
                           F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"))),
        F.lit("]"),
    )
    texts = payloads.encode(i.traces, "traces").select(
        F.col("span_id").alias("payload_id"), F.lit("view").alias("source"), again.alias("value")
    )
    rows = payloads.accepted_rows(payloads.decode(texts, "traces"), "traces")
    return rows.select("trace_id", "span_id", "parent_span_id", "timestamp")


# Faults planted by the first hex digit of the span id.
_FAULT_STATUS = """CASE left(span_id, 1)
    WHEN '0' THEN 'invalid_json' WHEN '1' THEN 'invalid_json' WHEN '2' THEN 'bad_timestamp' WHEN '3' THEN 'empty'
    WHEN '5' THEN 'invalid_json' WHEN '6' THEN 'invalid_json' ELSE 'ok' END"""


def _faulty_texts(i: Inputs) -> DataFrame:
    digit = F.substring("span_id", 1, 1)
    duration = r'"duration_ns":(\d+)'
    text = (
        F.when(digit == "0", F.regexp_replace("json", duration, '"duration_ns":"$1"'))
        .when(digit == "1", F.expr("left(json, length(json) - 1)"))
        .when(digit == "2", F.regexp_replace("json", '"timestamp"', '"time"'))
        .when(digit == "3", F.lit("[]"))
        .when(digit == "4", F.regexp_replace("json", duration, f'"duration_ns":{2**64 - 1}'))
        .when(digit == "6", F.regexp_replace("json", duration, f'"duration_ns":{2**64}'))
        # One bad element spoils the list it is in.
        .when(digit == "5", F.concat(F.lit("["), "json", F.lit(',{"span_id":7}]')))
        .otherwise(F.col("json"))
    )
    return payloads.encode(i.traces, "traces").select(
        F.col("span_id").alias("payload_id"), F.lit("view").alias("source"), text.alias("value")
    )


def _faulty(i: Inputs) -> DataFrame:
    return payloads.decode(_faulty_texts(i), "traces")


register("s8_reject_whole_payload", f"SELECT span_id AS payload_id, {_FAULT_STATUS} AS status FROM traces")(
    lambda i: _faulty(i).select("payload_id", "status")
)
register(
    "s9_reject_empty",
    "SELECT span_id AS payload_id, 0::bigint AS n_rows FROM traces WHERE left(span_id, 1) = '3'",
)(lambda i: _faulty(i).filter("status = 'empty'").select("payload_id", F.col("n_rows").cast("bigint").alias("n_rows")))


_WIDE = f"""SELECT service_name, span_id, duration_ns::hugeint AS ns FROM traces
    UNION ALL SELECT service_name, span_id, {2**64 - 1}::hugeint FROM traces WHERE span_id < '8'"""


def _widened(i: Inputs) -> DataFrame:
    """Payloads of one or three elements, of which one holds the largest unsigned integer."""
    wide = F.regexp_replace("json", r'"duration_ns":\d+', f'"duration_ns":{2**64 - 1}')
    texts = F.when(F.col("span_id") < "8", F.concat(F.lit("["), "json", F.lit(","), wide, F.lit("]"))).otherwise(F.col("json"))
    sent = payloads.encode(i.traces, "traces").select(
        F.col("span_id").alias("payload_id"), F.lit("view").alias("source"), texts.alias("value")
    )
    return payloads.accepted_rows(payloads.decode(sent, "traces"), "traces")


register("s8_unsigned_64", f"SELECT span_id, ns::varchar AS duration_ns FROM ({_WIDE})")(
    lambda i: _widened(i).select("span_id", F.col("duration_ns").cast("string").alias("duration_ns"))
)


@register(
    "s8_unsigned_64_stored",
    f"""WITH wide AS ({_WIDE}), ranks AS ({nearest_rank('service_name', 'ns', 'wide', {'p25': 0.25, 'p90': 0.9})})
    SELECT service_name, count(*) AS spans, sum(ns)::varchar AS total_ns, max(ns)::varchar AS longest_ns,
    any_value(p25)::varchar AS p25_ns, any_value(p90)::varchar AS p90_ns FROM wide JOIN ranks USING (service_name) GROUP BY 1""",
)
def _s8_stored(i: Inputs) -> DataFrame:
    """The same rows written to a table and read back: their sums and quantiles."""
    path = i.new_folder("traces")
    write_signal(_widened(i), "traces", path, "wide")
    table = read_signal(i.spark, path, "traces")
    sums = table.groupBy("service_name").agg(
        F.count(F.lit(1)).alias("spans"), F.sum("duration_ns").cast("string").alias("total_ns"), F.max("duration_ns").cast("string").alias("longest_ns")
    )
    marks = exact_quantiles(table, ["service_name"], "duration_ns", {"p25_ns": 0.25, "p90_ns": 0.9})
    return sums.join(marks.select("service_name", *[F.col(c).cast("string").alias(c) for c in ("p25_ns", "p90_ns")]), "service_name")


@register(
    "s10_zero_defaults",
    """SELECT timestamp, span_id, '' AS trace_id, '' AS parent_span_id, '' AS service_name, '' AS operation_name,
       '' AS span_kind, 0::bigint AS duration_ns, '' AS status_code, 0 AS n_attributes FROM traces""",
)
def _s10(i: Inputs) -> DataFrame:
    sparse = i.traces.select(
        F.col("span_id").alias("payload_id"), F.lit("view").alias("source"),
        F.to_json(F.struct(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "span_id")).alias("value"),
    )
    rows = payloads.accepted_rows(payloads.decode(sparse, "traces"), "traces")
    return rows.withColumn("n_attributes", F.size("attributes")).drop("attributes")


@register("s11_unknown_fields", "SELECT trace_id, span_id, duration_ns FROM traces")
def _s11(i: Inputs) -> DataFrame:
    more = F.regexp_replace("json", r"^\{", '{"extra":{"deep":[1,{"x":null}]},"note":"?",')
    texts = payloads.encode(i.traces, "traces").select(
        F.col("span_id").alias("payload_id"), F.lit("view").alias("source"), more.alias("value")
    )
    return payloads.accepted_rows(payloads.decode(texts, "traces"), "traces").select("trace_id", "span_id", "duration_ns")


_DROP_ID = "ascii(incident_id) % 2 = 0"


@register(
    "s12_fill_incident_id",
    f"""SELECT CASE WHEN {_DROP_ID} THEN {content_id("'incidents'", 'incident_id', "'0'")}
        ELSE {uuid_text('incident_id')} END AS incident_id, title FROM incidents""",
)
def _s12(i: Inputs) -> DataFrame:
    nil = i.incidents.withColumn("key", F.col("incident_id")).withColumn(
        "incident_id", F.when(F.expr(_DROP_ID), F.lit(NIL_UUID)).otherwise(F.col("incident_id"))
    )
    texts = payloads.encode(nil, "incidents").select(
        F.col("key").alias("payload_id"), F.lit("view").alias("source"), F.col("json").alias("value")
    )
    return payloads.accepted_rows(payloads.decode(texts, "incidents"), "incidents").select("incident_id", "title")


@register(
    "s13_fill_trigger_id",
    f"""SELECT {content_id("'alert_triggers'", 'trigger_id', "'0'")} AS trigger_id,
        CASE WHEN incident_id = '{NIL_UUID}' THEN incident_id ELSE {uuid_text('incident_id')} END AS incident_id
        FROM alert_triggers""",
)
def _s13(i: Inputs) -> DataFrame:
    without = F.regexp_replace("json", r'"trigger_id":"[0-9a-f]+",', "")
    texts = payloads.encode(i.alert_triggers, "alert_triggers").select(
        F.col("trigger_id").alias("payload_id"), F.lit("view").alias("source"), without.alias("value")
    )
    rows = payloads.accepted_rows(payloads.decode(texts, "alert_triggers"), "alert_triggers")
    return rows.select("trigger_id", "incident_id")


register(
    "s14_fill_log_id", f"""SELECT {content_id("'logs'", 'log_id', "'0'")} AS log_id, body FROM logs"""
)(lambda i: payloads.accepted_rows(_decoded(i, "logs", "log_id"), "logs").select("log_id", "body"))
register(
    "s15_payload_counts",
    f"""SELECT 'traces' AS signal, payload_id, status,
        CASE WHEN status = 'ok' THEN 1 ELSE 0 END::bigint AS accepted,
        CASE WHEN payload_id LIKE '5%' THEN 2 WHEN status IN ('ok', 'empty') OR payload_id LIKE '1%' THEN 0 ELSE 1 END::bigint
            AS rejected
        FROM (SELECT span_id AS payload_id, {_FAULT_STATUS} AS status FROM traces)""",
)(lambda i: payloads.payload_counts(_faulty(i)))
register(
    "s16_ingest_health",
    f"""SELECT 'traces' AS signal, {_FAULT_STATUS} AS status, count(*) AS payloads,
        sum(CASE left(span_id, 1) WHEN '1' THEN 0 WHEN '3' THEN 0 WHEN '5' THEN 2 ELSE 1 END)::bigint AS n_rows
        FROM traces GROUP BY 2
        UNION ALL SELECT 'logs', 'ok', count(*), count(*) FROM logs""",
)(lambda i: payloads.ingest_health(_faulty(i), _decoded(i, "logs", "log_id")))


_COUNTED = f"""SELECT {_FAULT_STATUS} AS status, CASE left(span_id, 1) WHEN '1' THEN 0 WHEN '3' THEN 0 WHEN '5' THEN 2 ELSE 1 END AS n
    FROM traces"""


@register(
    "x9_durable_counters",
    f"""WITH counted AS ({_COUNTED})
    SELECT 'payloads' AS name, count(*) AS n FROM counted
    UNION ALL SELECT 'payloads_' || status, count(*) FROM counted GROUP BY status
    UNION ALL SELECT 'accepted', sum(n)::bigint FROM counted WHERE status = 'ok'
    UNION ALL SELECT 'rejected', sum(n)::bigint FROM counted WHERE status <> 'ok'""",
)
def _x9_durable(i: Inputs) -> DataFrame:
    """A stream that is stopped after half its input and started again; its counters go on."""
    sent, out = i.new_folder("payloads"), i.new_folder("stream")
    texts = _faulty_texts(i)  # the stream decodes them
    half = F.pmod(F.crc32("payload_id"), F.lit(2))
    for n in range(2):
        texts.filter(half == n).select("value").write.mode("append").options(**_packed()).text(sent)
        finish(ingest.ingest(i.spark, sent, "traces", f"{out}/table", f"{out}/rejected", f"{out}/checkpoint",
                             live=False, max_files_per_trigger=5, counters=f"{out}/counters", spread=True))
    return CounterTable(i.spark, f"{out}/counters").totals().select("name", "n")


@register("s17_rfc3339_times", "SELECT log_id AS payload_id, timestamp FROM logs")
def _s17(i: Inputs) -> DataFrame:
    """The same instants written with nine decimals and another offset."""
    shifted = F.date_format(F.col("timestamp") - F.expr("INTERVAL '3:30' HOUR TO MINUTE"), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    texts = i.logs.select(
        F.col("log_id").alias("payload_id"), F.lit("view").alias("source"),
        F.to_json(F.struct(F.concat(shifted, F.lit("456789-03:30")).alias("timestamp"), F.col("log_id").alias("body"))).alias("value"),
    )
    rows = payloads.accepted_rows(payloads.decode(texts, "logs"), "logs")
    return rows.select(F.col("body").alias("payload_id"), "timestamp")


# --- tables ---------------------------------------------------------------------------

_AI_COMPARED = f"""SELECT * EXCLUDE (cost_usd, attributes), {round_even('cost_usd', 9)} AS cost_usd,
    {_labels_sql('attributes', ('role',))} FROM ai_spans"""


def _stored(i: Inputs, signal: str) -> DataFrame:
    return read_signal(i.spark, i.table(signal), signal).drop("dt")


register(
    "k1_append_logs", f"SELECT * EXCLUDE (attributes), {_labels_sql('attributes', ('k',))} FROM logs"
)(lambda i: _flat(_stored(i, "logs"), "attributes", ("k",)))
register("k2_append_traces", _TRACES_FLAT)(lambda i: _flat(_stored(i, "traces"), "attributes", ("priority", "returnflag")))
register("k3_append_metrics", _METRICS_FLAT)(lambda i: _flat_metrics(_stored(i, "metrics")))
register(
    "k4_append_incidents", f"SELECT * EXCLUDE (labels), {_labels_sql('labels', ('priority',))} FROM incidents"
)(lambda i: _flat(_stored(i, "incidents"), "labels", ("priority",)))
register("k5_append_triggers", "SELECT * FROM alert_triggers")(lambda i: _stored(i, "alert_triggers"))
register("k6_append_ai_spans", _AI_COMPARED)(
    lambda i: _flat(_stored(i, "ai_spans").withColumn("cost_usd", numeric.round_even("cost_usd", 9)), "attributes", ("role",))
)


# Lines a payload file is planned for: a batch is a number of files, so files must not grow with the input.
_LINES_PER_FILE = 4_000_000


def _packed(**options: str | int) -> dict[str, str | int]:
    """Options of payload files: texts take four times the room or more if they are not compressed."""
    return {"compression": "gzip", "maxRecordsPerFile": _LINES_PER_FILE} | options


def _payload_files(i: Inputs, decoded_from: DataFrame, **options: str | int) -> str:
    path = i.new_folder("payloads")
    decoded_from.select("value").write.options(**_packed(**options)).text(path)
    return path


@register("k7_micro_batches", _INCIDENTS_FLAT)
def _k7(i: Inputs) -> DataFrame:
    """Payload files taken a few at a time, each batch appended under its own label."""
    source = _payload_files(i, _as_payloads(i, "incidents", "incident_id").repartition(6, "payload_id"), compression="none", maxRecordsPerFile=0)
    out = i.new_folder("stream")
    finish(ingest.ingest(i.spark, source, "incidents", f"{out}/table", f"{out}/rejected", f"{out}/checkpoint",
                         live=False, max_files_per_trigger=2))
    return _flat(read_signal(i.spark, f"{out}/table", "incidents").drop("dt"), "labels", ("priority",))


def _rounded(df: DataFrame, column: str, digits: int) -> DataFrame:
    """For comparison only: operators return doubles as they are."""
    return df.withColumn(column, numeric.round_even(column, digits))


_PER_DAY = """SELECT CAST(strftime(timestamp, '%Y%m%d') AS int) AS dt, count(*) AS spans,
    sum(duration_ns)::bigint AS duration_ns FROM traces GROUP BY 1"""


def _per_day(df: DataFrame) -> DataFrame:
    return df.groupBy("dt").agg(F.count(F.lit(1)).alias("spans"), F.sum("duration_ns").alias("duration_ns"))


# Small enough that the test tables' days take several files.
_FILE_BYTES = 16_384


@register("k8_compact_day", f"SELECT *, true AS files_as_planned, true AS ranges_disjoint FROM ({_PER_DAY})")
def _k8(i: Inputs) -> DataFrame:
    """Three appends, then every day rewritten in sort-key ranges; shows whether a day has as many files
    as its bytes ask for, and whether their key ranges are apart."""
    path = i.new_folder("traces")
    third = F.pmod(F.crc32("span_id"), F.lit(3))
    for n in range(3):
        write_signal(i.traces.filter(third == n), "traces", path, f"part-{n}")
    days = upkeep.table_days(i.spark, path)
    planned = [(dt, upkeep.planned_files(i.spark, path, dt, _FILE_BYTES)) for dt in days]
    upkeep.compact_days(i.spark, path, "traces", dict(planned))
    layout = upkeep.day_layout(i.spark, path, "traces").join(i.spark.createDataFrame(planned, "dt int, planned int"), "dt")
    # A range of keys may be empty, so a day may have fewer files than planned, down to half.
    shown = layout.select("dt", F.col("files").between(F.ceil(F.col("planned") / 2), F.col("planned")).alias("files_as_planned"), "ranges_disjoint")
    return _per_day(read_signal(i.spark, path, "traces")).join(shown, "dt")


@register(
    "k9_keep_rejected",
    f"""SELECT 'traces' AS signal, payload_id, status FROM (SELECT span_id AS payload_id, {_FAULT_STATUS} AS status FROM traces)
        WHERE status <> 'ok'""",
)
def _k9(i: Inputs) -> DataFrame:
    path = i.new_folder("rejected")
    write_rejected(payloads.rejected_payloads(_faulty(i)), path)
    return i.spark.read.parquet(path).select("signal", "payload_id", "status")


register("k10_day_partitions", _PER_DAY)(lambda i: _per_day(read_signal(i.spark, i.table("traces"), "traces")))
register(
    "k11_clustered_read",
    "SELECT service_name, timestamp, trace_id, span_id FROM traces WHERE service_name = 'svc-3'",
)(
    lambda i: read_signal(i.spark, i.table("traces"), "traces")
    .filter("service_name = 'svc-3'").select("service_name", "timestamp", "trace_id", "span_id")
)

_AS_OF = datetime(2024, 2, 10, 12, 0, 0)


@register(
    "k12_retention",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS signal, count(*) AS kept, min(timestamp) AS oldest FROM {name}
       WHERE date_trunc('SECOND', timestamp) + INTERVAL {days} DAY > TIMESTAMP '2024-02-10 12:00:00'"""
        for name, days in (("traces", 30), ("logs", 30), ("metrics", 30), ("ai_spans", 30), ("incidents", 90), ("alert_triggers", 30))
    ),
)
def _k12(i: Inputs) -> DataFrame:
    parts = []
    for signal in SIGNALS:
        path = i.table(signal)
        upkeep.drop_expired(i.spark, path, signal, _AS_OF)
        kept = upkeep.apply_retention(read_signal(i.spark, path, signal), signal, _AS_OF)
        parts.append(kept.agg(F.lit(signal).alias("signal"), F.count(F.lit(1)).alias("kept"), F.min("timestamp").alias("oldest")))
    return reduce(DataFrame.unionByName, parts)


# --- filters --------------------------------------------------------------------------

register(
    "p1_project_rename", "SELECT trace_id, service_name AS service, duration_ns AS took_ns FROM traces"
)(lambda i: i.traces.select("trace_id", F.col("service_name").alias("service"), F.col("duration_ns").alias("took_ns")))
register(
    "p2_ns_to_ms", f"SELECT trace_id, span_id, {round_even('duration_ns / 1000000', 2)} AS duration_ms FROM traces"
)(lambda i: i.traces.select("trace_id", "span_id", numeric.ns_to_ms("duration_ns", 2).alias("duration_ms")))
register(
    "p4_time_range",
    """SELECT log_id, timestamp, service_name FROM logs
       WHERE timestamp >= TIMESTAMP '2024-01-10 06:00:00' AND timestamp < TIMESTAMP '2024-01-12 18:30:00'""",
)(
    lambda i: read_range(
        i.spark, i.table("logs"), "logs", datetime(2024, 1, 10, 6), datetime(2024, 1, 12, 18, 30)
    ).select("log_id", "timestamp", "service_name")
)
register(
    "p5_active_incidents",
    "SELECT incident_id, timestamp, service_name, severity, status FROM incidents WHERE status <> 'resolved'",
)(lambda i: incidents.active_incidents(_updates(i)).select("incident_id", "timestamp", "service_name", "severity", "status"))
register(
    "p6_attribute_filter",
    "SELECT trace_id, span_id FROM traces WHERE coalesce(attributes['returnflag'], '') = 'R'",
)(lambda i: filters.with_attribute(i.traces, "returnflag", "R").select("trace_id", "span_id"))
register("p6_attribute_missing", "SELECT trace_id, span_id FROM traces WHERE coalesce(attributes['priority'], '') = ''")(
    lambda i: filters.with_attribute(i.traces, "priority", "").select("trace_id", "span_id")
)
register("p7_body_search", "SELECT log_id, body FROM logs WHERE contains(lower(body), 'error by')")(
    lambda i: filters.body_contains(i.logs, "ERROR by").select("log_id", "body")
)
register("p7_body_pattern", "SELECT log_id, body FROM logs WHERE regexp_matches(body, '^(click|view) by user [0-9]*7$')")(
    lambda i: filters.body_matches(i.logs, "^(click|view) by user [0-9]*7$").select("log_id", "body")
)

# --- joins ----------------------------------------------------------------------------

# One row per (trace_id, span_id): the earliest.
_SPAN_INDEX = """(SELECT * FROM traces QUALIFY row_number() OVER (PARTITION BY trace_id, span_id
    ORDER BY timestamp, service_name, operation_name, duration_ns, status_code) = 1)"""

register(
    "j1_logs_with_spans",
    f"""SELECT l.log_id, l.trace_id, l.severity, s.service_name AS span_service_name, s.operation_name AS span_operation_name,
        s.status_code AS span_status_code, s.duration_ns AS span_duration_ns
        FROM logs l LEFT JOIN {_SPAN_INDEX} s ON l.trace_id = s.trace_id AND l.span_id = s.span_id""",
)(
    lambda i: traces.logs_with_spans(i.logs, i.traces).select(
        "log_id", "trace_id", "severity", "span_service_name", "span_operation_name", "span_status_code", "span_duration_ns"
    )
)
_SUMMARY = """SELECT trace_id, count(*) AS spans, count(*) FILTER (WHERE parent_span_id = '') AS roots, min(timestamp) AS started_at,
    (max(epoch_us(timestamp) * 1000 + duration_ns) - min(epoch_us(timestamp) * 1000))::bigint AS wall_ns,
    arg_min(service_name, (timestamp, span_id)) FILTER (WHERE parent_span_id = '') AS root_service,
    arg_max(span_id, (duration_ns, span_id)) AS slowest_span_id, max(duration_ns) AS slowest_ns,
    bool_or(status_code = 'ERROR') AS has_error,
    array_to_string(list_sort(list(DISTINCT service_name)), ',') AS services FROM traces GROUP BY trace_id"""
register(
    "j2_ai_spans_with_trace",
    f"""SELECT a.span_id, a.trace_id, a.total_tokens, s.spans AS trace_spans, s.wall_ns AS trace_wall_ns,
        s.root_service AS trace_root_service, s.has_error AS trace_has_error
        FROM ai_spans a LEFT JOIN ({_SUMMARY}) s ON a.trace_id = s.trace_id""",
)(
    lambda i: traces.ai_spans_with_trace(i.ai_spans, i.traces, gather=True).select(
        "span_id", "trace_id", "total_tokens", "trace_spans", F.col("trace_wall_ns").cast("bigint").alias("trace_wall_ns"),
        "trace_root_service", "trace_has_error",
    )
)
register(
    "j3_self_time",
    """SELECT t.trace_id, t.span_id, t.duration_ns, coalesce(c.n, 0) AS children,
       greatest(t.duration_ns - coalesce(c.ns, 0), 0)::bigint AS self_ns
       FROM traces t LEFT JOIN (SELECT trace_id, parent_span_id, count(*) AS n, sum(duration_ns) AS ns FROM traces
                                WHERE parent_span_id <> '' GROUP BY ALL) c
       ON t.trace_id = c.trace_id AND t.span_id = c.parent_span_id""",
)(lambda i: traces.self_times(i.traces).select("trace_id", "span_id", "duration_ns", "children", "self_ns"))
def _by_trace(i: Inputs, signal: str) -> DataFrame:
    # All tables that join have as many buckets: those the spans need, which are the most rows.
    buckets = max(8, buckets_for(i.traces.count()))
    return read_by_trace(i.spark, write_by_trace(i.view(signal), signal, i.new_folder(f"{signal}-by-trace"), buckets=buckets))


register(
    "j3_self_time_by_trace",
    """SELECT t.trace_id, t.span_id, coalesce(c.n, 0) AS children, greatest(t.duration_ns - coalesce(c.ns, 0), 0)::bigint AS self_ns
       FROM traces t LEFT JOIN (SELECT trace_id, parent_span_id, count(*) AS n, sum(duration_ns) AS ns FROM traces
                                WHERE parent_span_id <> '' GROUP BY ALL) c
       ON t.trace_id = c.trace_id AND t.span_id = c.parent_span_id""",
)(lambda i: traces.self_times(_by_trace(i, "traces")).select("trace_id", "span_id", "children", "self_ns"))
register(
    "j2_ai_spans_with_trace_by_trace",
    """SELECT a.span_id, a.trace_id, a.total_tokens, s.n AS trace_spans FROM ai_spans a
       LEFT JOIN (SELECT trace_id, count(*) AS n FROM traces GROUP BY 1) s ON a.trace_id = s.trace_id""",
)(
    lambda i: traces.ai_spans_with_trace(_by_trace(i, "ai_spans"), _by_trace(i, "traces")).select(
        "span_id", "trace_id", "total_tokens", "trace_spans"
    )
)
register(
    "j3_span_with_parent",
    """WITH spans AS MATERIALIZED (SELECT * FROM traces),
       parents AS MATERIALIZED (SELECT trace_id, span_id, arg_min(service_name, (timestamp, service_name, operation_name, duration_ns, status_code)) AS service_name,
         arg_min(duration_ns, (timestamp, service_name, operation_name, duration_ns, status_code)) AS duration_ns FROM spans GROUP BY 1, 2)
       SELECT t.trace_id, t.span_id, t.service_name, p.service_name AS parent_service_name, p.duration_ns AS parent_duration_ns
       FROM spans t LEFT JOIN parents p ON t.trace_id = p.trace_id AND t.parent_span_id = p.span_id""",
)(
    lambda i: traces.with_parent(i.traces).select(
        "trace_id", "span_id", "service_name", "parent_service_name", "parent_duration_ns"
    )
)
register(
    "j4_triggers_with_incident",
    """SELECT t.trigger_id, t.incident_id, i.title AS incident_title, i.severity AS incident_severity,
       i.status AS incident_status, i.alert_rule_id
       FROM alert_triggers t LEFT JOIN incidents i ON t.incident_id = i.incident_id""",
)(
    lambda i: incidents.triggers_with_incident(i.alert_triggers, i.incidents).select(
        "trigger_id", "incident_id", "incident_title", "incident_severity", "incident_status", "alert_rule_id"
    )
)
register(
    "j5_dangling_triggers",
    f"""SELECT trigger_id, incident_id FROM alert_triggers t WHERE incident_id <> '{NIL_UUID}'
        AND NOT EXISTS (SELECT 1 FROM incidents i WHERE i.incident_id = t.incident_id)""",
)(lambda i: incidents.dangling_triggers(i.alert_triggers, i.incidents).select("trigger_id", "incident_id"))
register("j5_uncorrelated_triggers", f"SELECT trigger_id FROM alert_triggers WHERE incident_id = '{NIL_UUID}'")(
    lambda i: incidents.uncorrelated_triggers(i.alert_triggers).select("trigger_id")
)


def _without_some_roots(i: Inputs) -> DataFrame:
    return i.traces.filter("NOT (parent_span_id = '' AND span_id LIKE 'a%')")


_SOME_ROOTS = "(SELECT * FROM traces WHERE NOT (parent_span_id = '' AND span_id LIKE 'a%'))"
register(
    "j5_orphan_spans",
    f"""WITH spans AS MATERIALIZED {_SOME_ROOTS}, known AS MATERIALIZED (SELECT DISTINCT trace_id, span_id FROM spans)
        SELECT c.trace_id, c.span_id, c.parent_span_id FROM spans c LEFT JOIN known p ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id
        WHERE c.parent_span_id <> '' AND p.span_id IS NULL""",
)(lambda i: traces.orphan_spans(_without_some_roots(i)).select("trace_id", "span_id", "parent_span_id"))
register(
    "j6_traces_with_errors",
    """SELECT DISTINCT trace_id FROM traces WHERE trace_id IN (SELECT trace_id FROM logs WHERE severity = 'ERROR'
       UNION SELECT trace_id FROM ai_spans WHERE status_code = 'ERROR')""",
)(lambda i: traces.traces_with_errors(i.traces, i.logs, i.ai_spans))
register(
    "j7_incident_impact",
    """WITH open AS (SELECT *, greatest(coalesce(resolved_at, TIMESTAMP '2024-02-01 00:00:00'), timestamp) AS ended_at FROM incidents),
       c AS (SELECT incident_id, count(*) AS spans, count(*) FILTER (WHERE t.status_code = 'ERROR') AS error_spans FROM open o JOIN traces t
             ON o.service_name = t.service_name AND t.timestamp BETWEEN o.timestamp AND o.ended_at GROUP BY 1),
       l AS (SELECT incident_id, count(*) AS logs, count(*) FILTER (WHERE g.severity = 'ERROR') AS error_logs FROM open o JOIN logs g
             ON o.service_name = g.service_name AND g.timestamp BETWEEN o.timestamp AND o.ended_at GROUP BY 1)
       SELECT o.incident_id, o.service_name, o.severity, o.timestamp, o.ended_at, coalesce(c.spans, 0) AS spans,
              coalesce(c.error_spans, 0) AS error_spans, coalesce(l.logs, 0) AS logs, coalesce(l.error_logs, 0) AS error_logs
       FROM open o LEFT JOIN c USING (incident_id) LEFT JOIN l USING (incident_id)""",
)(lambda i: incidents.incident_impact(i.incidents, i.traces, i.logs, datetime(2024, 2, 1)))
register(
    "j8_errors_beside_metric",
    f"""SELECT s.service_name, s.bucket, s.spans, s.errors, coalesce(m.total, 0) AS metric_total,
        {round_even('s.errors::double / s.spans', 6)} AS error_ratio
        FROM (SELECT service_name, date_trunc('HOUR', timestamp) AS bucket, count(*) AS spans,
                     count(*) FILTER (WHERE status_code = 'ERROR') AS errors FROM traces GROUP BY 1, 2) s
        LEFT JOIN (SELECT service_name, timestamp AS bucket, {round_even(fixed_sum('value'), 6)} AS total FROM metrics
                   WHERE metric_name = 'events_total' GROUP BY 1, 2) m
        ON s.service_name = m.service_name AND s.bucket = m.bucket""",
)(lambda i: _rounded(health.errors_beside_metric(i.traces, i.metrics, "events_total"), "metric_total", 6))


def _asof_sql(table: str, ids: str) -> str:
    return f"""SELECT {ids}, r.timestamp, g.timestamp AS sampled_at, g.value AS metric_value FROM {table} r
        ASOF LEFT JOIN (SELECT * FROM metrics WHERE metric_name = 'event_value_max') g
        ON r.service_name = g.service_name AND r.timestamp >= g.timestamp"""


register("j9_incident_latest_metric", _asof_sql("incidents", "r.incident_id"))(
    lambda i: health.with_latest_metric(i.incidents, i.metrics, "event_value_max", ["incident_id"]).select(
        "incident_id", "timestamp", "sampled_at", "metric_value"
    )
)
register("j9_span_latest_metric", _asof_sql("traces", "r.trace_id, r.span_id"))(
    lambda i: health.with_latest_metric(i.traces, i.metrics, "event_value_max", ["span_id"]).select(
        "trace_id", "span_id", "timestamp", "sampled_at", "metric_value"
    )
)

# --- aggregations ---------------------------------------------------------------------

register("a1_global_totals", "SELECT count(*) AS spans, sum(duration_ns)::bigint AS duration_ns FROM traces")(
    lambda i: i.traces.agg(F.count(F.lit(1)).alias("spans"), F.coalesce(F.sum("duration_ns"), F.lit(0)).alias("duration_ns"))
)
register(
    "a2_usage",
    f"""SELECT u.*, {round_even('q.p95_ns / 1000000', 3)} AS p95_ms FROM
        (SELECT service_name, agent_name, llm_model, count(*) AS calls, sum(prompt_tokens)::bigint AS prompt_tokens,
         sum(completion_tokens)::bigint AS completion_tokens, sum(total_tokens)::bigint AS total_tokens,
         {round_even(fixed_sum('cost_usd'), 6)} AS cost_usd,
         {round_even("count(*) FILTER (WHERE status_code = 'ERROR')::double / count(*)", 6)} AS error_ratio,
         {round_even('sum(duration_ns)::double / count(*) / 1000000', 3)} AS mean_ms
         FROM ai_spans GROUP BY 1, 2, 3) u
        JOIN ({nearest_rank('service_name, agent_name, llm_model', 'duration_ns', 'ai_spans', {'p95_ns': 0.95})}) q
        USING (service_name, agent_name, llm_model)""",
)(lambda i: usage.usage(i.ai_spans))


def _subtotals_sql(kind: str) -> str:
    return f"""SELECT service_name, agent_name, llm_model, grouping_id(service_name, agent_name, llm_model)::bigint AS level,
        count(*) AS calls, sum(total_tokens)::bigint AS total_tokens, {round_even(fixed_sum('cost_usd'), 6)} AS cost_usd,
        count(*) FILTER (WHERE status_code = 'ERROR') AS errors FROM ai_spans GROUP BY {kind}(service_name, agent_name, llm_model)"""


register("a3_usage_rollup", _subtotals_sql("ROLLUP"))(lambda i: usage.usage_subtotals(i.ai_spans))
register("a3_usage_cube", _subtotals_sql("CUBE"))(lambda i: usage.usage_subtotals(i.ai_spans, cube=True))
register(
    "a4_log_volume",
    """SELECT date_trunc('HOUR', timestamp) AS bucket, service_name, severity, env, count(*) AS lines
       FROM logs GROUP BY ALL""",
)(lambda i: logvolume.log_volume(i.logs))
register(
    "a4_log_volume_cube",
    """SELECT service_name, severity, env, grouping_id(service_name, severity, env)::bigint AS level, count(*) AS lines
       FROM logs GROUP BY CUBE(service_name, severity, env)""",
)(lambda i: logvolume.log_volume_cube(i.logs))
register(
    "a4_severity_table",
    """SELECT service_name, count(*) FILTER (WHERE severity = 'DEBUG') AS "DEBUG", count(*) FILTER (WHERE severity = 'INFO') AS "INFO",
       count(*) FILTER (WHERE severity = 'WARN') AS "WARN", count(*) FILTER (WHERE severity = 'ERROR') AS "ERROR",
       count(*) FILTER (WHERE severity NOT IN ('DEBUG', 'INFO', 'WARN', 'ERROR')) AS other FROM logs GROUP BY 1""",
)(lambda i: logvolume.severity_table(i.logs))
_RED_QUANTILES = {"p50_ns": 0.5, "p95_ns": 0.95, "p99_ns": 0.99}
register(
    "a5_red",
    f"""SELECT c.*, p50_ns, p95_ns, p99_ns, {round_even('errors::double / spans', 6)} AS error_ratio FROM
        (SELECT service_name, operation_name, count(*) AS spans, count(*) FILTER (WHERE status_code = 'ERROR') AS errors,
         {round_even('count(*)::double / greatest(floor(epoch(max(timestamp))) - floor(epoch(min(timestamp))), 1)', 6)}
             AS spans_per_second FROM traces GROUP BY 1, 2) c
        JOIN ({nearest_rank('service_name, operation_name', 'duration_ns', 'traces', _RED_QUANTILES)}) q
        USING (service_name, operation_name)""",
)(lambda i: traces.red(i.traces))


@register(
    "a5_red_approximate",
    """SELECT service_name, operation_name, count(*) AS spans, count(*) FILTER (WHERE status_code = 'ERROR') AS errors,
       true AS p50_ns, true AS p95_ns, true AS p99_ns FROM traces GROUP BY 1, 2""",
)
def _a5_approximate(i: Inputs) -> DataFrame:
    """Exact counts, and whether the rank of each approximate quantile is off by at most 1 / accuracy."""
    accuracy = 10_000
    return _within(i, traces.red_approximate(i.traces, accuracy=accuracy), ["service_name", "operation_name"], 1 / accuracy)


def _within(i: Inputs, found: DataFrame, keys: list[str], slack: float) -> DataFrame:
    """Whether the true rank of each quantile of ``found`` is off by at most a share ``slack``."""
    marks = sketches.QUANTILES
    ranked = i.traces.select(*keys, "duration_ns").join(found, keys).groupBy(*keys, "spans", "errors").agg(
        *[F.count_if(F.col("duration_ns") < F.col(m)).alias(f"{m}_below") for m in marks],
        *[F.count_if(F.col("duration_ns") <= F.col(m)).alias(f"{m}_upto") for m in marks],
    )
    off = F.col("spans") * slack + 1
    inside = [
        ((F.col(f"{m}_below") <= F.col("spans") * q + off) & (F.col(f"{m}_upto") >= F.col("spans") * q - off)).alias(m)
        for m, q in marks.items()
    ]
    return ranked.select(*keys, "spans", "errors", *inside)


@register(
    "a5_red_sketches",
    """SELECT service_name, operation_name, count(*) AS spans, count(*) FILTER (WHERE status_code = 'ERROR') AS errors,
       true AS p50_ns, true AS p95_ns, true AS p99_ns FROM traces GROUP BY 1, 2""",
)
def _a5_sketches(i: Inputs) -> DataFrame:
    """Sketches stored by day and merged; whether each quantile's rank is off by at most 1 %."""
    path = i.new_folder("red-by-day")
    sketches.red_by_day(i.traces).write.partitionBy("dt").parquet(path)
    found = sketches.red_over(i.spark.read.parquet(path))
    return _within(i, found, ["service_name", "operation_name"], 0.01)


register("a6_trace_summary", _SUMMARY)(
    lambda i: traces.trace_summary(i.traces, gather=True).withColumns(
        {"services": F.array_join("services", ","), "wall_ns": F.col("wall_ns").cast("bigint")}
    )
)
register(
    "a7_service_edges",
    f"""SELECT p.service_name AS parent_service, c.service_name AS child_service, count(*) AS calls,
        count(*) FILTER (WHERE c.status_code = 'ERROR') AS errors FROM traces c JOIN {_SPAN_INDEX} p
        ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id GROUP BY 1, 2""",
)(lambda i: traces.service_edges(i.traces))
_SERIES_SQL = f"service_name, metric_name, metric_type, {label_text('labels')} AS series"
register(
    "a8_counter_totals",
    f"""SELECT {_SERIES_SQL}, count(*) AS samples, {round_even(fixed_sum('value'), 6)} AS increase FROM metrics
        WHERE metric_type = 'counter' GROUP BY ALL""",
)(lambda i: _rounded(metrics.counter_totals(i.metrics), "increase", 6))
register(
    "a8_counter_rates",
    f"""SELECT {_SERIES_SQL}, date_trunc('DAY', timestamp) AS bucket,
        {round_even(fixed_sum('value') + ' / 86400.0::double', 6)} AS per_second FROM metrics
        WHERE metric_type = 'counter' GROUP BY ALL""",
)(lambda i: _rounded(metrics.counter_rates(i.metrics, 86400), "per_second", 6))

# A cumulative counter that starts again every day.
_CUMULATIVE = f"""(SELECT {_SERIES_SQL}, timestamp, sum(value) OVER (PARTITION BY service_name, metric_name,
    {label_text('labels')}, date_trunc('DAY', timestamp) ORDER BY timestamp) AS value FROM metrics WHERE metric_type = 'counter')"""
_INCREASES = f"""SELECT service_name, metric_name, metric_type, series, timestamp, value,
    CASE WHEN p IS NULL THEN 0 WHEN value < p THEN value ELSE value - p END AS increase FROM
    (SELECT *, lag(value) OVER (PARTITION BY service_name, metric_name, series ORDER BY timestamp) AS p FROM {_CUMULATIVE})"""


def _cumulative_counters(i: Inputs) -> DataFrame:
    from ..functions.ordered import running_total

    counters = metrics.of_type(i.metrics, "counter").withColumn("day", times.day_key("timestamp"))
    by = ["service_name", "metric_name", "series", "day"]
    total = running_total(counters, by, "timestamp", ["value"])
    return total.select(*SIGNALS["metrics"].columns)


register(
    "a8_cumulative_totals",
    f"""SELECT service_name, metric_name, metric_type, series, count(*) AS samples,
        {round_even(fixed_sum('increase'), 6)} AS increase FROM ({_INCREASES}) GROUP BY ALL""",
)(lambda i: _rounded(metrics.counter_totals(_cumulative_counters(i), "cumulative"), "increase", 6))
register(
    "a9_gauge_buckets",
    f"""SELECT {_SERIES_SQL}, date_trunc('DAY', timestamp) AS bucket, count(*) AS samples, min(value) AS min_value,
        max(value) AS max_value, {round_even(fixed_sum('value') + ' / count(*)', 6)} AS mean_value,
        arg_max(value, (timestamp, value)) AS last_value FROM metrics WHERE metric_type = 'gauge' GROUP BY ALL""",
)(lambda i: _rounded(metrics.gauge_buckets(i.metrics), "mean_value", 6))
_MERGED = f"""(SELECT {_SERIES_SQL}, date_trunc('DAY', timestamp) AS bucket, bucket_bounds, count(*) AS histograms,
    {round_even(fixed_sum('sum'), 2)} AS sum, sum(count)::bigint AS count,
    [{', '.join(f'sum(bucket_counts[{n}])::bigint' for n in range(1, 7))}] AS bucket_counts
    FROM metrics WHERE metric_type = 'histogram' GROUP BY ALL)"""
register(
    "a10_merge_histograms",
    f"""SELECT service_name, metric_name, metric_type, series, bucket, histograms, sum, count,
        array_to_string([x::varchar FOR x IN bucket_counts], ',') AS bucket_counts,
        array_to_string([x::bigint::varchar FOR x IN bucket_bounds], ',') AS bucket_bounds FROM {_MERGED}""",
)(
    lambda i: _rounded(metrics.merge_histograms(i.metrics), "sum", 2).withColumns(
        {c: F.array_join(F.transform(c, lambda x: x.cast("bigint").cast("string")), ",") for c in ("bucket_counts", "bucket_bounds")}
    )
)


def _quantile_sql(q: float) -> str:
    rank = f"({q}::double * count)"
    at = f"list_position([x >= {rank} FOR x IN bucket_counts], true)"
    lo = f"CASE WHEN {at} = 1 THEN 0.0::double ELSE bucket_bounds[{at} - 1] END"
    below = f"CASE WHEN {at} = 1 THEN 0.0::double ELSE bucket_counts[{at} - 1] END"
    value = f"""CASE WHEN count = 0 THEN NULL WHEN {at} IS NULL THEN bucket_bounds[-1]
        WHEN bucket_counts[{at}] = {below} THEN {lo}
        ELSE {lo} + (bucket_bounds[{at}] - {lo}) * ({rank} - {below}) / (bucket_counts[{at}] - {below}) END"""
    return round_even(value, 6)


register(
    "a11_histogram_quantile",
    f"""SELECT service_name, metric_name, bucket, {_quantile_sql(0.5)} AS p50, {_quantile_sql(0.95)} AS p95,
        {_quantile_sql(0.99)} AS p99 FROM {_MERGED}""",
)(
    lambda i: metrics.histogram_quantiles(metrics.merge_histograms(i.metrics), {"p50": 0.5, "p95": 0.95, "p99": 0.99}).select(
        "service_name", "metric_name", "bucket", "p50", "p95", "p99"
    )
)
register(
    "a12_summary_quantiles",
    f"""SELECT {_SERIES_SQL}, timestamp, sum, count, unnest(quantiles) AS quantile, unnest(quantile_values) AS quantile_value
        FROM metrics WHERE metric_type = 'summary'""",
)(lambda i: metrics.summary_quantiles(i.metrics))
_TTR = "(SELECT *, CAST(epoch(resolved_at) - epoch(timestamp) AS bigint) AS ttr_s FROM incidents)"
register(
    "a13_incident_stats",
    f"""SELECT c.*, q.p50_ttr_s, q.p95_ttr_s FROM
        (SELECT service_name, severity, count(*) AS incidents, count(ttr_s) AS resolved,
         {round_even('sum(ttr_s)::double / count(ttr_s)', 3)} AS mean_ttr_s FROM {_TTR} GROUP BY 1, 2) c
        LEFT JOIN ({nearest_rank('service_name, severity', 'ttr_s', f'(SELECT * FROM {_TTR} WHERE ttr_s IS NOT NULL)',
                                 {'p50_ttr_s': 0.5, 'p95_ttr_s': 0.95})}) q USING (service_name, severity)""",
)(lambda i: incidents.incident_stats(i.incidents))
_PER_INCIDENT = """SELECT i.incident_id, i.service_name, i.alert_rule_id, count(t.trigger_id) AS triggers,
    count(*) FILTER (WHERE t.status = 'firing') AS firing, coalesce(sum(t.trigger_count), 0)::bigint AS trigger_count,
    min(t.timestamp) AS first_at, max(t.timestamp) AS last_at
    FROM incidents i LEFT JOIN alert_triggers t ON i.incident_id = t.incident_id GROUP BY 1, 2, 3"""
register("a14_incident_alerts", _PER_INCIDENT)(
    lambda i: incidents.incident_alerts(i.incidents, i.alert_triggers).select(
        "incident_id", "service_name", "alert_rule_id", "triggers", "firing", "trigger_count", "first_at", "last_at"
    )
)
register(
    "a14_rule_alerts",
    f"""SELECT alert_rule_id, count(*) AS incidents, sum(triggers)::bigint AS triggers, sum(firing)::bigint AS firing,
        sum(trigger_count)::bigint AS trigger_count, min(first_at) AS first_at, max(last_at) AS last_at
        FROM ({_PER_INCIDENT}) GROUP BY 1""",
)(lambda i: incidents.rule_alerts(i.incidents, i.alert_triggers))
register(
    "a15_series_cardinality",
    f"""SELECT metric_name, metric_type, count(DISTINCT service_name || {label_text('labels')}) AS series_count,
        count(*) AS samples FROM metrics GROUP BY 1, 2""",
)(lambda i: metrics.series_cardinality(i.metrics))


@register(
    "a15_series_cardinality_approximate",
    "SELECT metric_name, metric_type, count(*) AS samples, true AS close FROM metrics GROUP BY 1, 2",
)
def _a15_approximate(i: Inputs) -> DataFrame:
    """Whether each approximate count is within four of its standard deviations (5 %) of the exact one."""
    keys = ["metric_name", "metric_type"]
    exact = metrics.series_cardinality(i.metrics).select(*keys, F.col("series_count").alias("exact"))
    off = F.abs(F.col("series_count") - F.col("exact"))
    return metrics.series_cardinality(i.metrics, approximate=True).join(exact, keys).select(
        *keys, "samples", (off <= F.greatest(F.lit(1.0), F.col("exact") * 0.2)).alias("close")
    )


@register(
    "a15_series_cardinality_sketches",
    "SELECT metric_name, metric_type, count(*) AS samples, true AS close FROM metrics GROUP BY 1, 2",
)
def _a15_sketches(i: Inputs) -> DataFrame:
    """Sketches stored by day and merged; whether each count is within 5 % of the exact one."""
    path, keys = i.new_folder("series-by-day"), ["metric_name", "metric_type"]
    sketches.cardinality_by_day(i.metrics).write.partitionBy("dt").parquet(path)
    exact = metrics.series_cardinality(i.metrics).select(*keys, F.col("series_count").alias("exact"))
    off = F.abs(F.col("series_count") - F.col("exact"))
    return sketches.cardinality_over(i.spark.read.parquet(path)).join(exact, keys).select(
        *keys, "samples", (off <= F.greatest(F.lit(1.0), F.col("exact") * 0.05)).alias("close")
    )


register(
    "a15_attribute_usage",
    "SELECT key, count(*) AS rows FROM (SELECT unnest(map_keys(attributes)) AS key FROM traces) GROUP BY 1",
)(lambda i: metrics.attribute_usage(i.traces))

# --- windows, top-k, sets -------------------------------------------------------------


def _updates(i: Inputs) -> DataFrame:
    """Incident states as they would be appended: opened, then what became of them."""
    opened = i.incidents.withColumns({"status": F.lit("open"), "resolved_at": F.lit(None).cast("timestamp")})
    return opened.unionByName(i.incidents.filter("status <> 'open'"))


_INCIDENT_COLUMNS = "incident_id, timestamp, service_name, title, severity, status, alert_rule_id, resolved_at"
register("w1_latest_state", f"SELECT {_INCIDENT_COLUMNS} FROM incidents")(
    lambda i: incidents.latest_state(_updates(i)).select(*_INCIDENT_COLUMNS.split(", "))
)


def _sent_twice(i: Inputs) -> DataFrame:
    later = i.logs.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 5 SECONDS"))
    return i.logs.unionByName(later)


register("w2_dedup", "SELECT log_id, timestamp, service_name, body FROM logs")(
    lambda i: dedup.earliest_per_id(_sent_twice(i), ["log_id"]).select("log_id", "timestamp", "service_name", "body")
)
register("w3_counter_increase", _INCREASES)(lambda i: metrics.counter_samples(_cumulative_counters(i), "cumulative"))
register(
    "w4_slowest_spans",
    """SELECT service_name, rank, trace_id, span_id, operation_name, timestamp, duration_ns FROM
       (SELECT *, row_number() OVER (PARTITION BY service_name ORDER BY duration_ns DESC, trace_id, span_id, timestamp)
        AS rank FROM traces) WHERE rank <= 10""",
)(lambda i: topk.slowest_spans(i.traces))
register(
    "w4_costliest_models",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY service_name ORDER BY cost_usd DESC, llm_model) AS rank FROM
        (SELECT service_name, llm_model, {round_even(fixed_sum('cost_usd'), 6)} AS cost_usd FROM ai_spans GROUP BY 1, 2))
        WHERE rank <= 3""",
)(lambda i: usage.costliest_models(i.ai_spans))
register(
    "w5_moving_error_ratio",
    f"""SELECT service_name, bucket, s::bigint AS spans, e::bigint AS errors, {round_even('e::double / s', 6)} AS error_ratio FROM
        (SELECT service_name, bucket, sum(spans) OVER w AS s, sum(errors) OVER w AS e FROM
         (SELECT service_name, time_bucket(INTERVAL 5 MINUTE, timestamp) AS bucket, count(*) AS spans,
                 count(*) FILTER (WHERE status_code = 'ERROR') AS errors FROM traces GROUP BY 1, 2)
         WINDOW w AS (PARTITION BY service_name ORDER BY bucket RANGE BETWEEN INTERVAL 55 MINUTE PRECEDING AND CURRENT ROW))""",
)(lambda i: health.moving_error_ratio(i.traces))
register(
    "w6_running_cost",
    f"""SELECT service_name, dt, timestamp, sum(calls) OVER w::bigint AS calls, {round_even('(sum(c) OVER w)::double', 6)} AS cost_usd FROM
        (SELECT service_name, CAST(strftime(timestamp, '%Y%m%d') AS int) AS dt, timestamp, count(*) AS calls,
                fsum(cost_usd) AS c FROM ai_spans GROUP BY 1, 2, 3)
        WINDOW w AS (PARTITION BY service_name, dt ORDER BY timestamp)""".replace("sum(calls) OVER w::bigint", "(sum(calls) OVER w)::bigint"),
)(lambda i: usage.running_cost(i.ai_spans))


@register("t1_newest", _RECENT_SPANS)
def _t1(i: Inputs) -> DataFrame:
    """The panel over a stored table: only its newest days are read."""
    path = i.table("traces")
    days = upkeep.table_days(i.spark, path)
    return panels.recent_spans(read_signal(i.spark, path, "traces"), days=days)


@register("t2_newest_days", "SELECT timestamp, trace_id, span_id FROM traces ORDER BY timestamp DESC, trace_id, span_id LIMIT 50")
def _t2(i: Inputs) -> DataFrame:
    path = i.table("traces")
    table = read_signal(i.spark, path, "traces")
    return panels.newest(table, 50, "trace_id", "span_id", days=upkeep.table_days(i.spark, path)).select(
        "timestamp", "trace_id", "span_id"
    )


register(
    "u1_timeline",
    """SELECT timestamp, service_name, 'span' AS kind, trace_id, span_id AS row_id, operation_name AS what FROM traces
       UNION ALL SELECT timestamp, service_name, 'log', trace_id, log_id, body FROM logs
       UNION ALL SELECT timestamp, service_name, 'ai_span', trace_id, span_id, llm_model FROM ai_spans
       UNION ALL SELECT timestamp, service_name, 'trigger', '', trigger_id, message FROM alert_triggers""",
)(lambda i: timeline.in_order(timeline.timeline(i.traces, i.logs, i.ai_spans, i.alert_triggers)))
register(
    "u2_services_without",
    """SELECT DISTINCT service_name FROM traces EXCEPT
       SELECT service_name FROM incidents WHERE severity = 'critical' AND service_name <> 'svc-2'""",
)(
    lambda i: timeline.services_without(
        i.traces, i.incidents.filter("severity = 'critical' AND service_name <> 'svc-2'")
    )
)
register("u2_services_in_both", "SELECT service_name FROM traces INTERSECT SELECT service_name FROM logs WHERE env = 'prod'")(
    lambda i: timeline.services_in_both(i.traces, i.logs.filter("env = 'prod'"))
)

# --- functions ------------------------------------------------------------------------

register("f1_round_even", f"SELECT span_id, {round_even('cost_usd', 4)} AS cost_usd FROM ai_spans")(
    lambda i: i.ai_spans.select("span_id", numeric.round_even("cost_usd", 4).alias("cost_usd"))
)
register("f2_float_division", f"SELECT trace_id, span_id, duration_ns / 1000000 AS duration_ms FROM traces")(
    lambda i: i.traces.select("trace_id", "span_id", (F.col("duration_ns").cast("double") / F.lit(1000000)).alias("duration_ms"))
)
register("f3_day_key", "SELECT log_id, CAST(strftime(timestamp, '%Y%m%d') AS int) AS dt FROM logs")(
    lambda i: i.logs.select("log_id", times.day_key("timestamp").alias("dt"))
)
register("f4_expires_at", "SELECT log_id, date_trunc('SECOND', timestamp) + INTERVAL 30 DAY AS expires_at FROM logs")(
    lambda i: i.logs.select("log_id", times.expires_at("timestamp", 30).alias("expires_at"))
)
register("f5_content_id", f"""SELECT span_id, {content_id("'traces'", 'trace_id', 'span_id')} AS id FROM traces""")(
    lambda i: i.traces.select("span_id", ids.content_id(F.lit("traces"), F.col("trace_id"), F.col("span_id")).alias("id"))
)
register("f6_json_record", "SELECT trigger_id AS payload_id, message, trigger_count FROM alert_triggers")(
    lambda i: payloads.accepted_rows(_decoded(i, "alert_triggers", "trigger_id"), "alert_triggers").select(
        F.regexp_replace("trigger_id", "-", "").alias("payload_id"), "message", "trigger_count"
    )
)


@register("f7_canonical_uuid", f"SELECT incident_id AS key, {uuid_text('incident_id')} AS id FROM incidents")
def _f7(i: Inputs) -> DataFrame:
    dashed = ids.uuid_layout(F.col("incident_id"))
    turn = F.ascii("incident_id") % 4
    spelled = (
        F.when(turn == 0, F.upper(dashed)).when(turn == 1, F.concat(F.lit("{"), dashed, F.lit("}")))
        .when(turn == 2, F.concat(F.lit("urn:uuid:"), dashed)).otherwise(F.col("incident_id"))
    )
    return i.incidents.select(F.col("incident_id").alias("key"), spelled.alias("s")).filter(ids.is_uuid(F.col("s"))).select(
        "key", ids.canonical_uuid(F.col("s")).alias("id")
    )


register("f8_attribute", "SELECT span_id, coalesce(attributes['returnflag'], '') AS flag FROM traces")(
    lambda i: i.traces.select("span_id", maps.attribute("attributes", "returnflag").alias("flag"))
)
register(
    "f9_zip_arrays",
    """SELECT service_name, timestamp, unnest(bucket_bounds) AS bound, unnest(bucket_counts) AS n FROM metrics
       WHERE metric_type = 'histogram'""",
)(
    lambda i: i.metrics.filter("metric_type = 'histogram'").select(
        "service_name", "timestamp", F.inline(maps.zip_pairs("bucket_bounds", "bucket_counts")).alias("bound", "n")
    )
)

# --- streams --------------------------------------------------------------------------


def _appended(i: Inputs, rows: DataFrame) -> DataFrame:
    path = i.new_folder("stream")
    finish(rollups.append_to(rows, f"{path}/out", f"{path}/checkpoint", live=False))
    return i.spark.read.schema(rows.schema).parquet(f"{path}/out")


_LOGS_BY_BODY = _LOGS_FLAT.replace(content_id("'logs'", 'log_id', "'0'"), "body")


# Even, so that both copies of a line stand in one file. A compressed file is read by one task, so files stay small.
_LINES_PER_PACKED_FILE = 100_000
# Such files in a batch: what a batch keeps, counts and sorts must not grow with the input either.
_PACKED_FILES_PER_BATCH = 64


@register(
    "x1_ingest_stream",
    f"SELECT *, 1::bigint AS rows_of_id FROM ({_LOGS_BY_BODY}) UNION ALL SELECT *, 1::bigint AS rows_of_id FROM ({_LOGS_BY_BODY})",
)
def _x1(i: Inputs) -> DataFrame:
    """Every line stands twice in its file; all rows must get ids of their own."""
    lines = _as_payloads(i, "logs", "log_id").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    source = _payload_files(i, lines, maxRecordsPerFile=_LINES_PER_PACKED_FILE)
    out = i.new_folder("stream")
    for _ in range(2):  # the second run finds nothing new
        finish(ingest.ingest(i.spark, source, "logs", f"{out}/table", f"{out}/rejected", f"{out}/checkpoint", live=False,
                             max_files_per_trigger=_PACKED_FILES_PER_BATCH))
    rows = _flat(read_signal(i.spark, f"{out}/table", "logs").drop("dt"), "attributes", ("k",))
    # Ids here come from file names: the text stands in for them once they are known to be different.
    # Ids alone are counted, and only those of several rows are looked up: rows stay where they are.
    repeated = rows.groupBy("log_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    counted = lookup_join(rows, written(repeated, "repeated-ids"), ["log_id"])
    return counted.withColumn("rows_of_id", F.coalesce("n", F.lit(1).cast("bigint"))).drop("n").withColumn("log_id", F.col("body"))


@register("x2_bounded_intake", "SELECT count(*) AS n_rows, sum(trigger_count)::bigint AS trigger_count FROM alert_triggers")
def _x2(i: Inputs) -> DataFrame:
    lines = _as_payloads(i, "alert_triggers", "trigger_id")
    # Few lines take four files; many are cut into files where they lie, without a shuffle.
    if i.alert_triggers.count() <= 4 * _LINES_PER_FILE:
        lines = lines.repartition(4, "payload_id")
    source = _payload_files(i, lines)
    out = i.new_folder("stream")
    finish(ingest.ingest(i.spark, source, "alert_triggers", f"{out}/table", f"{out}/rejected", f"{out}/checkpoint",
                         live=False, max_files_per_trigger=1, spread=True))
    return read_signal(i.spark, f"{out}/table", "alert_triggers").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("trigger_count").alias("trigger_count")
    )


register("x3_live_totals", "SELECT count(*) AS total_traces FROM traces")(
    lambda i: _live(i, panels.total_spans(i.streams.traces))
)


def _closed(view: str, delay: str = "10 MINUTE") -> str:
    """Condition that the watermark after all rows has passed a window."""
    return f"window_end <= (SELECT max(timestamp) FROM {view}) - INTERVAL {delay}"


_MINUTE = "time_bucket(INTERVAL 1 MINUTE, timestamp)"
_RED_WINDOWS = f"""SELECT {_MINUTE} AS window_start, {_MINUTE} + INTERVAL 1 MINUTE AS window_end, service_name,
    count(*) AS spans, count(*) FILTER (WHERE status_code = 'ERROR') AS errors,
    {round_even("count(*) FILTER (WHERE status_code = 'ERROR')::double / count(*)", 6)} AS error_ratio FROM traces GROUP BY 1, 2, 3"""
register("x4_red_windows", f"SELECT * FROM ({_RED_WINDOWS}) WHERE {_closed('traces')}")(
    lambda i: _appended(i, rollups.red_windows(i.streams.traces))
)
register(
    "x4_log_windows",
    f"""SELECT * FROM (SELECT {_MINUTE} AS window_start, {_MINUTE} + INTERVAL 1 MINUTE AS window_end, service_name, severity,
        count(*) AS lines FROM logs GROUP BY 1, 2, 3, 4) WHERE {_closed('logs')}""",
)(lambda i: _appended(i, rollups.log_windows(i.streams.logs)))
register(
    "x4_cost_windows",
    f"""SELECT * FROM (SELECT {_MINUTE} AS window_start, {_MINUTE} + INTERVAL 1 MINUTE AS window_end, service_name,
        count(*) AS calls, sum(total_tokens)::bigint AS total_tokens, {round_even(fixed_sum('cost_usd'), 6)} AS cost_usd
        FROM ai_spans GROUP BY 1, 2, 3) WHERE {_closed('ai_spans')}""",
)(lambda i: _appended(i, rollups.cost_windows(i.streams.ai_spans)))
register(
    "x5_sliding_error_ratio",
    f"""SELECT * FROM (SELECT window_start, window_start + INTERVAL 5 MINUTE AS window_end, service_name, count(*) AS spans,
        count(*) FILTER (WHERE status_code = 'ERROR') AS errors,
        {round_even("count(*) FILTER (WHERE status_code = 'ERROR')::double / count(*)", 6)} AS error_ratio
        FROM (SELECT *, {_MINUTE} - to_minutes(CAST(unnest(range(5)) AS int)) AS window_start FROM traces)
        GROUP BY 1, 2, 3) WHERE {_closed('traces')}""",
)(lambda i: _appended(i, rollups.red_windows(i.streams.traces, "5 minutes", "1 minute")))


def _bursts_sql(gap: str = "30 MINUTE") -> str:
    return f"""SELECT min(timestamp) AS {{0}}, max(timestamp) + INTERVAL {gap} AS {{1}}, service_name, count(*) AS lines FROM
        (SELECT *, sum(fresh) OVER (PARTITION BY service_name ORDER BY timestamp) AS burst FROM
         (SELECT *, CASE WHEN timestamp - lag(timestamp) OVER (PARTITION BY service_name ORDER BY timestamp, log_id)
                         < INTERVAL {gap} THEN 0 ELSE 1 END AS fresh FROM logs WHERE severity = 'ERROR'))
        GROUP BY service_name, burst"""


register(
    "x6_error_bursts",
    f"SELECT * FROM ({_bursts_sql().format('window_start', 'window_end')}) WHERE window_end <= "
    "(SELECT max(timestamp) FROM logs WHERE severity = 'ERROR') - INTERVAL 10 MINUTE",
)(lambda i: _appended(i, rollups.error_bursts(i.streams.logs)))
register("x6_error_bursts_batch", _bursts_sql().format("started_at", "ended_at"))(lambda i: sessions.error_bursts(i.logs))

_RULE, _THRESHOLD, _HOLD = "high-error-ratio", 0.2, 2


@register(
    "x7_alert_rule",
    f"""WITH closed AS (SELECT * FROM ({_RED_WINDOWS}) WHERE {_closed('traces')}),
        runs AS (SELECT *, epoch(window_start) / 60 - row_number() OVER (PARTITION BY service_name ORDER BY window_start) AS run
                 FROM closed WHERE errors::double / spans > {_THRESHOLD}),
        held AS (SELECT *, row_number() OVER w AS length, sum(errors) OVER (PARTITION BY service_name, run ORDER BY window_start
                 ROWS BETWEEN {_HOLD - 1} PRECEDING AND CURRENT ROW) AS n FROM runs
                 WINDOW w AS (PARTITION BY service_name, run ORDER BY window_start))
        SELECT {content_id(f"'{_RULE}'", 'service_name', 'epoch_us(window_end)::varchar')} AS trigger_id,
               '{NIL_UUID}' AS incident_id, window_end AS timestamp, 'firing' AS status,
               '{_RULE}: error ratio above {_THRESHOLD} for {_HOLD} buckets' AS message, service_name, n::bigint AS trigger_count
        FROM held WHERE length = {_HOLD}""",
)
def _x7(i: Inputs) -> DataFrame:
    out = i.new_folder("rule")
    finish(alerts.evaluate_rule(i.spark, i.streams.traces, _RULE, _THRESHOLD, _HOLD, f"{out}/buckets", f"{out}/triggers",
                                f"{out}/checkpoint", live=False))
    return read_signal(i.spark, f"{out}/triggers", "alert_triggers").drop("dt")


@register("x8_stream_dedup", "SELECT log_id, service_name, severity, body FROM logs")
def _x8(i: Inputs) -> DataFrame:
    twice = i.streams.logs.unionByName(i.streams.logs)
    rows = ingest.dedup_by_id(twice, ["log_id"], "1 hour").select("log_id", "service_name", "severity", "body")
    return _appended(i, rows)


register(
    "x9_lateness",
    """SELECT CASE WHEN date_trunc('SECOND', timestamp) + INTERVAL 30 DAY <= TIMESTAMP '2024-02-10 12:00:00' THEN 'expired'
       WHEN timestamp < TIMESTAMP '2024-01-20 00:00:00' THEN 'late' ELSE 'on_time' END AS arrival,
       count(*) AS n_rows, count(DISTINCT date_trunc('DAY', timestamp)) AS n_days FROM traces GROUP BY 1""",
)(lambda i: ingest.lateness_counts(i.traces, "traces", _AS_OF, datetime(2024, 1, 20)))

# --- data quality ---------------------------------------------------------------------
# Faults are planted by the first hex digit of an id, or of a sample's values.

register(
    "d1_token_sum",
    """SELECT 'token_sum' AS check, 'ai_spans' AS signal, span_id AS row_id, service_name, timestamp FROM ai_spans
       WHERE span_id LIKE 'a%'""",
)(
    lambda i: quality.check_tokens(
        i.ai_spans.withColumn("total_tokens", F.col("total_tokens") + F.startswith("span_id", F.lit("a")).cast("int"))
    )
)


@register(
    "d2_cost",
    """SELECT 'cost' AS check, 'ai_spans' AS signal, span_id AS row_id, service_name, timestamp FROM ai_spans
       WHERE span_id LIKE 'b%' AND llm_model <> 'model-3'
       UNION ALL SELECT 'unknown_model', 'ai_spans', span_id, service_name, timestamp FROM ai_spans WHERE llm_model = 'model-3'""",
)
def _d2(i: Inputs) -> DataFrame:
    prices = i.ai_spans.select("llm_model").distinct().filter("llm_model <> 'model-3'").select(
        "llm_model", F.lit(0.000003).alias("prompt_price"), F.lit(0.000012).alias("completion_price")
    )
    wrong = i.ai_spans.withColumn("cost_usd", F.col("cost_usd") + F.startswith("span_id", F.lit("b")).cast("double"))
    return quality.check_cost(wrong, prices)


_METRIC_ROW = content_id("service_name", "metric_name", label_text("labels"), "epoch_us(timestamp)::varchar")


@register(
    "d3_histogram_arrays",
    f"""SELECT unnest(CASE count % 5 WHEN 0 THEN ['bucket_total'] WHEN 1 THEN ['bucket_length'] WHEN 2 THEN ['bounds_order']
               WHEN 3 THEN CASE WHEN count > 0 THEN ['counts_order', 'bucket_total'] END END) AS check,
        'metrics' AS signal, {_METRIC_ROW} AS row_id, service_name, timestamp
        FROM metrics WHERE metric_type = 'histogram'""",
)
def _d3(i: Inputs) -> DataFrame:
    """Histograms broken in turn: wrong total, a lost bound, bounds or counts out of order."""
    turn, hist = F.col("count") % 5, F.col("metric_type") == "histogram"
    broken = i.metrics.withColumns(
        {
            "count": F.when(hist & (turn == 0), F.col("count") + 1).otherwise(F.col("count")),
            "bucket_bounds": F.when(hist & (turn == 1), F.slice("bucket_bounds", 1, 5))
            .when(hist & (turn == 2), F.reverse("bucket_bounds")).otherwise(F.col("bucket_bounds")),
            "bucket_counts": F.when(hist & (turn == 3), F.transform("bucket_counts", lambda x, n: F.when(n == 5, F.lit(-1).cast("bigint")).otherwise(x)))
            .otherwise(F.col("bucket_counts")),
        }
    )
    return quality.check_metric_arrays(broken)


@register(
    "d4_quantile_arrays",
    f"""SELECT CASE count % 3 WHEN 0 THEN 'quantile_length' ELSE 'quantile_range' END AS check, 'metrics' AS signal,
        {_METRIC_ROW} AS row_id, service_name, timestamp FROM metrics WHERE metric_type = 'summary' AND count % 3 < 2""",
)
def _d4(i: Inputs) -> DataFrame:
    turn, summary = F.col("count") % 3, F.col("metric_type") == "summary"
    broken = i.metrics.withColumns(
        {
            "quantile_values": F.when(summary & (turn == 0), F.slice("quantile_values", 1, 1)).otherwise(F.col("quantile_values")),
            "quantiles": F.when(summary & (turn == 1), F.transform("quantiles", lambda q: q + 0.5)).otherwise(F.col("quantiles")),
        }
    )
    return quality.check_metric_arrays(broken)


register(
    "d5_span_tree",
    f"""SELECT 'longer_than_parent' AS check, 'traces' AS signal, c.span_id AS row_id, c.service_name, c.timestamp
        FROM {_SOME_ROOTS} c JOIN (SELECT * FROM {_SOME_ROOTS} QUALIFY row_number() OVER (PARTITION BY trace_id, span_id
            ORDER BY timestamp, service_name, operation_name, duration_ns, status_code) = 1) p
        ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id WHERE c.duration_ns > p.duration_ns
        UNION ALL
        SELECT 'missing_parent', 'traces', span_id, service_name, timestamp FROM {_SOME_ROOTS} c
        WHERE parent_span_id <> '' AND NOT EXISTS
            (SELECT 1 FROM {_SOME_ROOTS} p WHERE p.trace_id = c.trace_id AND p.span_id = c.parent_span_id)""",
)(lambda i: quality.check_spans(_without_some_roots(i)))


@register(
    "d6_incident_states",
    """SELECT CASE WHEN incident_id LIKE '1%' THEN 'resolved_without_time' ELSE 'resolved_before_start' END AS check,
       'incidents' AS signal, incident_id AS row_id, service_name, timestamp FROM incidents
       WHERE status = 'resolved' AND (incident_id LIKE '1%' OR incident_id LIKE '2%')
       UNION ALL SELECT 'time_without_resolved', 'incidents', incident_id, service_name, timestamp FROM incidents
       WHERE status <> 'resolved' AND incident_id LIKE '3%'""",
)
def _d6(i: Inputs) -> DataFrame:
    digit, resolved = F.substring("incident_id", 1, 1), F.col("status") == "resolved"
    at = (
        F.when(resolved & (digit == "1"), F.lit(None).cast("timestamp"))
        .when(resolved & (digit == "2"), F.col("timestamp") - F.expr("INTERVAL 1 HOUR"))
        .when(~resolved & (digit == "3"), F.col("timestamp"))
        .otherwise(F.col("resolved_at"))
    )
    return quality.check_incidents(i.incidents.withColumn("resolved_at", at))


@register(
    "d7_known_values",
    """SELECT 'empty_service_name' AS check, 'logs' AS signal, log_id AS row_id, '' AS service_name, timestamp FROM logs
       WHERE log_id LIKE '0%'
       UNION ALL SELECT 'unknown_severity', 'logs', log_id, CASE WHEN log_id LIKE '0%' THEN '' ELSE service_name END, timestamp
       FROM logs WHERE severity = 'DEBUG'""",
)
def _d7(i: Inputs) -> DataFrame:
    nameless = i.logs.withColumn(
        "service_name", F.when(F.startswith("log_id", F.lit("0")), "").otherwise(F.col("service_name"))
    )
    return quality.check_values(
        nameless, "logs", "log_id", {"severity": ("INFO", "WARN", "ERROR"), "env": ("prod", "staging", "dev")}
    )


@register(
    "d8_plain_metrics",
    f"""SELECT 'plain_with_arrays' AS check, 'metrics' AS signal, {_METRIC_ROW} AS row_id, service_name, timestamp
        FROM metrics WHERE metric_type IN ('counter', 'gauge') AND service_name = 'svc-4'""",
)
def _d8(i: Inputs) -> DataFrame:
    plain_type = F.col("metric_type").isin("counter", "gauge") & (F.col("service_name") == "svc-4")
    broken = i.metrics.withColumn(
        "bucket_bounds", F.when(plain_type, F.array(F.lit(1.0))).otherwise(F.col("bucket_bounds"))
    )
    return quality.check_metric_arrays(broken)
