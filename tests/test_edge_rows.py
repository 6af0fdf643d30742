"""Rows that are easily lost: NULL and empty ids, tiny amounts, long durations."""

import re
from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.numeric import sum_fixed
from spanloom.functions.quantiles import exact_quantiles
from spanloom.operators import dedup, incidents, metrics, quality, topk, traces, usage
from spanloom.signals import SIGNALS

AT = datetime(2024, 1, 1)
ZERO = {"string": "", "bigint": 0, "decimal(20,0)": 0, "int": 0, "double": 0.0, "timestamp": AT}


def rows(spark, signal, *given):
    """Rows of a signal from partial ones; NULL must be given."""
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in SIGNALS[signal].schema.fields])
    empty = {f.name: {} if isinstance(f.dataType, T.MapType) else [] if isinstance(f.dataType, T.ArrayType) else ZERO[f.dataType.simpleString()] for f in schema.fields}

    def typed(value, kind):
        if isinstance(kind, T.ArrayType):
            return [typed(v, kind.elementType) for v in value]
        return Decimal(value) if isinstance(kind, T.DecimalType) and value is not None else value

    return spark.createDataFrame([tuple(typed((empty | g)[f.name], f.dataType) for f in schema.fields) for g in given], schema)


def test_tiny_and_huge_amounts_are_summed(spark):
    tiny = spark.range(1000).select(F.lit(4e-10).alias("x")).agg(sum_fixed("x")).first()[0]
    assert abs(tiny - 4e-7) < 1e-15
    huge = spark.createDataFrame([(1e25,), (2.5,), (None,)], "x double").agg(sum_fixed("x")).first()[0]
    assert huge == 1e25 + 2.5
    spent = rows(spark, "ai_spans", *[{"service_name": "s", "cost_usd": 4e-10, "timestamp": AT}] * 5000)
    assert usage.running_cost(spent).first()["cost_usd"] == 2e-6


def test_histogram_sums_keep_their_places(spark):
    one = rows(spark, "metrics", {"metric_type": "histogram", "sum": 0.004, "count": 1, "bucket_bounds": [1.0], "bucket_counts": [1]})
    assert metrics.merge_histograms(one).first()["sum"] == 0.004


def test_null_ids_are_not_lost(spark):
    spans = rows(spark, "traces", {"trace_id": "t", "span_id": "a"}, {"trace_id": "t", "span_id": "b", "parent_span_id": "a"}, {"trace_id": None, "span_id": "c", "parent_span_id": None})
    logs = rows(spark, "logs", {"trace_id": "t", "span_id": "a"}, {"trace_id": None, "span_id": "a"}, {"trace_id": "", "span_id": ""})
    assert traces.logs_with_spans(logs, spans).count() == 3
    assert traces.with_parent(spans).count() == 3
    triggers = rows(spark, "alert_triggers", {"incident_id": None}, {"incident_id": "i"})
    states = rows(spark, "incidents", {"incident_id": "i", "resolved_at": None, "labels": {"k": "v"}})
    assert incidents.triggers_with_incident(triggers, states).count() == 2
    assert incidents.uncorrelated_triggers(triggers).count() == 1


def test_null_values_do_not_hide_quantiles(spark):
    table = spark.createDataFrame([("g", 1), ("g", 2), ("g", 3), ("g", None), ("g", None), ("g", None)], "g string, v bigint")
    assert exact_quantiles(table, ["g"], "v", {"p50": 0.5}).first()["p50"] == 2
    spans = rows(spark, "traces", {"service_name": "s", "duration_ns": None})
    assert traces.red(spans).first()["spans"] == 1


def test_long_durations_and_empty_trace_ids(spark):
    spans = rows(spark, "traces", {"trace_id": "t", "duration_ns": 9 * 10**18}, {"trace_id": ""}, {"trace_id": ""})
    assert [(r.trace_id, int(r.wall_ns)) for r in traces.trace_summary(spans).collect()] == [("t", 9 * 10**18)]
    logs = rows(spark, "logs", {"trace_id": "", "severity": "ERROR"})
    assert traces.traces_with_errors(spans, logs, rows(spark, "ai_spans")).count() == 0


def test_the_whole_range_of_unsigned_integers(spark):
    top = 2**64 - 1
    spans = rows(
        spark, "traces", {"trace_id": "t", "span_id": "a", "service_name": "s", "duration_ns": top},
        {"trace_id": "t", "span_id": "b", "parent_span_id": "a", "service_name": "s", "duration_ns": top - 1},
        {"trace_id": "t", "span_id": "c", "parent_span_id": "a", "service_name": "s", "duration_ns": 3},
    )
    assert {(r.span_id, int(r.self_ns)) for r in traces.self_times(spans).collect()} == {("a", 0), ("b", top - 1), ("c", 3)}
    assert [int(traces.red(spans).first()[q]) for q in ("p50_ns", "p99_ns")] == [top - 1, top]
    assert int(traces.trace_summary(spans).first()["slowest_ns"]) == top
    assert [int(r.duration_ns) for r in topk.slowest_spans(spans, 2).orderBy("rank").collect()] == [top, top - 1]
    calls = rows(spark, "ai_spans", {"service_name": "s", "duration_ns": top}, {"service_name": "s", "duration_ns": top})
    assert usage.usage(calls).first()["mean_ms"] == round(top / 1e6, 3)
    two = rows(spark, "metrics", *[{"metric_type": "histogram", "count": top, "bucket_bounds": [1.0, 2.0], "bucket_counts": [top, top]}] * 2)
    merged = metrics.merge_histograms(two)
    assert [int(n) for n in merged.first()["bucket_counts"]] == [2 * top, 2 * top] and int(merged.first()["count"]) == 2 * top
    for cumulative in (True, False):
        assert 0 < metrics.histogram_quantiles(merged, {"p50": 0.5}, cumulative).first()["p50"] <= 1.0


def test_groups_with_a_null_key_have_quantiles(spark):
    table = spark.createDataFrame([("a", 1), (None, 5), (None, 7)], "g string, v bigint")
    assert {(r.g, r.p50) for r in exact_quantiles(table, ["g"], "v", {"p50": 0.5}).collect()} == {("a", 1), (None, 5)}
    assert exact_quantiles(table, [], "v", {"p50": 0.5}).first()["p50"] == 5


def test_one_join_tells_long_and_orphaned_spans(spark):
    spans = rows(
        spark, "traces", {"trace_id": "t", "span_id": "a", "duration_ns": 5}, {"trace_id": "t", "span_id": "b", "parent_span_id": "a", "duration_ns": 9},
        {"trace_id": "t", "span_id": "c", "parent_span_id": "z"},
    )
    found = quality.check_spans(spans)
    assert {(r["check"], r["row_id"]) for r in found.collect()} == {("longer_than_parent", "b"), ("missing_parent", "c")}


def test_whole_rows_come_back_with_their_maps(spark):
    states = rows(spark, "incidents", *({"incident_id": "i", "resolved_at": None, "timestamp": datetime(2024, 1, d), "labels": {"b": "2", "a": str(d)}} for d in (1, 3, 2)))
    assert incidents.latest_state(states).first()["labels"] == {"a": "3", "b": "2"}
    logs = rows(spark, "logs", {"log_id": "x", "body": "b", "attributes": {"k": 'quote " and é'}}, {"log_id": "x", "body": "a", "attributes": {}})
    assert dedup.earliest_per_id(logs, ["log_id"]).first()["body"] in ("a", "b")
    one = dedup.earliest_per_id(logs.filter("body = 'b'"), ["log_id"])
    assert one.first()["attributes"] == {"k": 'quote " and é'} and one.columns == logs.columns


def test_top_rows_beyond_the_limit_spark_applies(spark):
    table = spark.range(5000).selectExpr("'g' AS g", "id")
    got = topk.top_per_group(table, ["g"], [F.col("id").desc()], 1500, ["id"])
    assert sorted(r.id for r in got.collect()) == list(range(3500, 5000))


def test_impact_counts_rows_at_both_ends_and_no_nulls(spark):
    """Edges of an incident stand among the rows: one sort by service and hour, and no table by instant."""
    def at(second):
        return datetime(2024, 1, 1, 10, 0, second)

    spans = rows(
        spark, "traces", *[{"service_name": "s", "timestamp": at(n), "status_code": c} for n, c in ((9, "OK"), (10, "ERROR"), (10, "OK"), (20, None), (21, "ERROR"))],
        {"service_name": "s", "timestamp": datetime(2024, 1, 1, 8)}, {"service_name": None, "timestamp": at(15)}, {"service_name": "s", "timestamp": None},
    )
    lines = rows(spark, "logs", *[{"service_name": "s", "timestamp": at(n), "severity": "ERROR"} for n in (10, 20, 22)])
    states = rows(
        spark, "incidents", {"incident_id": "i", "service_name": "s", "timestamp": at(10), "resolved_at": at(20), "status": "resolved"},
        {"incident_id": "j", "service_name": "s", "timestamp": at(20), "resolved_at": None}, {"incident_id": "n", "service_name": None, "timestamp": at(10), "resolved_at": at(20)},
    )
    found = incidents.incident_impact(states, spans, lines, datetime(2024, 1, 2))
    got = {r.incident_id: (r.spans, r.error_spans, r.logs, r.error_logs) for r in found.collect()}
    assert got == {"i": (3, 1, 2, 2), "j": (2, 1, 2, 2), "n": (0, 0, 0, 0)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[service_name#\d+, _hour#\d+L?, at#", plan)
