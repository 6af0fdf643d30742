"""Time the headline queries and the ingest path; prints one JSON line.

The six signals are first written as day-partitioned tables, which is timed as
well; the queries then read those tables, as a user's would.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from datetime import datetime

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from spanloom.operators import (  # noqa: E402
    health, incidents, logvolume, metrics, panels, quality, sessions, topk, traces, usage,
)
from spanloom.session import build_session  # noqa: E402
from spanloom.signals import SIGNALS  # noqa: E402
from spanloom.sinks.tables import write_signal  # noqa: E402
from spanloom.sources import payloads  # noqa: E402
from spanloom.sources.sample_views import batch_load, sample_view  # noqa: E402
from spanloom.sources.tables import read_signal, time_range  # noqa: E402
from spanloom.streaming import ingest  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def queries(t: dict[str, DataFrame]) -> dict:
    """Name to a function that builds the query."""
    as_of = datetime(2024, 2, 1)
    return {
        "q1_total_tokens": lambda: panels.total_tokens(t["ai_spans"]),
        "q2_total_cost": lambda: panels.total_cost(t["ai_spans"]),
        "q3_total_logs": lambda: panels.total_logs(t["logs"]),
        "q4_total_spans": lambda: panels.total_spans(t["traces"]),
        "q5_recent_ai_spans": lambda: panels.recent_ai_spans(t["ai_spans"]),
        "q6_recent_logs": lambda: panels.recent_logs(t["logs"]),
        "q7_recent_spans": lambda: panels.recent_spans(t["traces"]),
        "q8_recent_incidents": lambda: panels.recent_incidents(t["incidents"]),
        "q9_recent_triggers": lambda: panels.recent_triggers(t["alert_triggers"]),
        "p4_time_range": lambda: time_range(t["logs"], datetime(2024, 1, 10), datetime(2024, 1, 12)),
        "j1_logs_with_spans": lambda: traces.logs_with_spans(t["logs"], t["traces"]),
        "j3_self_time": lambda: traces.self_times(t["traces"]),
        "j4_triggers_with_incident": lambda: incidents.triggers_with_incident(t["alert_triggers"], t["incidents"]),
        "j7_incident_impact": lambda: incidents.incident_impact(t["incidents"], t["traces"], t["logs"], as_of),
        "j8_errors_beside_metric": lambda: health.errors_beside_metric(t["traces"], t["metrics"], "events_total"),
        "j9_span_latest_metric": lambda: health.with_latest_metric(t["traces"], t["metrics"], "event_value_max", ["span_id"]),
        "a2_usage": lambda: usage.usage(t["ai_spans"]),
        "a4_log_volume": lambda: logvolume.log_volume(t["logs"]),
        "a5_red": lambda: traces.red(t["traces"]),
        "a6_trace_summary": lambda: traces.trace_summary(t["traces"]),
        "a7_service_edges": lambda: traces.service_edges(t["traces"]),
        "a11_histogram_quantile": lambda: metrics.histogram_quantiles(metrics.merge_histograms(t["metrics"]), {"p95": 0.95}),
        "a14_rule_alerts": lambda: incidents.rule_alerts(t["incidents"], t["alert_triggers"]),
        "w1_latest_state": lambda: incidents.latest_state(t["incidents"]),
        "w4_slowest_spans": lambda: topk.slowest_spans(t["traces"]),
        "w5_moving_error_ratio": lambda: health.moving_error_ratio(t["traces"]),
        "x6_error_bursts": lambda: sessions.error_bursts(t["logs"]),
        "d3_metric_arrays": lambda: quality.check_metric_arrays(t["metrics"]),
    }


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    started = time.perf_counter()
    action()
    return time.perf_counter() - started


def bench(spark: SparkSession) -> dict:
    folder = tempfile.mkdtemp(prefix="spanloom-bench-")
    load = batch_load(spark, SF_DIR)
    first, warm, rows = {}, {}, {}

    for name in SIGNALS:
        path = f"{folder}/{name}"
        first[f"write_{name}"] = warm[f"write_{name}"] = timed(
            lambda: write_signal(sample_view(name, load), name, path, "bench")
        )
    tables = {name: read_signal(spark, f"{folder}/{name}", name) for name in SIGNALS}
    rows = {name: df.count() for name, df in tables.items()}

    payload_dir = f"{folder}/payloads"
    payloads.encode(tables["traces"], "traces").select(F.col("json").alias("value")).repartition(int(CPUS)).write.text(payload_dir)
    first["ingest_traces"] = warm["ingest_traces"] = timed(
        lambda: ingest.ingest(
            spark, payload_dir, "traces", f"{folder}/in", f"{folder}/rejected", f"{folder}/cp", live=False
        ).awaitTermination()
    )
    for name, build in queries(tables).items():
        first[name] = timed(lambda: drain(build()))
        warm[name] = min(timed(lambda: drain(build())) for _ in range(max(RUNS - 1, 1)))
    return {
        "metric": "telemetry_queries_warm_total",
        "value": round(sum(warm.values()), 3),
        "unit": "sec",
        "queries": {k: round(v, 3) for k, v in warm.items()},
        "first_run": {k: round(v, 3) for k, v in first.items()},
        "rows": rows,
        "ingest_rows_per_second": round(rows["traces"] / warm["ingest_traces"]),
        "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": CPUS,
    }


def main() -> None:
    spark = build_session(
        "bench", f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS, spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    result = bench(spark)
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
