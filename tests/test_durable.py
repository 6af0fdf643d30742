"""Counters that outlive a driver, work folders that go, tables laid out for their questions."""

import glob
import os
import re
import time
from datetime import datetime, timedelta

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from spanloom.functions import folders, spread
from spanloom.operators import sketches, traces
from spanloom.plans import catalog
from spanloom.plans.catalog import Inputs
from spanloom.session import temporary, work_folder, written
from spanloom.sinks import counters as counting
from spanloom.sinks import colocated, upkeep
from spanloom.sinks.colocated import read_by_trace, write_by_trace
from spanloom.sinks.counters import CounterTable
from spanloom.sinks.tables import write_signal
from spanloom.sources import payloads
from spanloom.sources.tables import count_rows, days_between, read_range, read_signal, time_range
from spanloom.streaming import ingest

AT = datetime(2024, 1, 10, 12)


@pytest.fixture(scope="module")
def inputs(spark):
    return Inputs(spark, SMALL)


def totals(table):
    return {(r["query"], r["name"]): r["n"] for r in table.totals().collect()}


def test_a_replayed_batch_counts_once_and_folding_changes_nothing(spark, tmp_path):
    table = CounterTable(spark, str(tmp_path / "c"), fold_after=5)
    assert totals(table) == {}
    for batch in range(20):
        for again in (99, batch):  # the first try had other numbers
            table.put("q", batch, rows=again, late=1)
    table.put("other", 0, rows=7)
    want = {("q", "rows"): sum(range(20)), ("q", "late"): 20, ("other", "rows"): 7}
    assert totals(table) == want and totals(CounterTable(spark, str(tmp_path / "c"))) == want
    assert len(os.listdir(tmp_path / "c" / "q")) < 20
    table.put("q", 0, rows=10**6)  # long folded: its rows are in the sum
    assert totals(table) == want


@pytest.mark.parametrize("after", [0, 1, 3])
def test_a_fold_that_stops_half_way_loses_nothing(spark, tmp_path, monkeypatch, after):
    table = CounterTable(spark, str(tmp_path / "c"), fold_after=100)
    for batch in range(6):
        table.put("q", batch, rows=batch)
    table.fold("q", keep=4)
    calls = []

    def dies(session, path):
        calls.append(path)
        if len(calls) > after:
            raise KeyboardInterrupt
        folders.delete(session, path)

    monkeypatch.setattr(counting, "delete", dies)
    with pytest.raises(KeyboardInterrupt):
        table.fold("q", keep=1)
    assert totals(table) == {("q", "rows"): 15}
    monkeypatch.setattr(counting, "delete", folders.delete)
    table.put("q", 6, rows=1)
    table.fold("q", keep=1)
    assert totals(table) == {("q", "rows"): 16}


def _spans(spark, folder, minutes):
    rows = [(AT + timedelta(minutes=m), f"s{m}") for m in minutes]
    spark.createDataFrame(rows, "timestamp timestamp, span_id string").coalesce(1).write.mode("append").parquet(str(folder))


def test_late_rows_are_counted_over_restarts(spark, tmp_path):
    table = CounterTable(spark, str(tmp_path / "counters"))
    source, out = tmp_path / "in", str(tmp_path / "out")
    seen = []
    for minutes in ([0, 60], [61], [1, 62], [2, 3, 63], [120]):
        _spans(spark, source, minutes)
        listener = ingest.Counters(table)
        spark.streams.addListener(listener)
        try:
            stream = spark.readStream.schema("timestamp timestamp, span_id string").parquet(str(source))
            counts = ingest.dedup_by_id(stream, ["span_id"], "5 minutes")
            query = counts.writeStream.option("checkpointLocation", f"{out}/cp").trigger(availableNow=True).format("noop").start()
            query.awaitTermination()
            for _ in range(300):  # listeners hear of progress a little later
                if listener.of(query)["rows"] >= len(minutes):
                    break
                time.sleep(0.1)
        finally:
            spark.streams.removeListener(listener)
        seen.append({name: n for (_, name), n in totals(table).items()})
    assert [s["rows"] for s in seen] == [2, 3, 5, 8, 9]
    assert seen[-1]["late"] == 3 and len(table.rows().select("query").distinct().collect()) == 1


def test_micro_batches_leave_no_work_folder(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    line = '{"timestamp":"2024-01-10T12:00:00Z","service_name":"s","body":"again"}'
    for n in range(8):
        (source / f"f{n}.json").write_text(f"{line}\n{line}\n{{bad\n{{bad\n")
    base = os.path.dirname(work_folder(spark, "x"))
    before = set(folders.names_in(spark, base))
    out = str(tmp_path / "out")
    ingest.ingest(spark, str(source), "logs", f"{out}/t", f"{out}/r", f"{out}/cp", live=False, max_files_per_trigger=1, counters=f"{out}/c").awaitTermination()
    assert set(folders.names_in(spark, base)) == before
    assert read_signal(spark, f"{out}/t", "logs").select("log_id").distinct().count() == 16
    got = {name: n for (_, name), n in totals(CounterTable(spark, f"{out}/c")).items()}
    assert got == {"payloads": 32, "payloads_ok": 16, "payloads_invalid_json": 16, "accepted": 16, "rejected": 0}
    assert len(glob.glob(f"{out}/c/*/batch-*.json")) == 8


def test_temporary_tables_go_with_their_block(spark):
    outer = written(spark.range(3), "kept")
    with temporary(spark):
        inner = written(spark.range(4), "gone")
        assert inner.count() == 4
        path = inner.inputFiles()[0].rsplit("/", 1)[0]
    assert not folders.names_in(spark, path) and outer.count() == 3


def test_a_hot_key_is_split_while_the_join_runs(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        left = spark.range(0, 300_000, 1, 12).selectExpr("id", "CASE WHEN id % 3 < 2 THEN 'hot' ELSE concat('k', id % 999) END AS k", "md5(string(id)) AS body")
        right = spark.range(1000).selectExpr("concat('k', id) AS k", "id AS v").unionByName(spark.range(1).selectExpr("'hot' AS k", "-1L AS v"))
        joined = spread.lookup_join(left, right, ["k"]).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        got = {r["v"]: r["n"] for r in joined.collect()}
        assert got[-1] == 200_000 and sum(got.values()) == 300_000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_on_trace_ids_move_nothing(spark, inputs, tmp_path):
    names = {s: write_by_trace(inputs.view(s), s, str(tmp_path / s), buckets=4) for s in ("traces", "ai_spans", "logs")}
    spans, calls, logs = (read_by_trace(spark, names[s]) for s in ("traces", "ai_spans", "logs"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (traces.self_times(spans), traces.with_parent(spans), traces.trace_summary(spans), traces.ai_spans_with_trace(calls, spans),
                   traces.logs_with_spans(logs, spans), traces.orphan_spans(spans)):
            assert not re.search(r"\bExchange\b", plan(df)), plan(df)
        assert traces.self_times(spans).count() == inputs.traces.count()
        key = ["trace_id", "span_id", "parent_service_name"]
        got, want = (sorted(map(tuple, traces.with_parent(t).select(*key).na.fill("").collect())) for t in (spans, inputs.traces))
        assert got == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_counts_come_from_footers(spark, inputs, tmp_path):
    path = str(tmp_path / "traces")
    write_signal(inputs.traces, "traces", path, "b")
    counts = count_rows(spark, path, "traces")
    assert "PushedAggregation: [COUNT(*)]" in plan(counts) and "PushedGroupBy: [dt, batch]" in plan(counts)
    assert {r["dt"]: r["n"] for r in counts.collect()} == {r["dt"]: r["count"] for r in read_signal(spark, path, "traces").groupBy("dt").count().collect()}
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")


def test_a_range_lists_only_its_days(spark, inputs, tmp_path):
    assert days_between(spark, datetime(2024, 2, 28, 23), datetime(2024, 3, 1)) == [20240228, 20240229]
    assert days_between(spark, AT, AT) == [] and days_between(spark, AT, AT - timedelta(days=2)) == []
    path = str(tmp_path / "logs")
    write_signal(inputs.logs, "logs", path, "b")
    for day in range(2000):  # an old table: empty folders would be listed by a read of all days
        os.makedirs(f"{path}/dt={19900000 + day}/batch=old")
    start, end = datetime(2024, 1, 10, 6), datetime(2024, 1, 12, 18, 30)
    some = read_range(spark, path, "logs", start, end)
    assert {re.search(r"dt=(\d+)", f).group(1) for f in some.inputFiles()} == {"20240110", "20240111", "20240112"}
    assert some.count() == time_range(inputs.logs, start, end).count() > 0


def test_a_busy_service_is_split_into_ranges(spark, tmp_path):
    path = str(tmp_path / "traces")
    rows = spark.range(30_000).selectExpr(
        "md5(string(id)) AS trace_id", "string(id) AS span_id", "'' AS parent_span_id",
        "timestamp_seconds(1704880800 + id % 3000) AS timestamp", "CASE WHEN id % 10 < 8 THEN 'busy' ELSE concat('svc-', id % 5) END AS service_name",
        "'op' AS operation_name", "'k' AS span_kind", "id AS duration_ns", "'OK' AS status_code", "map('a', string(id)) AS attributes",
    )
    for n in range(3):
        write_signal(rows.filter(F.col("duration_ns") % 3 == n), "traces", path, f"b{n}")
    dt = upkeep.table_days(spark, path)[0]
    wanted = upkeep.planned_files(spark, path, dt, file_bytes=100_000)
    assert wanted > 4 and upkeep.planned_files(spark, path, dt) == 1
    assert upkeep.day_layout(spark, path, "traces").first()["ranges_disjoint"] is False
    upkeep.compact_day(spark, path, "traces", dt, files=wanted)
    layout = upkeep.day_layout(spark, path, "traces", [dt]).first()
    assert layout["ranges_disjoint"] and wanted - 1 <= layout["files"] <= wanted
    busy = read_signal(spark, path, "traces").filter("service_name = 'busy'").groupBy(F.input_file_name().alias("f")).count().collect()
    assert len(busy) > wanted // 2 and max(r["count"] for r in busy) < 12_000


def test_sketches_of_days_merge(spark, inputs):
    days = sketches.red_by_day(inputs.traces)
    exact = {(r["service_name"], r["operation_name"]): (r["spans"], r["errors"], r["error_ratio"]) for r in traces.red(inputs.traces).collect()}
    merged = {(r["service_name"], r["operation_name"]): (r["spans"], r["errors"], r["error_ratio"]) for r in sketches.red_over(days).collect()}
    assert merged == exact
    one = days.filter("dt = 20240110")
    assert {r["spans"] for r in sketches.red_over(one).collect()} == {r["spans"] for r in one.collect()}


def test_plain_payloads_and_others_are_judged_alike(spark, monkeypatch):
    """The shortcut by type signature gives what judging field by field gives."""
    t = '"timestamp":"2024-01-10T12:00:00Z"'
    texts = [
        f"{{{t}}}", f"[{{{t}}},{{{t},\"duration_ns\":5}}]", f"[{{{t}}},null]", f'{{{t},"attributes":{{"a":"1","a":"2","b":null}}}}', f'{{{t},"attributes":{{}}}}',
        f'{{{t},"attributes":{{"odd <key>, x":"1"}}}}', f'{{{t},"attributes":null,"span_id":null,"duration_ns":null}}', f'{{{t},"duration_ns":-5}}',
        f'{{{t},"duration_ns":{2**63}}}', f'{{{t},"extra":1}}', f'{{{t},"Span_Id":"s"}}', '{"timestamp":"2024-01-10"}', '{"timestamp":"2024-02-30T00:00:00Z"}',
        '{"span_id":"a"}', '{"timestamp":null}', f"{{{t}}} trailing", f'{{{t},"attributes":{{"a":[1]}}}}', f'[{{{t}}},{{"span_id":"b"}}]', f'{{{t},"span_id":7}}',
        f'{{{t},"span_id":"a","span_id":"b"}}', f'{{{t},"attributes":{{"a.b-c_9":"x"}}}}', "[]", "null", "{}", "[{}]", f"[[{{{t}}}]]",
    ]
    metrics = [
        f'{{{t},"bucket_bounds":[1,2.5,null],"bucket_counts":[1,null,3],"value":1e400}}', f'{{{t},"bucket_bounds":[1,1e400]}}', f'{{{t},"bucket_counts":[1,-1]}}',
        f'{{{t},"quantiles":[],"sum":7,"count":3,"value":-0.5}}', f'{{{t},"bucket_bounds":null,"labels":{{"k":null}}}}', f'{{{t},"bucket_counts":[1,2.0]}}',
    ]
    incidents = [
        f'{{{t},"incident_id":"6BA7B8109DAD11D180B400C04FD430C8","resolved_at":"2024-01-11T00:00:00+02:00"}}', f'{{{t},"incident_id":"x"}}', f'{{{t},"resolved_at":null}}',
        f'{{{t},"resolved_at":"never"}}', f'{{{t},"incident_id":null}}',
    ]
    calls = [f'{{{t},"prompt_tokens":4294967295}}', f'{{{t},"prompt_tokens":4294967296}}', f'{{{t},"total_tokens":-1}}', f'{{{t},"cost_usd":0.25,"total_tokens":7}}']
    for signal, values in (("traces", texts), ("metrics", metrics), ("incidents", incidents), ("ai_spans", calls)):
        sent = spark.createDataFrame([(f"p{n}", "t", v) for n, v in enumerate(values)], "payload_id string, source string, value string")
        outcome = lambda: (sorted(map(repr, payloads.payload_counts(payloads.decode(sent, signal)).collect())), sorted(map(repr, payloads.accepted_rows(payloads.decode(sent, signal), signal).collect())))
        short = outcome()
        monkeypatch.setattr(payloads, "plain_signature", lambda spec: "^never$")
        assert short == outcome()
        monkeypatch.undo()


def test_buckets_by_trace_grow_with_the_spans(spark, inputs, monkeypatch):
    assert [colocated.buckets_for(n) for n in (0, 1, 10**6, 10**6 + 1, 45 * 10**6, 270 * 10**6)] == [1, 1, 1, 2, 64, 512]
    monkeypatch.setattr(colocated, "BUCKET_ROWS", inputs.traces.count() // 20)
    for name in ("j3_self_time_by_trace", "j2_ai_spans_with_trace_by_trace"):
        made = catalog.run(name, spark, SMALL)
        assert len({int(re.search(r"_(\d{5})\.", f).group(1)) for f in made.inputFiles()}) > 8


def test_summaries_of_gathered_spans_move_narrow_rows_and_split_a_giant_trace(spark, inputs, monkeypatch):
    shown = ["trace_id", "spans", "roots", "wall_ns", "root_service", "slowest_span_id", "has_error", "services"]
    giant = inputs.traces.withColumn("trace_id", F.when(F.ascii("span_id") % 3 > 0, F.lit("giant")).otherwise(F.col("trace_id")))
    for spans in (inputs.traces, giant):
        got, want = (sorted(map(repr, traces.trace_summary(spans, gather=g).select(*shown).collect())) for g in (True, False))
        assert got == want
    text = plan(traces.trace_summary(giant, gather=True))
    first = text.index("REBALANCE_PARTITIONS_BY_COL")
    assert "partial_max_by" in text[:first] and "partial_max_by" not in text[first:]  # parts are aggregated after the move
    assert "attributes" not in text[first:] and "hashpartitioning(trace_id" in text[:first]
