"""Streams: restart, replay, late rows, several micro-batches, stream = batch."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from spanloom.signals import SIGNALS
from spanloom.sources import payloads
from spanloom.sources.tables import read_signal
from spanloom.streaming import alerts, ingest, rollups, totals

START = datetime(2024, 3, 1)


def _lines(path, name, lines):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(lines) + "\n")


def _until(met, seconds=30):
    """Listeners hear of progress a little later."""
    import time

    end = time.monotonic() + seconds
    while not met() and time.monotonic() < end:
        time.sleep(0.1)
    assert met()


def _span(n, status="OK", minute=0, service="s"):
    at = (START + timedelta(minutes=minute, seconds=n % 60)).strftime("%Y-%m-%dT%H:%M:%SZ")
    return f'{{"timestamp":"{at}","trace_id":"t{n}","span_id":"s{n}","service_name":"{service}","status_code":"{status}"}}'


def test_ingest_restarts_where_it_stopped(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")

    def run():
        query = ingest.ingest(spark, str(source), "traces", f"{out}/table", f"{out}/rejected", f"{out}/cp", live=False)
        query.awaitTermination()
        return query

    _lines(source, "a.json", [_span(n) for n in range(5)] + ["{bad", f"[{_span(90)},{_span(91)}]"])
    query = run()
    assert read_signal(spark, f"{out}/table", "traces").count() == 7
    assert query.lastProgress["observedMetrics"]["intake"]["accepted"] == 7
    run()
    assert read_signal(spark, f"{out}/table", "traces").count() == 7
    _lines(source, "b.json", [_span(n) for n in range(10, 13)])
    run()
    assert read_signal(spark, f"{out}/table", "traces").count() == 10
    rejected = spark.read.parquet(f"{out}/rejected").collect()
    assert [(r["signal"], r["status"], r["value"]) for r in rejected] == [("traces", "invalid_json", "{bad")]


def test_bytes_bound_a_micro_batch(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    for n in range(3):
        _lines(source, f"{n}.json", [_span(n)])
    query = ingest.ingest(
        spark, str(source), "traces", f"{out}/table", f"{out}/rejected", f"{out}/cp", live=False, max_bytes_per_trigger="1"
    )
    query.awaitTermination()
    assert read_signal(spark, f"{out}/table", "traces").count() == 3
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 3


def _span_stream(spark, path, files_per_batch=1):
    schema = SIGNALS["traces"].schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(str(path))


def _write_spans(spark, path, batches):
    """One file per batch, taken in order of their modification time."""
    import time

    for rows in batches:
        full = [(f"t{n}", f"s{n}", "", at, service, "op", "SERVER", Decimal(1), status, {}) for n, (at, service, status) in enumerate(rows)]
        spark.createDataFrame(full, SIGNALS["traces"].schema).coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(0.05)


def _minutes(errors_by_minute, service="s"):
    """Four spans a minute, some of them failed."""
    return [
        (START + timedelta(minutes=m, seconds=10 * k), service, "ERROR" if k < bad else "OK")
        for m, bad in errors_by_minute for k in range(4)
    ]


def test_rule_fires_once_per_run_across_micro_batches(spark, tmp_path):
    # Minutes 2-5 breach (one run), 8 alone does not hold, 11-12 are a second run.
    errors = {2: 4, 3: 3, 4: 4, 5: 4, 8: 4, 11: 3, 12: 4}
    minutes = [(m, errors.get(m, 0)) for m in range(40)]
    batches = [_minutes(minutes[i : i + 2]) for i in range(0, 40, 2)]
    _write_spans(spark, tmp_path / "in", batches)
    out = str(tmp_path / "out")
    alerts.evaluate_rule(
        spark, _span_stream(spark, tmp_path / "in", 3), "r", 0.5, 2, f"{out}/buckets", f"{out}/triggers", f"{out}/cp",
        delay="2 minutes", live=False,
    ).awaitTermination()
    fired = read_signal(spark, f"{out}/triggers", "alert_triggers").orderBy("timestamp").collect()
    assert [r["timestamp"] for r in fired] == [START + timedelta(minutes=4), START + timedelta(minutes=13)]
    assert [r["trigger_count"] for r in fired] == [7, 7]


def test_late_rows_are_left_out_and_counted(spark, tmp_path):
    _write_spans(
        spark, tmp_path / "in",
        # Rows count as late once a whole batch has run under the watermark they are behind.
        [_minutes([(0, 1), (1, 1)]), _minutes([(30, 0)]), _minutes([(31, 0)]), _minutes([(1, 4)]), _minutes([(60, 0)])],
    )
    out, counters = str(tmp_path / "out"), ingest.Counters()
    spark.streams.addListener(counters)
    try:
        query = rollups.append_to(
            rollups.red_windows(_span_stream(spark, tmp_path / "in"), delay="5 minutes"), f"{out}/rows", f"{out}/cp", live=False
        )
        query.awaitTermination()
        _until(lambda: counters.of(query)["rows"] == 24)
    finally:
        spark.streams.removeListener(counters)
    rows = {r["window_start"]: r["spans"] for r in spark.read.parquet(f"{out}/rows").collect()}
    assert rows == {START + timedelta(minutes=m): 4 for m in (0, 1, 30, 31)}
    # One partial row per window and service reaches the state operator.
    assert counters.of(query)["late"] >= 1


def test_equal_lines_get_ids_of_their_own_and_keep_them(spark, tmp_path):
    source, out, counters = tmp_path / "in", str(tmp_path / "out"), ingest.Counters()
    line = f'{{"timestamp":"{START:%Y-%m-%dT%H:%M:%SZ}","service_name":"s","body":"again"}}'
    _lines(source, "a.json", [line] * 5 + [line.replace("again", "once"), "{bad", "{bad"])
    spark.streams.addListener(counters)
    ids = []
    try:
        for n in range(2):  # a new stream over the same files stands for a replay
            query = ingest.ingest(spark, str(source), "logs", f"{out}/t{n}", f"{out}/r{n}", f"{out}/cp{n}", live=False)
            query.awaitTermination()
            ids.append(sorted(r["log_id"] for r in read_signal(spark, f"{out}/t{n}", "logs").collect()))
            assert len({r["payload_id"] for r in spark.read.parquet(f"{out}/r{n}").collect()}) == 2
        _until(lambda: counters.of(query)["payloads"] == 8)
        assert counters.of(query)["accepted"] == 6
    finally:
        spark.streams.removeListener(counters)
    assert len(set(ids[0])) == 6 and ids[0] == ids[1]
    read = payloads.accepted_rows(payloads.decode(payloads.read_payloads(spark, str(source)), "logs"), "logs")
    assert sorted(r["log_id"] for r in read.collect()) == ids[0]


def test_totals_grow_with_each_run(spark, tmp_path):
    out = str(tmp_path / "out")
    for n, want in ((0, 8), (1, 16), (2, 24), (3, 32), (4, 40)):
        _write_spans(spark, tmp_path / "in", [_minutes([(n, 1), (n + 1, 1)])])
        total = _span_stream(spark, tmp_path / "in").agg(F.count(F.lit(1)).alias("spans"))
        totals.keep_total(total, f"{out}/rows", f"{out}/cp", live=False).awaitTermination()
        assert totals.latest_total(spark, f"{out}/rows").first()["spans"] == want
    assert len(totals._snapshots(spark, f"{out}/rows")) == totals.KEPT


def test_stream_equals_batch_over_many_batches(spark, tmp_path):
    minutes = [(m, m % 4) for m in range(30)]
    _write_spans(spark, tmp_path / "in", [_minutes(minutes[i : i + 5]) for i in range(0, 30, 5)])
    out = str(tmp_path / "out")
    rollups.append_to(
        rollups.red_windows(_span_stream(spark, tmp_path / "in", 2), "5 minutes", "1 minute", "1 minute"),
        f"{out}/rows", f"{out}/cp", live=False,
    ).awaitTermination()
    stored = spark.read.schema(SIGNALS["traces"].schema).parquet(str(tmp_path / "in"))
    batch = rollups.red_windows(stored, "5 minutes", "1 minute", "1 minute")
    closed = START + timedelta(minutes=29, seconds=30) - timedelta(minutes=1)
    want = batch.filter(F.col("window_end") <= F.lit(closed).cast("timestamp"))
    got = spark.read.parquet(f"{out}/rows").select(*want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_dedup_over_batches(spark, tmp_path):
    rows = _minutes([(0, 0), (1, 0)])
    _write_spans(spark, tmp_path / "in", [rows, rows, rows])
    out = str(tmp_path / "out")
    rollups.append_to(
        ingest.dedup_by_id(_span_stream(spark, tmp_path / "in"), ["span_id"], "10 minutes"), f"{out}/rows", f"{out}/cp", live=False
    ).awaitTermination()
    assert spark.read.parquet(f"{out}/rows").count() == len(rows)


def test_tables_of_many_files_stream_as_one_file_does(spark, tmp_path):
    """A table may be a folder of files instead of one file."""
    from spanloom.plans import catalog

    turns = [(c, t, "user" if t % 2 else "assistant", "x" * (c + t)) for c in range(8) for t in range(3)]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    table.repartition(3).write.parquet(str(tmp_path / "many" / "conversations.parquet"))
    table.coalesce(1).write.parquet(str(tmp_path / "parts"))
    (tmp_path / "one").mkdir()
    next((tmp_path / "parts").glob("*.parquet")).rename(tmp_path / "one" / "conversations.parquet")
    many, one = (catalog.run("q10_live_panels", spark, str(tmp_path / f)).collect() for f in ("many", "one"))
    assert many == one and many[0]["calls"] == 24 and many[0]["total_tokens"] == sum(c + t for c, t, _, _ in turns)


def test_payload_files_of_a_bounded_batch_do_not_grow(spark, monkeypatch):
    from spanloom.plans import catalog

    monkeypatch.setattr(catalog, "_LINES_PER_FILE", 500)
    made, real = [], catalog._payload_files
    monkeypatch.setattr(catalog, "_payload_files", lambda i, df: made.append(real(i, df)) or made[-1])
    n = catalog.run("x2_bounded_intake", spark, SMALL).first()["n_rows"]
    files = {r["f"]: r["count"] for r in spark.read.text(made[0]).groupBy(F.input_file_name().alias("f")).count().collect()}
    assert sum(files.values()) == n > 4 * 1000 and max(files.values()) < 1000


def test_payloads_of_the_durable_counters_are_decoded_by_the_stream_alone(spark, monkeypatch):
    from spanloom.plans import catalog

    batch, real = [], catalog.payloads.decode
    monkeypatch.setattr(catalog.payloads, "decode", lambda df, signal: batch.append(signal) or real(df, signal))
    got = {r["name"]: r["n"] for r in catalog.run("x9_durable_counters", spark, SMALL).collect()}
    assert not batch and got["payloads"] == got["payloads_ok"] + got["payloads_empty"] + got["payloads_bad_timestamp"] + got["payloads_invalid_json"]


def test_ids_of_an_ingest_are_counted_without_moving_its_rows(spark, monkeypatch):
    """Payload files are compressed and small, copies of a line stand in one file, and the rows are not shuffled for the count."""
    from spanloom.plans import catalog

    sources = []
    monkeypatch.setattr(catalog, "_LINES_PER_PACKED_FILE", 100)
    monkeypatch.setattr(catalog, "_payload_files", lambda *a, _f=catalog._payload_files, **k: sources.append(_f(*a, **k)) or sources[0])
    found = catalog.run("x1_ingest_stream", spark, SMALL)
    assert found.filter("rows_of_id <> 1").isEmpty() and "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    lines = spark.read.text(sources[0]).groupBy(F.input_file_name().alias("file"), "value").count()
    assert {r["count"] for r in lines.select("count").distinct().collect()} == {2}
    assert lines.filter("file NOT LIKE '%.gz'").isEmpty() and lines.groupBy("file").agg(F.sum("count").alias("n")).filter("n > 100").isEmpty()


@pytest.mark.parametrize("name", ["x2_bounded_intake", "x9_durable_counters"])
def test_payload_files_of_a_stream_are_compressed_and_bounded(spark, monkeypatch, name):
    from spanloom.plans import catalog

    sources, real = set(), catalog.ingest.ingest
    monkeypatch.setattr(catalog, "_LINES_PER_FILE", 700)
    monkeypatch.setattr(catalog.ingest, "ingest", lambda s, source, *a, **k: sources.add(source) or real(s, source, *a, **k))
    catalog.run(name, spark, SMALL).collect()
    files = spark.read.text(sources.pop()).groupBy(F.input_file_name().alias("file")).count().collect()
    assert not sources and len(files) > 7 and all(r["file"].endswith(".gz") and r["count"] <= 700 for r in files)


def test_a_stream_deals_out_lines_of_compressed_files_and_leaves_no_shuffle_files(spark, tmp_path):
    t = '"timestamp":"2024-01-10T12:00:00Z"'
    lines = [f'{{{t},"span_id":"s{n}"}}' for n in range(400)] + [f'{{{t},"span_id":{n % 7}}}' for n in range(50)]
    spark.createDataFrame([(x,) for x in lines], "value string").repartition(3).write.option("compression", "gzip").text(str(tmp_path / "in"))
    spark._jvm.System.gc()
    held = lambda: {f.getName() for f in _java_list(spark, spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before, out = held(), tmp_path / "out"
    run = ingest.ingest(spark, str(tmp_path / "in"), "traces", str(out / "t"), str(out / "r"), str(out / "c"), live=False, max_files_per_trigger=1, spread=True)
    run.awaitTermination()
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(run._jsq.streamingQuery().lastExecution(), "simple")
    assert "REBALANCE_PARTITIONS_BY_COL" in plan
    _until(lambda: not held() - before)  # files are deleted beside the driver's work
    assert read_signal(spark, str(out / "t"), "traces").select("span_id").distinct().count() == 400
    assert spark.read.parquet(str(out / "r")).select("payload_id").distinct().count() == 50


def _java_list(spark, seq):
    return list(spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(seq))


def test_only_ids_that_are_named_are_numbered(spark, tmp_path, monkeypatch):
    """Rows with ids of their own need no number for their payload; equal lines without stay apart."""
    t = '"timestamp":"2024-01-10T12:00:00Z"'
    own, nil = "6ba7b810-9dad-11d1-80b4-00c04fd430c8", "00000000-0000-0000-0000-000000000000"
    sent = {
        "traces": [f'{{{t},"span_id":"a"}}'] * 3 + ['{"span_id":7}'] * 3,
        "alert_triggers": [f'{{{t},"trigger_id":"{own}"}}'] * 3 + [f'{{{t}}}'] * 3 + [f'[{{{t},"trigger_id":"{own}"}},{{{t},"trigger_id":"{nil}"}}]'] * 3 + ["[]"] * 3,
        "logs": [f'{{{t}}}'] * 3,
    }
    counted, real = [], ingest.number_copies
    monkeypatch.setattr(ingest, "number_copies", lambda df, named: counted.append(df.filter(named).count()) or real(df, named))
    for signal, lines in sent.items():
        (tmp_path / signal).mkdir()
        (tmp_path / signal / "a.json").write_text("\n".join(lines) + "\n")
        out = tmp_path / "out" / signal
        ingest.ingest(spark, str(tmp_path / signal), signal, str(out / "t"), str(out / "r"), str(out / "c"), live=False).awaitTermination()
    assert counted == [3, 9, 3]
    tables = {s: read_signal(spark, str(tmp_path / "out" / s / "t"), s) for s in sent}
    assert tables["traces"].count() == 3
    ids = [r["trigger_id"] for r in tables["alert_triggers"].collect()]
    assert ids.count(own) == 6 and nil not in ids and len(ids) == 12 and len(set(ids)) == 7
    assert tables["logs"].select("log_id").distinct().count() == 3
    for signal in ("traces", "alert_triggers"):
        assert spark.read.parquet(str(tmp_path / "out" / signal / "r")).select("payload_id").distinct().count() == 3


def test_batches_of_the_ingest_of_small_files_are_bounded(spark, monkeypatch):
    from spanloom.plans import catalog

    runs, real = [], catalog.ingest.ingest
    monkeypatch.setattr(catalog, "_LINES_PER_PACKED_FILE", 100)
    monkeypatch.setattr(catalog, "_PACKED_FILES_PER_BATCH", 6)
    monkeypatch.setattr(catalog.ingest, "ingest", lambda *a, **k: runs.append(real(*a, **k)) or runs[-1])
    found = catalog.run("x1_ingest_stream", spark, SMALL)
    n = found.count()
    assert n > 1000 and found.filter("rows_of_id <> 1").isEmpty()
    batches = [p["numInputRows"] for p in runs[0].recentProgress if p["numInputRows"]]
    assert sum(batches) == n and max(batches) <= 600 and not [p for p in runs[1].recentProgress if p["numInputRows"]]
