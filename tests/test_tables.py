"""Tables on disk: append, replay, pruning, compaction, retention, empty inputs."""

import glob
from datetime import datetime

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from spanloom.operators import panels
from spanloom.plans.catalog import Inputs
from spanloom.signals import SIGNALS
from spanloom.sinks import upkeep
from spanloom.sinks.tables import gathered_by_day, with_day, write_signal
from spanloom.sources.tables import read_signal, time_range


@pytest.fixture(scope="module")
def inputs(spark):
    return Inputs(spark, SMALL)


def test_append_and_replay(spark, inputs, tmp_path):
    path = str(tmp_path / "logs")
    n = inputs.logs.count()
    write_signal(inputs.logs, "logs", path, "b1")
    write_signal(inputs.logs, "logs", path, "b1")  # the same batch again
    assert read_signal(spark, path, "logs").count() == n
    write_signal(inputs.logs, "logs", path)  # another one
    assert read_signal(spark, path, "logs").count() == 2 * n
    assert read_signal(spark, path, "logs").columns == [*SIGNALS["logs"].columns, "dt"]


def test_files_are_sorted_by_the_sort_key(spark, inputs, tmp_path):
    path = str(tmp_path / "traces")
    write_signal(inputs.traces, "traces", path, "b")
    upkeep.compact_day(spark, path, "traces", 20240101)
    for file in glob.glob(f"{path}/dt=*/batch=*/*.parquet")[:5]:
        rows = [tuple(r) for r in spark.read.parquet(file).select("service_name", "timestamp", "trace_id").collect()]
        assert rows == sorted(rows)


def test_a_day_that_holds_most_rows_is_split(spark, inputs, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64KB")
    try:
        one_day = inputs.logs.withColumn("timestamp", F.lit(datetime(2024, 1, 5)).cast("timestamp"))
        path = str(tmp_path / "logs")
        write_signal(one_day.repartition(8), "logs", path, "b")
        assert len(glob.glob(f"{path}/dt=20240105/batch=b/*.parquet")) > 1
        assert read_signal(spark, path, "logs").count() == one_day.count()
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_compaction_keeps_rows_and_lessens_files(spark, inputs, tmp_path):
    path = str(tmp_path / "traces")
    for n in range(4):
        write_signal(inputs.traces.filter(F.pmod(F.crc32("span_id"), F.lit(4)) == n), "traces", path, f"b{n}")
    before = sorted(map(repr, read_signal(spark, path, "traces").filter("dt = 20240110").collect()))
    for _ in range(2):  # again on a compacted day
        upkeep.compact_day(spark, path, "traces", 20240110, files=1)
        day = read_signal(spark, path, "traces").filter("dt = 20240110")
        assert sorted(map(repr, day.collect())) == before
        assert len(glob.glob(f"{path}/dt=20240110/batch=*/*.parquet")) == 1
    assert read_signal(spark, path, "traces").count() == inputs.traces.count()


def _ids(spark, path, dt=20240110):
    spark.catalog.refreshByPath(path)
    return sorted(r["span_id"] for r in read_signal(spark, path, "traces").filter(F.col("dt") == dt).collect())


def test_a_label_replayed_after_compaction_adds_no_rows(spark, inputs, tmp_path):
    path = str(tmp_path / "traces")
    write_signal(inputs.traces, "traces", path, "b:1")
    upkeep.compact_day(spark, path, "traces", 20240110, files=1)
    write_signal(inputs.traces, "traces", path, "b:1")
    spark.catalog.refreshByPath(path)
    assert read_signal(spark, path, "traces").count() == inputs.traces.count()
    write_signal(inputs.traces, "traces", path, "b2")  # another label is another batch
    spark.catalog.refreshByPath(path)
    assert read_signal(spark, path, "traces").count() == 2 * inputs.traces.count()
    upkeep.compact_day(spark, path, "traces", 20240110, files=1)
    write_signal(inputs.traces, "traces", path, "b:1")
    spark.catalog.refreshByPath(path)
    assert read_signal(spark, path, "traces").count() == 2 * inputs.traces.count()


@pytest.mark.parametrize("stop", ["staged", "switched", "deleting"])
def test_a_compaction_that_stops_loses_nothing(spark, inputs, tmp_path, monkeypatch, stop):
    path = str(tmp_path / "traces")
    for n in range(3):
        write_signal(inputs.traces.filter(F.pmod(F.crc32("span_id"), F.lit(3)) == n), "traces", path, f"b{n}")
    before = _ids(spark, path)
    mark, delete, calls = upkeep.mark, upkeep.delete, []

    def dies(at, real):
        def step(session, what):
            calls.append(what)
            if len([c for c in calls if at(c)]):
                raise KeyboardInterrupt
            real(session, what)

        return step

    if stop == "staged":  # the copy is written, readers not switched
        monkeypatch.setattr(upkeep, "mark", dies(lambda c: c.endswith(".switched"), mark))
    elif stop == "switched":  # no old folder deleted yet
        monkeypatch.setattr(upkeep, "delete", dies(lambda c: True, delete))
    else:  # one of them deleted
        monkeypatch.setattr(upkeep, "delete", dies(lambda c: c.endswith("batch=b1"), delete))
    with pytest.raises(KeyboardInterrupt):
        upkeep.compact_day(spark, path, "traces", 20240110, files=1)
    monkeypatch.setattr(upkeep, "mark", mark)
    monkeypatch.setattr(upkeep, "delete", delete)
    assert _ids(spark, path) == before  # readers see the day whole, once
    upkeep.recover(spark, path)
    assert _ids(spark, path) == before
    upkeep.compact_day(spark, path, "traces", 20240110, files=1)
    assert _ids(spark, path) == before
    assert len(glob.glob(f"{path}/dt=20240110/batch=*/*.parquet")) == 1


def test_days_wanted_are_the_only_folders_listed(spark, inputs, tmp_path):
    path = str(tmp_path / "traces")
    for n in range(5):
        write_signal(inputs.traces, "traces", path, f"b{n}")
    two = read_signal(spark, path, "traces", [20240110, 20240111, 19990101])
    assert {f.split("dt=")[1][:8] for f in two.inputFiles()} == {"20240110", "20240111"}
    assert two.count() == read_signal(spark, path, "traces").filter("dt in (20240110, 20240111)").count()
    assert read_signal(spark, path, "traces", []).count() == 0


def test_retention(spark, inputs, tmp_path):
    path = str(tmp_path / "logs")
    write_signal(inputs.logs, "logs", path, "b")
    as_of = datetime(2024, 2, 5, 6, 30)
    gone = upkeep.drop_expired(spark, path, "logs", as_of)
    assert gone == [20240101, 20240102, 20240103, 20240104, 20240105]
    assert upkeep.table_days(spark, path)[0] == 20240106
    kept = upkeep.apply_retention(read_signal(spark, path, "logs"), "logs", as_of)
    limit = datetime(2024, 1, 6, 6, 30)
    want = inputs.logs.filter(F.date_trunc("SECOND", "timestamp") > F.lit(limit).cast("timestamp")).count()
    assert kept.count() == want
    assert upkeep.drop_expired(spark, path, "logs", as_of) == []


def test_time_range_and_newest_days_read_few_days(spark, inputs, tmp_path):
    path = str(tmp_path / "logs")
    write_signal(inputs.logs, "logs", path, "b")
    table = read_signal(spark, path, "logs")
    some = time_range(table, datetime(2024, 1, 10, 6), datetime(2024, 1, 11, 18))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "20240110" in plan
    days = upkeep.table_days(spark, path)
    for n in (1, 20, 100, 10**6):
        got = panels.newest_days(table, n, days, "log_id").collect()
        want = panels.newest(inputs.logs, n, "log_id").collect()
        assert [r["log_id"] for r in got] == [r["log_id"] for r in want]
    plan = panels.newest_days(table, 20, days, "log_id")._jdf.queryExecution().executedPlan().toString()
    assert "dt" in plan.split("PartitionFilters:")[1][:60]


def test_empty_tables_give_zero_totals(spark):
    empty = {s.name: spark.createDataFrame([], s.schema) for s in SIGNALS.values()}
    assert panels.total_tokens(empty["ai_spans"]).collect() == [(0,)]
    assert panels.total_cost(empty["ai_spans"]).collect() == [(0.0,)]
    assert panels.total_logs(empty["logs"]).collect() == [(0,)]
    assert panels.total_spans(empty["traces"]).collect() == [(0,)]
    assert panels.recent_ai_spans(empty["ai_spans"]).collect() == []
    assert panels.recent_triggers(empty["alert_triggers"]).collect() == []


def test_many_small_files_take_few_tasks_and_stay_apart(spark, inputs, tmp_path, monkeypatch):
    """A task writes several files of its own key range; days are compacted side by side and keep their labels."""
    path = str(tmp_path / "traces")
    for n in range(2):
        write_signal(inputs.traces.filter(F.pmod(F.crc32("span_id"), F.lit(2)) == n), "traces", path, f"b{n}")
    before = sorted(map(repr, read_signal(spark, path, "traces").collect()))
    days = upkeep.table_days(spark, path)[:4]
    real, tasks = type(inputs.traces).repartitionByRange, []
    monkeypatch.setattr(type(inputs.traces), "repartitionByRange", lambda df, n, *keys: tasks.append(n) or real(df, n, *keys))
    upkeep.compact_days(spark, path, "traces", dict.fromkeys(days, 20))
    assert tasks == [1] * len(days)
    for row in upkeep.day_layout(spark, path, "traces", days).collect():
        assert 10 <= row["files"] <= 20 and row["ranges_disjoint"], row
    monkeypatch.setattr(upkeep, "TASK_FILES", 4)
    upkeep.compact_day(spark, path, "traces", days[0], files=20)
    layout = upkeep.day_layout(spark, path, "traces", days[:1]).first()
    assert tasks[-1] == 5 and 10 <= layout["files"] <= 20 and layout["ranges_disjoint"]
    spark.catalog.refreshByPath(path)
    assert sorted(map(repr, read_signal(spark, path, "traces").collect())) == before
    write_signal(inputs.traces, "traces", path, "b0")  # replayed: days with the label in their copy take nothing
    spark.catalog.refreshByPath(path)
    counts = {r["dt"]: r["count"] for r in read_signal(spark, path, "traces", days).groupBy("dt").count().collect()}
    assert sum(counts.values()) == sum(f"dt={d}" in r or f"={d}" in r for r in before for d in days)


def test_rows_come_out_of_the_shuffle_of_a_write_as_they_went_in(spark, inputs, tmp_path):
    """Ids travel as bytes, whatever is no plain hex text as it is; the text comes back to the letter."""
    odd = ["0123456789abcdef" * 2, "0123456789ABCDEF" * 2, "0123456789abcdef", "0123456789abcdef\n", "a" * 34, "abc", "", "ü" * 16, None,
           "01234567-89ab-cdef-0123-456789abcdef", "01234567-89AB-cdef-0123-456789abcdef", "0123456-789ab-cdef-0123-456789abcdef", "-" * 32]
    given = inputs.traces.limit(1).drop("trace_id", "parent_span_id").crossJoin(spark.createDataFrame([(x, x) for x in odd], "trace_id string, parent_span_id string"))
    path = str(tmp_path / "traces")
    write_signal(given, "traces", path, "b")
    back = read_signal(spark, path, "traces").drop("dt")
    assert sorted(map(repr, back.collect())) == sorted(map(repr, given.select(*back.columns).collect()))
    for signal in SIGNALS:
        moved = gathered_by_day(with_day(inputs.view(signal)), signal)
        assert moved.columns == [*SIGNALS[signal].columns, "dt"]
        plan = moved._jdf.queryExecution().optimizedPlan()
        while "RebalancePartitions" not in plan.nodeName():
            plan = plan.children().head()
        kinds = {a.name(): a.dataType().simpleString() for a in (plan.output().apply(n) for n in range(plan.output().size()))}
        assert all(kinds[f"_{c}"] == "binary" for c in SIGNALS[signal].columns if c.endswith("_id"))
