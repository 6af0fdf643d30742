"""Physical plans: what must be in them and what must not."""

import re

import pytest
from conftest import SMALL

from spanloom.plans import catalog

# Queries that only describe work; the others run streams or write tables first.
LAZY = [n for n in catalog.QUERIES if n[0] not in "kx" and n not in ("q10_live_panels", "t2_newest_days", "p4_time_range")]


def plan_of(spark, name):
    return catalog.run(name, spark, SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_plan_pairs_everything_or_leaves_the_jvm(spark, name):
    plan = plan_of(spark, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "Scan ExistingRDD"):
        assert bad not in plan, bad
    # A window without a partition key would move all rows to one task.
    for window in re.findall(r"Window \[.*", plan):
        assert not re.search(r"\], \[\]$|windowspecdefinition\(\w+#\d+ (ASC|DESC)", window), window


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if re.match(r"q[5-9]_", n)])
def test_newest_rows_keep_a_heap_per_task(spark, name):
    plan = plan_of(spark, name)
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_top_per_group_cuts_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan_of(spark, "w4_slowest_spans")


def nodes(spark, name):
    plan = plan_of(spark, name)
    return len(re.findall(r"(?<!Reused)(?<!Broadcast)Exchange ", plan)), len(re.findall(r"FileScan|Scan parquet", plan))


@pytest.mark.parametrize("name", ["j1_logs_with_spans", "j3_self_time", "j3_span_with_parent", "j5_orphan_spans", "a7_service_edges", "j5_dangling_triggers"])
def test_joins_to_a_lookup_read_each_side_once(spark, name):
    """No pass that only counts keys: the scans are those of the two sides and of the rows that cannot match."""
    exchanges, scans = nodes(spark, name)
    assert "_bucket" not in plan_of(spark, name) and exchanges <= 5, exchanges
    assert scans <= 6, scans


def test_impact_of_incidents_takes_few_exchanges(spark):
    assert nodes(spark, "j7_incident_impact")[0] <= 12


def test_only_needed_columns_are_read(spark):
    plan = plan_of(spark, "q1_total_tokens")
    assert "ReadSchema: struct<role:string,text:string>" in plan or "ReadSchema: struct<text:string,role:string>" in plan
    assert re.search(r"ReadSchema: struct<>", plan_of(spark, "q3_total_logs"))


def test_payloads_are_parsed_once(spark):
    plan = plan_of(spark, "s2_read_traces")
    assert plan.count("from_json(") <= 2 * plan.count("union") + 4


def test_session_folder_follows_the_cluster_setting(spark):
    from spanloom.session import work_folder

    base = spark.conf.get("spark.checkpoint.dir", None)
    folder = work_folder(spark, "x")
    assert folder.startswith(base or spark.conf.get("spark.checkpoint.dir"))
    assert folder != work_folder(spark, "x")
