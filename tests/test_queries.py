"""Every named query against its SQL twin on the smallest test tables."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from compare import compare, duck
from conftest import SMALL

from spanloom.functions import spread
from spanloom.plans import catalog

THREADS = 6


@pytest.fixture(scope="module")
def outcomes(spark):
    con = duck(SMALL)

    def check(name):
        try:
            df = catalog.run(name, spark, SMALL)
            if name in catalog.ORACLES:
                return compare(df, con.cursor(), catalog.ORACLES[name])
            return df.count() > 0, "no rows"
        except Exception as error:  # shown by the test of this query
            return False, f"{type(error).__name__}: {error}"

    with ThreadPoolExecutor(THREADS) as pool:
        return dict(zip(catalog.QUERIES, pool.map(check, catalog.QUERIES)))


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_sql(outcomes, name):
    ok, message = outcomes[name]
    assert ok, message


@pytest.mark.parametrize(
    "name",
    ["j1_logs_with_spans", "j2_ai_spans_with_trace", "j3_self_time", "j3_span_with_parent", "j4_triggers_with_incident",
     "j5_dangling_triggers", "j5_orphan_spans", "j7_incident_impact", "j9_span_latest_metric", "a5_red", "d2_cost"],
)
def test_query_equals_sql_when_keys_are_split(spark, monkeypatch, name):
    """The same answers when nearly every key counts as hot."""
    monkeypatch.setattr(spread, "ROWS_PER_TASK", 1)
    monkeypatch.setattr(spread, "KEY_BUCKETS", 64)
    ok, message = compare(catalog.run(name, spark, SMALL), duck(SMALL), catalog.ORACLES[name])
    assert ok, message


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert len(catalog.ORACLES) >= len(catalog.QUERIES)
