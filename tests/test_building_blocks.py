"""Slice-wise windows, as-of lookups, exact quantiles and hot-key joins against brute force."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spanloom.functions import ordered, quantiles, spread
from spanloom.functions.histograms import histogram_quantile
from spanloom.functions.numeric import round_even, sum_fixed
from spanloom.operators import topk

START = datetime(2024, 1, 1)


def _series(rng, keys=("a", "b", "c"), n=60, span_hours=30):
    out = {}
    for _ in range(n):
        key = rng.choice(keys)
        at = START + timedelta(milliseconds=rng.randint(0, span_hours * 3600 * 1000))
        out[(key, at)] = rng.randint(0, 100)
    return sorted((k, t, v) for (k, t), v in out.items())


@pytest.mark.parametrize("slice_seconds", [60, 3600, 86400])
def test_running_total_and_previous(spark, slice_seconds):
    rows = _series(random.Random(slice_seconds))
    df = spark.createDataFrame(rows, "k string, ts timestamp, v bigint")
    total, last, sums, prevs = {}, {}, set(), set()
    for k, t, v in rows:
        total[k] = total.get(k, 0) + v
        sums.add((k, t, total[k]))
        prevs.add((k, t, v, last.get(k)))
        last[k] = v
    got = ordered.running_total(df, ["k"], "ts", ["v"], slice_seconds).select("k", "ts", "v").collect()
    assert {tuple(r) for r in got} == sums
    got = ordered.previous(df, ["k"], "ts", ["v"], slice_seconds).select("k", "ts", "v", "prev_v").collect()
    assert {tuple(r) for r in got} == prevs


@pytest.mark.parametrize("rows_per_task", [1, 10**6])
def test_asof_lookup(spark, rows_per_task):
    rng = random.Random(3)
    line = _series(rng, n=40)
    points = [(n, rng.choice("aaaaabd"), START + timedelta(seconds=rng.randint(-7200, 40 * 3600))) for n in range(300)]
    points += [(1000 + n, k, t) for n, (k, t, _) in enumerate(line)]
    # Half of the points share one slice.
    points += [(2000 + n, "a", START + timedelta(hours=5, seconds=n)) for n in range(300)]
    want = set()
    for n, k, t in points:
        before = [(lt, v) for lk, lt, v in line if lk == k and lt <= t]
        want.add((n, *(max(before) if before else (None, None))))
    got = ordered.asof_lookup(
        spark.createDataFrame(points, "n bigint, k string, ts timestamp"), "ts",
        spark.createDataFrame(line, "k string, at timestamp, v bigint"), "at", ["k"], ["at", "v"], ["n"],
        rows_per_task=rows_per_task,
    )
    assert {(r["n"], r["at"], r["v"]) for r in got.collect()} == want


def test_exact_quantiles(spark):
    rng = random.Random(5)
    rows = [("big", rng.randint(10**8, 2 * 10**8)) for _ in range(997)]
    rows += [("same", 7)] * 50 + [("one", 3)] + [("signed", rng.randint(-1000, 1000)) for _ in range(100)]
    qs = {"q0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "q1": 1.0}
    got = quantiles.exact_quantiles(spark.createDataFrame(rows, "g string, v bigint"), ["g"], "v", qs)
    got = {r["g"]: [r[n] for n in qs] for r in got.collect()}
    for g in {g for g, _ in rows}:
        values = sorted(v for h, v in rows if h == g)
        assert got[g] == [values[max(math.ceil(q * len(values)), 1) - 1] for q in qs.values()], g
    doubles = [("d", rng.uniform(0, 0.01)) for _ in range(500)]
    got = quantiles.exact_quantiles(spark.createDataFrame(doubles, "g string, v double"), ["g"], "v", {"p50": 0.5})
    assert got.first()["p50"] == sorted(v for _, v in doubles)[249]


@pytest.mark.parametrize("kind", ["bigint", "double", "decimal(20,0)"])
def test_a_wide_band_is_counted_again_until_it_fits(spark, kind, monkeypatch):
    """Different values in one band, and one value that most rows share: no window holds more than 500 rows."""
    rng = random.Random(9)
    base = 2**63 - 10**6 if kind == "bigint" else 2**64 - 10**6 if kind != "double" else 1e15
    many = sorted(rng.sample(range(200_000), 20_000))
    values = many + [many[5000]] * 30_000
    df = spark.createDataFrame([(v,) for v in values], "n bigint").selectExpr("'g' AS g", f"CAST(n + CAST({base} AS {kind}) AS {kind}) AS v")
    df = df.unionByName(spark.range(300).selectExpr("'small' AS g", f"CAST(id AS {kind}) AS v"))
    ranked = []
    holding = quantiles._holding
    monkeypatch.setattr(quantiles, "_holding", lambda bands, keys, order="_band": ranked.append((bands, tuple(keys))) or holding(bands, keys, order))
    qs = {"q0": 0.0, "p05": 0.05, "p50": 0.5, "p90": 0.9, "p999": 0.999, "q1": 1.0}
    got = {r["g"]: [r[n] for n in qs] for r in quantiles.exact_quantiles(df, ["g"], "v", qs, rows_per_window=500).collect()}
    ordered_values = sorted(values)
    assert [int(x - type(x)(base)) for x in got["g"]] == [ordered_values[max(math.ceil(q * len(values)), 1) - 1] for q in qs.values()]
    assert [int(x) for x in got["small"]] == [max(math.ceil(q * 300), 1) - 1 for q in qs.values()]
    assert len(ranked) > 2  # bands were counted again
    last, keys = ranked[-1]
    assert last.groupBy(*keys).agg(F.sum("_n").alias("n")).agg(F.max("n")).first()[0] <= 500


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_lookup_join_splits_a_hot_key(spark, how):
    rows = [(n, "hot" if n % 3 == 0 else f"k{n % 500}") for n in range(6000)] + [(9000 + n, "") for n in range(50)]
    lookup = [("hot", 1)] + [(f"k{n}", n) for n in range(250)]
    left = spark.createDataFrame(rows, "n bigint, k string")
    right = spark.createDataFrame(lookup, "k string, v bigint")
    known = dict(lookup)
    got = spread.lookup_join(left, right, ["k"], ["n"], how, match_if=F.col("k") != "", rows_per_task=50)
    want = {
        "left": [(n, k, known.get(k)) for n, k in rows],
        "inner": [(n, k, known[k]) for n, k in rows if k in known],
        "left_semi": [(n, k) for n, k in rows if k in known],
        "left_anti": [(n, k) for n, k in rows if k not in known],
    }[how]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_hot_buckets_are_few_and_parts_grow_with_the_bucket(spark):
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    hot = spread.hot_buckets(df, ["k"], rows_per_task=100)
    found = hot.collect()
    assert 1 <= len(found) <= 3
    parts = max(r["_parts"] for r in found)
    assert 100 <= parts <= 102
    sizes = [r["count"] for r in spread.split_rows(df, ["k"], ["id"], hot).filter("k = 'hot'").groupBy("_part").count().collect()]
    assert len(sizes) >= 95 and max(sizes) < 200
    copies = spread.copy_rows(spark.createDataFrame([("hot",), ("7",)], "k string"), ["k"], hot)
    assert {r["k"]: r["count"] for r in copies.groupBy("k").count().collect()}["hot"] == parts


def test_top_per_group_beyond_the_group_limit(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), "id")
    got = topk.top_per_group(df, ["g"], [F.col("id").desc()], 1500, ["id"])
    assert got.groupBy("g").count().collect() and got.count() == 3000
    assert got.filter("g = 1 AND rank = 1500").first()["id"] == 4999 - 2 * 1499


@pytest.mark.parametrize("k", [1, 7, 5000])
def test_top_per_group_for_any_k(spark, k):
    """One group holds most rows, one is small, one has a NULL key; equal values are told apart by id."""
    rng = random.Random(k)
    rows = [(rng.choice(["big"] * 8 + ["small", None]), rng.randint(0, 3000), n) for n in range(20_000)]
    df = spark.createDataFrame(rows, "g string, v bigint, id bigint").repartition(7)
    got = topk.top_per_group(df, ["g"], [F.col("v").desc(), F.col("id")], k, ["id"])
    want = set()
    for g in ("big", "small", None):
        best = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))[:k]
        want |= {(*r, n) for n, r in enumerate(best, 1)}
    assert {tuple(r) for r in got.collect()} == want


def test_rounding_and_sums(spark):
    df = spark.createDataFrame([(0.125, 2), (0.375, 2), (2.5, 0), (-2.5, 0)], "x double, n int")
    got = df.select(*[round_even("x", d).alias(f"r{d}") for d in (0, 2)]).collect()
    assert [got[0]["r2"], got[1]["r2"], got[2]["r0"], got[3]["r0"]] == [0.12, 0.38, 2.0, -2.0]
    parts = [0.1] * 10 + [1e30, 1e-3]
    total = spark.createDataFrame([(p,) for p in parts], "x double").agg(sum_fixed("x")).first()[0]
    assert total == 1.001 + 1e30
    assert spark.createDataFrame([(0.1,)] * 10, "x double").agg(sum_fixed("x")).first()[0] == 1.0


def test_histogram_quantile_edges(spark):
    rows = [
        ([1.0, 2.0, 4.0], [2, 2, 6], 6, 0.5, 2.5),  # inside the third bucket
        ([1.0, 2.0, 4.0], [2, 2, 6], 6, 0.1, 0.3),  # first bucket starts at 0
        ([1.0, 2.0], [2, 4], 8, 0.9, 2.0),  # above the last bound
        ([1.0, 2.0], [0, 0], 0, 0.5, None),  # nothing counted
        ([], [], 3, 0.5, None),
        ([1.0, 2.0], [0, 4], 4, 0.0, 0.0),  # empty first bucket
    ]
    for bounds, counts, n, q, want in rows:
        df = spark.createDataFrame([(bounds, counts, n)], "b array<double>, c array<bigint>, n bigint")
        got = df.select(histogram_quantile("b", "c", "n", q)).first()[0]
        assert got == want or math.isclose(got, want), (bounds, counts, n, q, got)
    df = spark.createDataFrame([([1.0, 2.0, 4.0], [2, 0, 4], 6)], "b array<double>, c array<bigint>, n bigint")
    assert df.select(histogram_quantile("b", "c", "n", 0.5, cumulative=False)).first()[0] == 2.5
