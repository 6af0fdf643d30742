"""Time-ordered operations cut into slices, so that no task sorts a whole key.

A plain window over one series, service or rule holds its whole history in one
task. Here a window covers one key *and one slice of time*; what crosses a slice
border travels in a small table with one row per key and slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spread import copy_rows, hot_buckets, split_rows
from .times import slot

SLICE_SECONDS = 3600


def running_total(
    df: DataFrame, by: Sequence[str], ts: str, values: Sequence[str], slice_seconds: int = SLICE_SECONDS
) -> DataFrame:
    """Replace each of ``values`` by its running sum per ``by``, ordered by ``ts``.

    ``df`` has one row per (by, ts), so a slice never holds more rows than it
    has distinct timestamps.
    """
    by = list(by)
    sliced = df.withColumn("_slice", slot(ts, slice_seconds))
    totals = sliced.groupBy(*by, "_slice").agg(*[F.sum(v).alias(v) for v in values])
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # What the slices before amount to enters a slice as its first row.
    carried = totals.select(
        *by, "_slice", F.lit(0).alias("_kind"), *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(v) for v in values]
    )
    inside = Window.partitionBy(*by, "_slice").orderBy("_kind", ts).rowsBetween(Window.unboundedPreceding, 0)
    return (
        sliced.withColumn("_kind", F.lit(1))
        .unionByName(carried, allowMissingColumns=True)
        .withColumns({v: F.sum(v).over(inside) for v in values})
        .filter("_kind = 1")
        .select(*df.columns)
    )


def previous(
    df: DataFrame, by: Sequence[str], ts: str, values: Sequence[str], slice_seconds: int = SLICE_SECONDS
) -> DataFrame:
    """Add ``prev_<value>``: the value of the preceding row per ``by``, NULL at the start.

    ``df`` has one row per (by, ts).
    """
    by = list(by)
    sliced = df.withColumn("_slice", slot(ts, slice_seconds)).withColumn("_v", F.struct(*values))
    last = sliced.groupBy(*by, "_slice").agg(F.max_by("_v", F.col(ts)).alias("_v"))
    slices = Window.partitionBy(*by).orderBy("_slice")
    carried = last.select(*by, "_slice", F.lit(0).alias("_kind"), F.lag("_v").over(slices).alias("_v"))
    inside = Window.partitionBy(*by, "_slice").orderBy("_kind", ts)
    return (
        sliced.withColumn("_kind", F.lit(1))
        .unionByName(carried, allowMissingColumns=True)
        .withColumn("_prev", F.lag("_v").over(inside))
        .filter("_kind = 1")
        .select(*df.columns, *[F.col("_prev").getField(v).alias(f"prev_{v}") for v in values])
    )


def asof_lookup(
    points: DataFrame,
    point_ts: str,
    timeline: DataFrame,
    timeline_ts: str,
    by: Sequence[str],
    values: Sequence[str],
    spread: Sequence[str],
    slice_seconds: int = SLICE_SECONDS,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Add to each point the ``values`` of the latest timeline row at or before it.

    ``timeline`` has one row per (by, timestamp). Points of a busy slice are
    split by ``spread``; the timeline rows of that slice are copied to each part.
    """
    by = list(by)
    pts = points.withColumn("_slice", slot(point_ts, slice_seconds))
    line = timeline.select(
        *by, slot(timeline_ts, slice_seconds).alias("_slice"), F.col(timeline_ts).alias("_at"), F.struct(*values).alias("_v")
    )

    # Latest value before each slice that has points.
    last = line.groupBy(*by, "_slice").agg(F.max_by("_v", "_at").alias("_v"))
    per_slice = pts.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    wanted = per_slice.select(*by, "_slice")
    marks = last.withColumn("_wanted", F.lit(False)).unionByName(
        wanted.withColumn("_wanted", F.lit(True)), allowMissingColumns=True
    )
    before = Window.partitionBy(*by).orderBy("_slice").rangeBetween(Window.unboundedPreceding, -1)
    carried = (
        marks.withColumn("_v", F.last("_v", ignorenulls=True).over(before))
        .filter("_wanted AND _v IS NOT NULL")
        .select(*by, "_slice", F.timestamp_seconds(F.col("_slice") * slice_seconds).alias("_at"), F.lit(0).alias("_kind"), "_v")
    )

    keys = [*by, "_slice"]
    hot = hot_buckets(per_slice, keys, weight="_n", rows_per_task=rows_per_task)
    known = copy_rows(line.withColumn("_kind", F.lit(1)).unionByName(carried), keys, hot)
    asked = split_rows(pts, keys, spread, hot).withColumns({"_at": F.col(point_ts), "_kind": F.lit(2)})
    order = Window.partitionBy(*keys, "_part").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return (
        asked.unionByName(known, allowMissingColumns=True)
        .withColumn("_v", F.last("_v", ignorenulls=True).over(order))
        .filter("_kind = 2")
        .select(*points.columns, *[F.col("_v").getField(v).alias(v) for v in values])
    )
