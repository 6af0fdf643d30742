"""Top rows per group, by a tournament that no group can crowd into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def top_per_group(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, spread: Sequence[str]
) -> DataFrame:
    """Best ``k`` rows per group with their ``rank``, for any ``k``.

    First round: a group's rows are dealt into parts by a hash of ``spread``, and
    each part keeps its best ``k``. Second round: these winners, as many as parts
    times ``k`` a group at most, are dealt out by range of the order, so a group
    covers a stretch of partitions; the rows of each stretch are counted, and a
    row's rank is the count of the stretches before its own plus its place inside.
    Stretches that begin beyond ``k`` are not ranked at all. ``order`` must tell
    rows apart for the result to be fixed. The first round runs at once.
    """
    by = list(by)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.lit(parts))
    place = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))
    winners = df.withColumn("_part", part).withColumn("_place", place).filter(F.col("_place") <= k).drop("_part", "_place")

    ranged = winners.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("_range", F.spark_partition_id())
    dealt = written(ranged.withColumn("_group", F.struct(*by)), "top-winners")
    counts = dealt.groupBy("_group", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = counts.withColumn("_before", before).filter(F.col("_before") < k).select("_group", "_range", "_before")
    inside = F.row_number().over(Window.partitionBy("_group", "_range").orderBy(*order))
    ranked = dealt.withColumn("_inside", inside).filter(F.col("_inside") <= k).join(wanted, ["_group", "_range"])
    rank = (F.col("_before") + F.col("_inside")).cast("int")
    return ranked.select(*df.columns, rank.alias("rank")).filter(F.col("rank") <= k)


SPAN_COLUMNS = ("service_name", "trace_id", "span_id", "operation_name", "timestamp", "duration_ns")


def slowest_spans(traces: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` longest spans of each service."""
    order = [F.col("duration_ns").desc(), F.col("trace_id"), F.col("span_id"), F.col("timestamp")]
    return top_per_group(traces.select(*SPAN_COLUMNS), ["service_name"], order, k, ["trace_id", "span_id"]).select(
        "service_name", "rank", "trace_id", "span_id", "operation_name", "timestamp", "duration_ns"
    )
