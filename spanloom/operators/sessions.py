"""Bursts of ERROR logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import previous, running_total


def error_bursts(logs: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """Runs of ERROR lines of a service with less than ``gap_seconds`` between neighbours."""
    instants = (
        logs.filter("severity = 'ERROR'").groupBy("service_name", "timestamp").agg(F.count(F.lit(1)).alias("n"))
    )
    linked = previous(instants.withColumn("at", F.unix_micros("timestamp")), ["service_name"], "timestamp", ["at"])
    starts = F.col("prev_at").isNull() | (F.col("at") - F.col("prev_at") >= gap_seconds * 1000000)
    numbered = running_total(
        linked.withColumn("burst", starts.cast("bigint")).drop("prev_at", "at"), ["service_name"], "timestamp", ["burst"]
    )
    return (
        numbered.groupBy("service_name", "burst")
        .agg(
            F.min("timestamp").alias("started_at"),
            (F.max("timestamp") + F.expr(f"INTERVAL {int(gap_seconds)} SECONDS")).alias("ended_at"),
            F.sum("n").alias("lines"),
        )
        .drop("burst")
    )
