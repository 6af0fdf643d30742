"""Log volume by service, severity and environment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import slot_start

SEVERITIES = ("DEBUG", "INFO", "WARN", "ERROR")


def log_volume(logs: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """Lines per service, severity, environment and time bucket."""
    return logs.groupBy(
        slot_start("timestamp", bucket_seconds).alias("bucket"), "service_name", "severity", "env"
    ).agg(F.count(F.lit(1)).alias("lines"))


def log_volume_cube(logs: DataFrame) -> DataFrame:
    """Lines with every combination of sub-totals; ``level`` is the grouping id."""
    finest = logs.groupBy("service_name", "severity", "env").agg(F.count(F.lit(1)).alias("lines"))
    return finest.cube("service_name", "severity", "env").agg(
        F.grouping_id().cast("bigint").alias("level"), F.sum("lines").alias("lines")
    )


def severity_table(logs: DataFrame, severities: Sequence[str] = SEVERITIES) -> DataFrame:
    """One row per service, one column per severity, the rest under ``other``."""
    finest = logs.groupBy("service_name", "severity").agg(F.count(F.lit(1)).alias("lines"))
    named = F.when(F.col("severity").isin(*severities), F.col("severity")).otherwise("other")
    wide = finest.withColumn("severity", named).groupBy("service_name").pivot("severity", [*severities, "other"])
    return wide.agg(F.sum("lines")).fillna(0)
