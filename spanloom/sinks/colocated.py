"""Signals kept by trace: tables whose joins on trace ids need no shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..signals import SIGNALS
from .tables import COMPRESSION, signal_columns

BUCKETS = 512
# Rows a bucket is planned for: one task reads a bucket whole.
BUCKET_ROWS = 1_000_000


def buckets_for(rows: int) -> int:
    """Buckets for the largest of the tables that join, a power of two, so that tables of other sizes may join them."""
    return 1 << max(0, -(-rows // BUCKET_ROWS) - 1).bit_length()


def write_by_trace(df: DataFrame, signal: str, path: str, buckets: int = BUCKETS, name: str | None = None) -> str:
    """Write a signal in buckets of its trace id, sorted by trace and span; returns the table's name.

    For closed days that many questions about traces read. Two tables with as many
    buckets join, group and look up parents bucket by bucket: nothing moves on the side
    of the spans, whatever the keys beside the trace id. The rows are shuffled once, here.
    """
    keys = [c for c in ("trace_id", "span_id") if c in SIGNALS[signal].columns]
    table = name or f"{signal}_by_trace_{uuid.uuid4().hex}"
    (
        df.select(*signal_columns(signal)).repartition(buckets, "trace_id")
        .write.bucketBy(buckets, "trace_id").sortBy(*keys)
        .option("compression", COMPRESSION).option("path", path)
        .saveAsTable(table, format="parquet")
    )
    return table


def read_by_trace(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)
