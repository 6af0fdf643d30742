"""Append signals to day-partitioned Parquet tables.

Layout: ``<table>/dt=yyyyMMdd/batch=<label>/part-*.parquet``, rows of a file
sorted by the signal's sort key. A batch owns its label: writing it again
replaces its own folders and nothing else, so a job that failed half way, or a
micro-batch that is replayed, is simply run again. Days in which a label has been
folded into a compacted copy keep the rows of its first run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.folders import names_in
from ..functions.ids import packed_id, unpacked_id
from ..functions.times import day_key
from ..signals import SIGNALS, SPARK_TYPES

COMPRESSION = "zstd"
# Table of (dt, label): which labels the compacted copy of a day holds. Readers never list it as data.
FOLDED = "_folded"


def batch_column(label: str) -> Column:
    """The batch label, written so that it is not a constant to the optimizer.

    A constant drops out of the sort order. The writer would then miss it there
    and sort each task's rows by folder alone, which loses the clustering.
    """
    return F.when(F.col("dt") > 0, F.lit(label))


def with_day(df: DataFrame) -> DataFrame:
    return df.withColumn("dt", day_key("timestamp"))


def signal_columns(signal: str) -> list[Column]:
    """The columns of a signal, in the types of its tables."""
    return [F.col(n).cast(SPARK_TYPES[k]).alias(n) for n, k in SIGNALS[signal].columns.items()]


def folded_days(spark: SparkSession, path: str, label: str) -> list[int]:
    """Days whose compacted copy holds the rows of ``label``; few, as a batch spans few days."""
    if not names_in(spark, f"{path}/{FOLDED}"):
        return []
    found = spark.read.schema("dt int, label string").parquet(f"{path}/{FOLDED}")
    return sorted(r["dt"] for r in found.filter(F.col("label") == label).select("dt").distinct().collect())


# Order in which columns travel: what few values fill comes first, what differs in every row last.
_TRAVEL = ("text", "labels", "doubles", "u64s", "uuid", "u64", "u32", "double", "time?", "time")


def gathered_by_day(rows: DataFrame, signal: str) -> DataFrame:
    """Rows rebalanced by ``dt``, in a form that takes the shuffle about half the bytes.

    Ids are what a shuffle cannot compress: they travel packed, one that is no plain hex
    text as it is. Columns with few values lie side by side, where they compress as one.
    """
    spec = SIGNALS[signal]
    ids = sorted((c for c in spec.columns if c.endswith("_id")), key=lambda c: c == spec.row_id)
    packed = {c: packed_id(F.col(c)) for c in ids}
    others = sorted((c for c in spec.columns if c not in ids), key=lambda c: _TRAVEL.index(spec.columns[c]))
    texts = [c for c in others if spec.columns[c] in _TRAVEL[:4]]
    moved = rows.select(
        "dt", *texts, *[F.when(packed[c].isNull(), F.col(c)).alias(c) for c in ids],
        *[packed[c].alias(f"_{c}") for c in ids], *others[len(texts):],
    )
    back = {c: F.coalesce(unpacked_id(F.col(f"_{c}")), F.col(c)) for c in ids}
    return moved.hint("rebalance", "dt").withColumns(back).select(*rows.columns)


def write_signal(df: DataFrame, signal: str, path: str, batch: str | None = None) -> str:
    """Append rows to the table at ``path`` and return the batch label.

    Rebalancing by day gives each day few files, and Spark splits a day that
    holds much of the batch over several tasks.
    """
    spec = SIGNALS[signal]
    label = batch or uuid.uuid4().hex
    rows = with_day(df.select(*signal_columns(signal)))
    if batch and (held := folded_days(df.sparkSession, path, batch)):
        rows = rows.filter(~F.col("dt").isin(held))
    (
        gathered_by_day(rows, signal).withColumn("batch", batch_column(label))
        # Folder columns first, or the writer would sort by them again and lose the rest.
        .sortWithinPartitions("dt", "batch", *spec.sort_key)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", COMPRESSION)
        .partitionBy("dt", "batch")
        .parquet(path)
    )
    return label


def write_rejected(rejected: DataFrame, path: str, batch: str | None = None) -> str:
    """Keep payloads that were not taken beside the good rows, by signal and batch."""
    label = batch or uuid.uuid4().hex
    (
        rejected.withColumn("batch", F.lit(label))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", COMPRESSION)
        .partitionBy("signal", "batch")
        .parquet(path)
    )
    return label
