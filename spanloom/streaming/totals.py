"""Live totals: running aggregates over a whole stream, kept as snapshots."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .ingest import trigger


# Snapshots kept unless said otherwise, so that a reader of an older one can finish.
KEPT = 3


def _snapshots(spark: SparkSession, path: str) -> dict[int, bool]:
    """Snapshots under ``path`` and whether each was written in full."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return {
        int(m.group(1)): fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
        for s in fs.listStatus(where)
        if (m := re.fullmatch(r"snapshot=(\d+)", s.getPath().getName()))
    }


def keep_total(total: DataFrame, path: str, checkpoint: str, live: bool = True, interval: str = "5 seconds", kept: int = KEPT) -> StreamingQuery:
    """Write a streaming aggregate's full result after every micro-batch; all but the newest ``kept`` go."""
    spark = total.sparkSession

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/snapshot={batch_id}")
        jvm = spark._jvm
        for old in sorted(_snapshots(spark, path))[:-kept]:
            where = jvm.org.apache.hadoop.fs.Path(f"{path}/snapshot={old}")
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

    return (
        total.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger(live, interval))
        .foreachBatch(store)
        .start()
    )


def latest_total(spark: SparkSession, path: str) -> DataFrame:
    """The newest snapshot that was written in full."""
    newest = max(n for n, done in _snapshots(spark, path).items() if done)
    return spark.read.parquet(f"{path}/snapshot={newest}")
