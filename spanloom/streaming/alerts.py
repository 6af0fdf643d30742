"""Alert rules over error ratios: above a threshold, held for some time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.ids import content_id
from ..functions.numeric import ratio
from ..functions.times import day_key, slot
from ..signals import ALERT_TRIGGERS, NIL_UUID
from ..sinks.tables import write_signal
from ..sinks.upkeep import table_days
from .ingest import trigger
from .rollups import red_windows

WIDTH_SECONDS = 60


def held_breaches(buckets: DataFrame, rule: str, threshold: float, hold: int) -> DataFrame:
    """One trigger row for each run of breaching buckets, when it is ``hold`` long.

    ``buckets`` has one row per (service_name, window_start, window_end), so a
    window over a service is as long as its time range, not its traffic. A
    bucket without spans ends a run.
    """
    breaching = buckets.filter(ratio(F.col("errors"), F.col("spans")) > threshold).withColumn(
        "_slot", slot("window_start", WIDTH_SECONDS)
    )
    in_time = Window.partitionBy("service_name").orderBy("_slot")
    runs = breaching.withColumn("_run", F.col("_slot") - F.row_number().over(in_time))
    in_run = Window.partitionBy("service_name", "_run").orderBy("_slot")
    held = runs.withColumns(
        {
            "_length": F.row_number().over(in_run),
            "_errors": F.sum("errors").over(in_run.rowsBetween(1 - hold, 0)),
        }
    ).filter(F.col("_length") == hold)
    return held.select(
        content_id(F.lit(rule), F.col("service_name"), F.unix_micros("window_end")).alias("trigger_id"),
        F.lit(NIL_UUID).alias("incident_id"),
        F.col("window_end").alias("timestamp"),
        F.lit("firing").alias("status"),
        F.lit(f"{rule}: error ratio above {threshold} for {hold} buckets").alias("message"),
        "service_name",
        F.col("_errors").alias("trigger_count"),
    ).select(*ALERT_TRIGGERS.columns)


def evaluate_rule(
    spark: SparkSession,
    traces: DataFrame,
    rule: str,
    threshold: float,
    hold: int,
    buckets_path: str,
    triggers_path: str,
    checkpoint: str,
    delay: str = "10 minutes",
    live: bool = True,
    interval: str = "1 minute",
) -> StreamingQuery:
    """Watch a span stream and append trigger rows when the rule fires.

    Only buckets the watermark has closed are judged. They are kept in a table,
    and each micro-batch looks back over the ``hold`` buckets before its own.
    """

    def judge(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # written and summarised: the stateful plan runs once
        try:
            judge_held(batch, batch_id)
        finally:
            batch.unpersist()

    def judge_held(batch: DataFrame, batch_id: int) -> None:
        closed = batch.select("service_name", "window_start", "window_end", "spans", "errors")
        (
            closed.withColumns({"dt": day_key("window_start"), "batch": F.lit(batch_id)})
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("dt", "batch").parquet(buckets_path)
        )
        start = F.min("window_start") - F.expr(f"INTERVAL {hold * WIDTH_SECONDS} SECONDS")
        reach = closed.agg(day_key(start).alias("day"), F.unix_micros(start).alias("micros")).first()
        if reach["day"] is None:
            return
        # Only the folders of the days looked at are listed, however old the table is.
        days = [d for d in table_days(spark, buckets_path) if d >= reach["day"]]
        recent = (
            spark.read.option("basePath", buckets_path).parquet(*[f"{buckets_path}/dt={d}" for d in days])
            .filter((F.col("batch") <= batch_id) & (F.unix_micros("window_start") >= reach["micros"]))
        )
        fired = held_breaches(recent, rule, threshold, hold)
        # Runs that were complete before this batch have fired already.
        mine = recent.filter(F.col("batch") == batch_id).select("service_name", F.col("window_end").alias("timestamp"))
        write_signal(
            fired.join(mine, ["service_name", "timestamp"], "left_semi"), "alert_triggers", triggers_path, f"{rule}-{batch_id}"
        )

    return (
        red_windows(traces, f"{WIDTH_SECONDS} seconds", delay=delay)
        .writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger(live, interval))
        .foreachBatch(judge)
        .start()
    )
