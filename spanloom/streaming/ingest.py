"""Continuous ingest of payload files into signal tables."""

from __future__ import annotations

from collections import Counter, defaultdict
from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions.times import expires_at, instant
from ..session import shuffles_freed, temporary
from ..signals import SIGNALS
from ..sinks.counters import CounterTable
from ..sinks.tables import write_rejected, write_signal
from ..sources.payloads import accepted_rows, decode, number_copies, read_payloads, rejected_payloads, shows_payload_id

# Pace of a live stream: how long rows wait before they can be queried.
LIVE_INTERVAL = "2 seconds"


def trigger(live: bool, interval: str = LIVE_INTERVAL) -> dict:
    """Trigger options: a steady interval, or everything there is and then stop."""
    return {"processingTime": interval} if live else {"availableNow": True}


def ingest(
    spark: SparkSession,
    source: str,
    signal: str,
    table: str,
    rejected: str,
    checkpoint: str,
    name: str = "ingest",
    live: bool = True,
    interval: str = LIVE_INTERVAL,
    max_files_per_trigger: int | None = None,
    max_bytes_per_trigger: str | None = None,
    counters: str | None = None,
    spread: bool = False,
) -> StreamingQuery:
    """Decode payload files as they arrive; good rows to ``table``, the rest to ``rejected``.

    Every micro-batch writes under its own label, so one that is replayed after
    a failure replaces what its first try left. ``name`` keeps several streams
    into one table apart. ``max_files_per_trigger`` or ``max_bytes_per_trigger``
    (one of them) bounds a batch; files beyond it wait. Progress reports carry the counts under ``intake``;
    with ``counters`` a counter table there keeps them by batch, over restarts and replays.
    A compressed file is read by one task; with ``spread`` its lines are dealt out before they are
    decoded, for batches of fewer such files than there are cores.
    """
    payloads = read_payloads(
        spark, source, streaming=True, max_files_per_trigger=max_files_per_trigger, max_bytes_per_trigger=max_bytes_per_trigger, spread=spread
    )
    ok = F.col("status") == "ok"
    decoded = decode(payloads, signal).observe(
        "intake",
        F.count(F.lit(1)).alias("payloads"),
        F.sum(F.when(ok, F.col("n_rows")).otherwise(0)).alias("accepted"),
        F.sum(F.when(ok, 0).otherwise(F.col("n_rows"))).alias("rejected"),
    )

    def store(batch: DataFrame, batch_id: int) -> None:
        label = f"{name}-{batch_id}"
        # A payload needs its text only if it is set aside, and its elements only if it is taken.
        kept = batch.withColumns({
            "source": F.when(~ok, F.col("source")), "value": F.when(~ok, F.col("value")), "elements": F.when(ok, F.col("elements")),
        }).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            with temporary(spark), shuffles_freed(batch):
                # An id that nothing names needs no number: rows of most signals bring their own.
                each = number_copies(kept, shows_payload_id(signal))
                write_signal(accepted_rows(each, signal), signal, table, label)
                write_rejected(rejected_payloads(each), rejected, label)
            if counters:
                CounterTable(spark, counters).put(f"{name}-{signal}", batch_id, **intake_counts(kept))
        finally:
            kept.unpersist()

    return (
        decoded.writeStream.queryName(f"{name}-{signal}")
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger(live, interval))
        .foreachBatch(store)
        .start()
    )


def intake_counts(decoded: DataFrame) -> dict[str, int]:
    """Payloads by status, and rows accepted and rejected, of decoded payloads: a handful of numbers."""
    counts: Counter = Counter(payloads=0, accepted=0, rejected=0)
    by_status = decoded.groupBy("status").agg(F.count(F.lit(1)).alias("payloads"), F.sum("n_rows").cast("bigint").alias("rows"))
    for r in by_status.collect():  # one row per status
        counts["payloads"] += r["payloads"]
        counts[f"payloads_{r['status']}"] = r["payloads"]
        counts["accepted" if r["status"] == "ok" else "rejected"] += r["rows"]
    return dict(counts)


def dedup_by_id(stream: DataFrame, ids: list[str], within: str) -> DataFrame:
    """First row of each id; ids are remembered for ``within`` of event time."""
    return stream.withWatermark("timestamp", within).dropDuplicatesWithinWatermark(ids)


def lateness(df: DataFrame, signal: str, as_of: datetime | str, watermark: datetime | str) -> DataFrame:
    """Add ``arrival``: 'expired' past retention, 'late' behind the watermark, else 'on_time'."""
    past = expires_at("timestamp", SIGNALS[signal].retention_days) <= instant(as_of)
    late = F.col("timestamp") < instant(watermark)
    return df.withColumn("arrival", F.when(past, "expired").when(late, "late").otherwise("on_time"))


def lateness_counts(df: DataFrame, signal: str, as_of: datetime | str, watermark: datetime | str) -> DataFrame:
    """Rows and days per arrival class."""
    per_day = (
        lateness(df, signal, as_of, watermark)
        .groupBy("arrival", F.to_date("timestamp").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return per_day.groupBy("arrival").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_days"))


class Counters(StreamingQueryListener):
    """Running counters of every query of a session, over all its micro-batches.

    A query itself holds only its last progress reports; this adds up each one as
    it comes. Register it with ``spark.streams.addListener`` before the queries start.
    With a ``table`` each report is also kept there, by the query's id and the batch:
    a restarted query goes on with its sums, and a batch that is replayed counts once.
    """

    def __init__(self, table: CounterTable | None = None) -> None:
        self.totals: dict[str, Counter] = defaultdict(Counter)  # by run id of the query
        self.table = table

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        late = sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)
        # The table first: who sees the sums finds them there too.
        if self.table and (progress.numInputRows or late):
            self.table.put(str(progress.id), progress.batchId, rows=progress.numInputRows, late=late)
        total = self.totals[str(progress.runId)]
        total["late"] += late
        if "intake" in progress.observedMetrics:
            total.update({k: v or 0 for k, v in progress.observedMetrics["intake"].asDict().items()})
        total["rows"] += progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def of(self, query: StreamingQuery) -> Counter:
        """rows read, late (left out behind the watermark) and, for ingest, payloads, accepted, rejected."""
        return self.totals[str(query.runId)]
