"""Incidents and the alert triggers that point to them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maps import row_hash
from ..functions.numeric import mean_long, round_even
from ..functions.ordered import SLICE_SECONDS
from ..functions.quantiles import exact_quantiles
from ..functions.spread import lookup_join
from ..functions.times import instant, seconds_between, slot
from ..session import written
from ..signals import NIL_UUID
from .traces import is_error

# Order in which an incident normally moves; a later state wins at equal times.
LIFECYCLE = ("open", "acknowledged", "resolved")


def correlated() -> Column:
    return F.coalesce(F.col("incident_id") != NIL_UUID, F.lit(False))


def latest_state(incidents: DataFrame, lifecycle: Sequence[str] = LIFECYCLE) -> DataFrame:
    """One row per incident: its latest state in an append-only table.

    An aggregate rather than a ranked window, so repeated states of one
    incident shrink inside each task before the shuffle.
    """
    stage = F.array_position(F.array(*[F.lit(s) for s in lifecycle]), F.col("status"))
    whole = [c for c in incidents.columns if c != "incident_id"]
    rest = [c for c in whole if c not in ("timestamp", "resolved_at", "status")]
    # The row travels once; what decides between equal states is a hash of it.
    order = F.struct("timestamp", stage.alias("_stage"), "resolved_at", "status", row_hash(incidents, rest).alias("_tie"))
    picked = incidents.groupBy("incident_id").agg(F.max_by(F.struct(*whole), order).alias("_row"))
    return picked.select("incident_id", "_row.*").select(*incidents.columns)


def active_incidents(incidents: DataFrame) -> DataFrame:
    """Incidents whose latest state is not resolved."""
    return latest_state(incidents).filter("status <> 'resolved'")


def triggers_with_incident(triggers: DataFrame, incidents: DataFrame) -> DataFrame:
    """Each trigger once, with the latest state of its incident.

    Triggers with the nil id cannot match and skip the join: they may be a
    large part of the table and would all meet in one task.
    """
    state = latest_state(incidents).select(
        "incident_id", F.col("title").alias("incident_title"), F.col("severity").alias("incident_severity"),
        F.col("status").alias("incident_status"), F.col("alert_rule_id"),
    )
    return lookup_join(triggers, state, ["incident_id"], match_if=correlated())


def uncorrelated_triggers(triggers: DataFrame) -> DataFrame:
    """Triggers not tied to an incident."""
    return triggers.filter(~correlated())


def dangling_triggers(triggers: DataFrame, incidents: DataFrame) -> DataFrame:
    """Triggers that name an incident the table does not hold."""
    known = incidents.select("incident_id").distinct()
    return lookup_join(triggers.filter(correlated()), known, ["incident_id"], how="left_anti")


def triggers_per_incident(triggers: DataFrame) -> DataFrame:
    """Per incident id: triggers, firing ones, summed counts, first and last."""
    return (
        triggers.filter(correlated())
        .groupBy("incident_id")
        .agg(
            F.count(F.lit(1)).alias("triggers"),
            F.count_if(F.col("status") == "firing").alias("firing"),
            F.sum("trigger_count").alias("trigger_count"),
            F.min("timestamp").alias("first_at"),
            F.max("timestamp").alias("last_at"),
        )
    )


def incident_alerts(incidents: DataFrame, triggers: DataFrame) -> DataFrame:
    """Each incident's latest state with the roll-up of its triggers."""
    joined = latest_state(incidents).join(triggers_per_incident(triggers), "incident_id", "left")
    return joined.fillna(0, ["triggers", "firing", "trigger_count"])


def rule_alerts(incidents: DataFrame, triggers: DataFrame) -> DataFrame:
    """Roll-up of triggers per alert rule, over the rule's incidents."""
    return (
        incident_alerts(incidents, triggers)
        .groupBy("alert_rule_id")
        .agg(
            F.count(F.lit(1)).alias("incidents"),
            F.sum("triggers").alias("triggers"),
            F.sum("firing").alias("firing"),
            F.sum("trigger_count").alias("trigger_count"),
            F.min("first_at").alias("first_at"),
            F.max("last_at").alias("last_at"),
        )
    )


def incident_stats(incidents: DataFrame, by: Sequence[str] = ("service_name", "severity")) -> DataFrame:
    """Incidents, resolved ones and time to resolve (mean, p50, p95) per group. Latest states are worked out at once."""
    by = list(by)
    resolved = F.when(F.col("status") == "resolved", seconds_between("timestamp", "resolved_at"))
    # One short row per incident, used by every pass.
    state = written(latest_state(incidents).select(*by, resolved.alias("ttr_s")), "incident-times")
    counts = state.groupBy(*by).agg(
        F.count(F.lit(1)).alias("incidents"),
        F.count("ttr_s").alias("resolved"),
        round_even(mean_long("ttr_s"), 3).alias("mean_ttr_s"),
    )
    quantiles = exact_quantiles(
        state.filter("ttr_s IS NOT NULL"), by, "ttr_s", {"p50_ttr_s": 0.5, "p95_ttr_s": 0.95}
    )
    return counts.join(quantiles, by, "left")


def incident_impact(
    incidents: DataFrame, traces: DataFrame, logs: DataFrame, as_of: datetime | str
) -> DataFrame:
    """Spans and logs of an incident's service while it was open.

    An unresolved incident counts up to ``as_of``. Rows in an interval are the
    running count at its end minus the running count just before its start, so
    no (incident, span) pair is ever formed however long incidents overlap. The
    running count has two levels: totals of every hour of a service, and counts by
    row only in those hours in which an incident begins or ends. There an edge of an
    incident stands among the spans and logs, behind those of its instant, so that one
    sort of narrow rows answers it: no table by instant is built and joined. Incidents'
    edges and the totals before each such hour are worked out at once.
    """
    counted = {
        "spans": ~F.col("is_log"), "error_spans": ~F.col("is_log") & F.col("failed"),
        "logs": F.col("is_log"), "error_logs": F.col("is_log") & F.col("failed"),
    }
    end = F.greatest(F.coalesce(F.col("resolved_at"), instant(as_of)), F.col("timestamp"))
    shown = ["incident_id", "severity", "timestamp", "ended_at"]
    edges = F.array(
        F.struct(F.lit(-1).alias("sign"), F.expr("timestamp - INTERVAL '0.000001' SECOND").alias("at")),
        F.struct(F.lit(1).alias("sign"), F.col("ended_at").alias("at")),
    )
    hour = slot("at", SLICE_SECONDS).alias("_hour")
    points = written(latest_state(incidents).withColumn("ended_at", end).select("service_name", *shown, F.inline(edges).alias("sign", "at")), "incident-edges")
    points = points.select("service_name", "at", hour, F.struct(*shown, "sign").alias("edge"))

    def rows(df: DataFrame, is_log: bool, failed: Column) -> DataFrame:
        return df.select("service_name", F.col("timestamp").alias("at"), F.lit(is_log).alias("is_log"), failed.alias("failed"))

    happened = rows(traces, False, is_error()).unionByName(rows(logs, True, F.col("severity") == "ERROR"))
    # A row without a service or time lies in no interval.
    happened = happened.dropna(subset=["service_name", "at"]).select("*", hour)
    both = happened.unionByName(points, allowMissingColumns=True)
    hours = both.groupBy("service_name", "_hour").agg(
        *[F.count_if(c).alias(n) for n, c in counted.items()], F.max(F.col("edge").isNotNull()).alias("asked")
    )
    earlier = Window.partitionBy("service_name").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    before = hours.select("service_name", "_hour", "asked", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_before") for n in counted])
    before = written(before.filter("asked").drop("asked"), "incident-hours")

    inside = happened.join(before, ["service_name", "_hour"], "left_semi").unionByName(points, allowMissingColumns=True)
    upto = Window.partitionBy("service_name", "_hour").orderBy("at", F.col("edge").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    running = inside.select("service_name", "_hour", "edge", *[F.count_if(c).over(upto).alias(n) for n, c in counted.items()])
    seen = running.filter("edge IS NOT NULL").join(before, ["service_name", "_hour"], "left")
    return seen.groupBy(F.col("edge.incident_id"), "service_name", *[F.col(f"edge.{c}") for c in shown[1:]]).agg(
        *[F.sum(F.col("edge.sign") * (F.col(n) + F.coalesce(F.col(f"{n}_before"), F.lit(0)))).cast("bigint").alias(n) for n in counted]
    )
