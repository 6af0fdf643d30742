"""The six telemetry signals: columns, types, clustering and retention."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NIL_UUID = "00000000-0000-0000-0000-000000000000"
U32_MAX, U64_MAX = 2**32 - 1, 2**64 - 1

# Column kinds. Telemetry has no NULLs: an absent value reads as the zero value
# of its kind. The one exception is ``time?``.
SPARK_TYPES: dict[str, T.DataType] = {
    "text": T.StringType(),
    "uuid": T.StringType(),
    "time": T.TimestampType(),
    "time?": T.TimestampType(),
    # Unsigned 64-bit integers, every one of them: a bigint ends at half the range.
    "u64": T.DecimalType(20, 0),
    "u32": T.LongType(),
    "double": T.DoubleType(),
    "doubles": T.ArrayType(T.DoubleType()),
    "u64s": T.ArrayType(T.DecimalType(20, 0)),
    "labels": T.MapType(T.StringType(), T.StringType()),
}


@dataclass(frozen=True)
class Signal:
    """One event table."""

    name: str
    columns: dict[str, str]
    sort_key: tuple[str, ...]
    retention_days: int
    # Column filled with a generated id when the producer leaves it out.
    generated_id: str | None = None
    # False when the id never comes from the wire.
    id_on_wire: bool = True

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, SPARK_TYPES[k], True) for n, k in self.columns.items()])

    @property
    def wire_columns(self) -> dict[str, str]:
        return {n: k for n, k in self.columns.items() if self.id_on_wire or n != self.generated_id}

    @property
    def row_id(self) -> str | None:
        """Column that names a row, None where the signal has none."""
        return self.generated_id or ("span_id" if "span_id" in self.columns else None)


# Column names, kinds and order, sort keys and retention are part
# of the data model and must stay as they are.
TRACES = Signal(
    "traces",
    {
        "trace_id": "text",
        "span_id": "text",
        "parent_span_id": "text",
        "timestamp": "time",
        "service_name": "text",
        "operation_name": "text",
        "span_kind": "text",
        "duration_ns": "u64",
        "status_code": "text",
        "attributes": "labels",
    },
    sort_key=("service_name", "timestamp", "trace_id"),
    retention_days=30,
)
LOGS = Signal(
    "logs",
    {
        "log_id": "uuid",
        "timestamp": "time",
        "trace_id": "text",
        "span_id": "text",
        "service_name": "text",
        "severity": "text",
        "env": "text",
        "k8s_cluster": "text",
        "k8s_namespace_name": "text",
        "k8s_resource_name": "text",
        "instrumentation_library_name": "text",
        "instrumentation_library_version": "text",
        "body": "text",
        "attributes": "labels",
    },
    sort_key=("service_name", "timestamp"),
    retention_days=30,
    generated_id="log_id",
    id_on_wire=False,
)
METRICS = Signal(
    "metrics",
    {
        "timestamp": "time",
        "metric_name": "text",
        "service_name": "text",
        "metric_type": "text",
        "value": "double",
        "bucket_bounds": "doubles",
        "bucket_counts": "u64s",
        "quantiles": "doubles",
        "quantile_values": "doubles",
        "sum": "double",
        "count": "u64",
        "labels": "labels",
    },
    sort_key=("service_name", "metric_name", "timestamp"),
    retention_days=30,
)
AI_SPANS = Signal(
    "ai_spans",
    {
        "trace_id": "text",
        "span_id": "text",
        "timestamp": "time",
        "service_name": "text",
        "agent_name": "text",
        "span_kind": "text",
        "llm_model": "text",
        "prompt_tokens": "u32",
        "completion_tokens": "u32",
        "total_tokens": "u32",
        "cost_usd": "double",
        "duration_ns": "u64",
        "status_code": "text",
        "attributes": "labels",
    },
    sort_key=("service_name", "agent_name", "timestamp"),
    retention_days=30,
)
INCIDENTS = Signal(
    "incidents",
    {
        "incident_id": "uuid",
        "timestamp": "time",
        "service_name": "text",
        "title": "text",
        "severity": "text",
        "status": "text",
        "alert_rule_id": "text",
        "resolved_at": "time?",
        "labels": "labels",
    },
    sort_key=("status", "service_name", "timestamp"),
    retention_days=90,
    generated_id="incident_id",
)
ALERT_TRIGGERS = Signal(
    "alert_triggers",
    {
        "trigger_id": "uuid",
        "incident_id": "uuid",
        "timestamp": "time",
        "status": "text",
        "message": "text",
        "service_name": "text",
        "trigger_count": "u32",
    },
    sort_key=("status", "timestamp"),
    retention_days=30,
    generated_id="trigger_id",
)

SIGNALS: dict[str, Signal] = {
    s.name: s for s in (TRACES, LOGS, METRICS, AI_SPANS, INCIDENTS, ALERT_TRIGGERS)
}


def zero_value(kind: str) -> Column:
    """What an absent field of this kind reads as."""
    if kind == "uuid":
        return F.lit(NIL_UUID)
    if kind == "text":
        return F.lit("")
    if kind in ("u64", "u32"):
        return F.lit(0).cast(SPARK_TYPES[kind])
    if kind == "double":
        return F.lit(0.0)
    if kind == "labels":
        return F.create_map().cast(SPARK_TYPES[kind])
    if kind in ("doubles", "u64s"):
        return F.array().cast(SPARK_TYPES[kind])
    return F.lit(None).cast(SPARK_TYPES[kind])
