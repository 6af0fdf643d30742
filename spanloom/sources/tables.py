"""Reading day-partitioned signal tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.folders import names_in
from ..functions.times import day_key, instant
from ..session import tune
from ..signals import SIGNALS

# A compaction that is under way leaves a file "<dt>.<label>.<state>" here; readers never list it as data.
SWAPS = "_swaps"
STAGED, SWITCHED = "staged", "switched"


def swaps(spark: SparkSession, path: str) -> dict[tuple[int, str], str]:
    """State of each compaction under way, by day and label of its new copy; usually empty."""
    found: dict[tuple[int, str], str] = {}
    for name in names_in(spark, f"{path}/{SWAPS}"):
        dt, label, state = name.split(".")
        if found.get((int(dt), label)) != SWITCHED:
            found[int(dt), label] = state
    return found


def read_signal(spark: SparkSession, path: str, signal: str, days: Sequence[int] | None = None) -> DataFrame:
    """A signal table with its partition column ``dt``; an empty folder reads as no rows.

    With ``days`` only the folders of those days are listed, however old the table
    is. Of a day that is being compacted either the old folders or the new copy
    are read, never both and never neither.
    """
    return _with_batch(spark, path, signal, days).drop("batch")


def _with_batch(spark: SparkSession, path: str, signal: str, days: Sequence[int] | None) -> DataFrame:
    """A signal table with both folder columns, ``dt`` and ``batch``."""
    columns = SIGNALS[signal].schema.fields
    folders = [T.StructField("dt", T.IntegerType()), T.StructField("batch", T.StringType())]
    schema = T.StructType([*columns, *folders])
    folder_names = None if days is None else [f"dt={d}" for d in sorted(set(days))]
    while True:
        pending = swaps(spark, path)
        if folder_names is None:
            table = spark.read.schema(schema).parquet(path)
        else:
            held = set(names_in(spark, path))
            wanted = [f"{path}/{n}" for n in folder_names if n in held]
            table = spark.read.option("basePath", path).schema(schema).parquet(*wanted) if wanted else spark.createDataFrame([], schema)
        if swaps(spark, path) == pending:  # the files listed belong to this state
            break
    for (dt, label), state in pending.items():
        new = F.col("batch") == label
        table = table.filter((F.col("dt") != dt) | (new if state == SWITCHED else ~new))
    return table


def count_rows(spark: SparkSession, path: str, signal: str, days: Sequence[int] | None = None) -> DataFrame:
    """dt, n: stored rows per day, from the footers of the files; no column is read.

    The Parquet reader of Spark's second source API pushes a count down to the files;
    a session of its own chooses it for this one read.
    """
    own = tune(spark.newSession())
    setting = "spark.sql.sources.useV1SourceList"
    own.conf.set(setting, ",".join(s for s in own.conf.get(setting).split(",") if s.strip() != "parquet"))
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    # Files answer for whole folders only, so counts are taken by folder first.
    per_folder = _with_batch(own, path, signal, days).groupBy("dt", "batch").agg(F.count(F.lit(1)).alias("n"))
    return per_folder.groupBy("dt").agg(F.sum("n").alias("n"))


def days_between(spark: SparkSession, start: datetime | str, end: datetime | str) -> list[int]:
    """Day keys of the rows with ``start <= timestamp < end``, oldest first."""
    last = instant(end) - F.expr("INTERVAL '0.000001' SECOND")
    days = F.sequence(F.to_date(instant(start)), F.to_date(last), F.expr("INTERVAL 1 DAY"))
    asked = spark.range(1).select(F.when(last >= instant(start), F.transform(days, day_key)).alias("d")).first()
    return list(asked["d"] or ())


def read_range(spark: SparkSession, path: str, signal: str, start: datetime | str, end: datetime | str) -> DataFrame:
    """Rows of a stored signal with ``start <= timestamp < end``.

    The range itself chooses the day folders, before anything is listed: the
    cost of a read does not grow with the age of the table.
    """
    return time_range(read_signal(spark, path, signal, days_between(spark, start, end)), start, end)


def time_range(df: DataFrame, start: datetime | str, end: datetime | str) -> DataFrame:
    """Rows with ``start <= timestamp < end``, reading only the days concerned.

    A filter on ``timestamp`` alone reads every day folder; the filter on ``dt``
    is what prunes.
    """
    wanted = df.filter((F.col("timestamp") >= instant(start)) & (F.col("timestamp") < instant(end)))
    if "dt" in df.columns:
        wanted = wanted.filter(F.col("dt").between(day_key(instant(start)), day_key(instant(end))))
    return wanted
