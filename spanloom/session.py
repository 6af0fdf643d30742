"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from .functions.folders import delete

# Runtime settings every operator relies on. The time zone fixes what a
# timestamp means, duplicate JSON keys follow "last one wins", and the rest lets
# Spark re-plan skewed joins and keep streaming state small.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Tables in buckets of a trace id join on it and further keys without a shuffle.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # Split a hot key of a join even where a later step must then shuffle once more.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # Window, session and dedup state on disk rather than in the executors' heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "spanloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the runtime settings; ``conf`` keys may use ``__`` for a dot."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.ui.enabled", "false")
        # Call sites in error messages cost several driver round trips per column.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def work_folder(spark: SparkSession, label: str) -> str:
    """A new, unused folder for tables written between two steps of a job.

    It lies in the shared folder the cluster names in ``spark.checkpoint.dir``,
    which every executor can reach. Only when that is unset on a local master
    (tests, a laptop) a temporary folder takes its place and is remembered in the
    session; on a cluster an unset folder is an error. All work folders of an
    application lie in one folder, which is deleted when its driver ends: the
    tables may be read as long as the session that made them lives.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    mine = os.path.join(base, "spanloom", spark.sparkContext.applicationId)
    where = spark._jvm.org.apache.hadoop.fs.Path(mine)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    return os.path.join(mine, f"{label}-{uuid.uuid4().hex}")


# Folders made since the innermost open ``temporary`` began.
_open_scope: ContextVar[list[str] | None] = ContextVar("open_scope", default=None)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Delete at its end the small tables that operators write inside it.

    For work that repeats while the driver lives, such as a micro-batch or a panel
    that refreshes: results must be taken (collected, written) before it ends.
    """
    made: list[str] = []
    token = _open_scope.set(made)
    try:
        yield
    finally:
        _open_scope.reset(token)
        for folder in made:
            delete(spark, folder)


@contextmanager
def shuffles_freed(batch: DataFrame) -> Iterator[None]:
    """Delete shuffle files as soon as they are done with: those of the steps inside when each ends, those of a
    micro-batch's own plan at the end.

    Spark keeps them until the driver happens to collect its garbage, by when a stream has left those of many batches.
    """
    conf, name = batch.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        yield
    finally:
        conf.unset(name) if before is None else conf.set(name, before)
        batch._jdf.queryExecution().toRdd().cleanShuffleDependencies(False)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared work folder and read back.

    For small results that several later steps use: they are computed once, a
    lost executor does not bring the work back, and Spark plans what follows
    with their real size, broadcasting them only when that is small enough.
    """
    folder = work_folder(df.sparkSession, label)
    if (made := _open_scope.get()) is not None:
        made.append(folder)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
