"""Joins to a lookup table that keep going when one key holds most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys hash into this many buckets when looking for hot ones. It bounds the
# only table this module broadcasts. Beyond 1.3e11 rows a part holds a 65,536th of
# the rows, which is a small share of any one executor's work at that size.
KEY_BUCKETS = 65_536
# Rows one task should take at least before splitting a bucket is worth it.
ROWS_PER_TASK = 2_000_000


def key_bucket(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(KEY_BUCKETS)).cast("int")


def hot_buckets(
    df: DataFrame, keys: Sequence[str], weight: str | None = None, rows_per_task: int | None = None
) -> DataFrame:
    """Buckets far above the average, with the number of parts to split each in.

    At most ``KEY_BUCKETS`` rows whatever the size of ``df``: counts combine
    inside each task first, so only the counts are shuffled. The number of
    parts grows with the bucket.
    """
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.groupBy(key_bucket(keys).alias("_bucket")).agg(size.alias("n"))
    # One row holding at most KEY_BUCKETS small structs.
    packed = counts.agg(F.collect_list(F.struct("_bucket", "n")).alias("b"), F.sum("n").alias("total"))
    target = F.greatest(F.lit(float(rows_per_task or ROWS_PER_TASK)), F.col("total") / F.lit(float(KEY_BUCKETS)))
    return (
        packed.select(F.explode("b").alias("b"), target.alias("target"))
        .filter(F.col("b.n") > 2 * F.col("target"))
        .select(F.col("b._bucket").alias("_bucket"), F.ceil(F.col("b.n") / F.col("target")).cast("int").alias("_parts"))
    )


def split_rows(df: DataFrame, keys: Sequence[str], spread: Sequence[str], hot: DataFrame) -> DataFrame:
    """Add ``_part``: rows of a hot bucket get parts by the hash of ``spread``.

    The hash is of the row's own values, so a task that runs again after an
    executor was lost puts every row in the same part.
    """
    part = F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.col("_parts")).cast("int")
    return (
        df.withColumn("_bucket", key_bucket(keys))
        .join(F.broadcast(hot), "_bucket", "left")
        .withColumn("_part", F.coalesce(part, F.lit(0)))
        .drop("_bucket", "_parts")
    )


def copy_rows(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> DataFrame:
    """Add ``_part``: one copy of a row per part of its bucket."""
    parts = F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)
    return (
        df.withColumn("_bucket", key_bucket(keys))
        .join(F.broadcast(hot), "_bucket", "left")
        .withColumn("_part", F.explode(parts))
        .drop("_bucket", "_parts")
    )


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str] = (),
    how: str = "left",
    match_if: Column | None = None,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Join ``left`` to ``right``, which has at most one row per key.

    A hot key on the left is split while the join runs: adaptive execution cuts a
    shuffle partition far above the others along its map tasks and gives each cut
    the lookup rows of that partition (the session settings let it do so even if a
    later step then needs a shuffle). Nothing is counted beforehand. With
    ``rows_per_task`` the rows of hot buckets are dealt out by ``spread`` instead,
    after a counting pass. With ``match_if``, left rows that cannot match by rule
    (an empty or nil key) skip the join and come back with NULLs.
    """
    keys = list(keys)
    # A rule that is NULL (a NULL key) says no, so every left row is in exactly one branch.
    match_if = None if match_if is None else F.coalesce(match_if, F.lit(False))
    candidates = left if match_if is None else left.filter(match_if)
    if rows_per_task is None:
        joined = candidates.join(right, keys, how)
    else:
        hot = hot_buckets(candidates, keys, rows_per_task=rows_per_task)
        joined = split_rows(candidates, keys, spread, hot).join(copy_rows(right, keys, hot), [*keys, "_part"], how).drop("_part")
    if how in ("left_semi", "left_anti", "semi", "anti"):
        joined = joined.select(*left.columns)
    else:
        joined = joined.select(*left.columns, *[c for c in right.columns if c not in keys])
    if match_if is None or how in ("inner", "left_semi", "semi"):
        return joined
    return joined.unionByName(left.filter(~match_if), allowMissingColumns=True)


def null_safe_join(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    """Join on equal keys where NULL equals NULL; ``by`` appears once."""
    names = {k: f"_right_{k}" for k in by}
    right = right.withColumnsRenamed(names)
    match = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return left.join(right, match, how).drop(*names.values())
