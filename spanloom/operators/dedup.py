"""Removing repeated rows left by producers that sent a request again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.maps import row_hash


def earliest_per_id(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """One row per id: the earliest, ties settled by a hash of the row.

    An aggregate, so repeats of one id shrink inside each task before the
    shuffle; the row travels once, its maps as they are.
    """
    rest = [c for c in df.columns if c not in ids]
    order = F.struct("timestamp", row_hash(df, rest).alias("_tie"))
    picked = df.groupBy(*ids).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*ids, "_row.*").select(*df.columns)
