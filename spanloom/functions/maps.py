"""Attribute and label maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def attribute(labels: Column | str, key: str) -> Column:
    """Value under ``key``; a missing key reads as the empty string."""
    m = F.col(labels) if isinstance(labels, str) else labels
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(""))


def label_key(labels: Column | str) -> Column:
    """A map as text that can be joined on, partitioned by and sorted."""
    m = F.col(labels) if isinstance(labels, str) else labels
    return F.to_json(F.array_sort(F.map_entries(m)))


def row_hash(df: DataFrame, columns: Sequence[str]) -> Column:
    """A hash of these columns' values that settles ties; maps count by their sorted entries."""
    parts = [F.sort_array(F.map_entries(c)) if isinstance(df.schema[c].dataType, T.MapType) else F.col(c) for c in columns]
    return F.xxhash64(*parts) if parts else F.lit(0).cast("bigint")


def zip_pairs(names: Column | str, values: Column | str) -> Column:
    """Two parallel arrays as one array of pairs."""
    return F.arrays_zip(F.col(names) if isinstance(names, str) else names,
                        F.col(values) if isinstance(values, str) else values)
