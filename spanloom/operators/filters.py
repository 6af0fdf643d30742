"""Row filters over signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.maps import attribute


def with_attribute(df: DataFrame, key: str, value: str, column: str = "attributes") -> DataFrame:
    """Rows whose label map holds ``value`` under ``key``."""
    return df.filter(attribute(column, key) == value)


def body_contains(logs: DataFrame, term: str) -> DataFrame:
    """Log lines whose body holds ``term`` in any case."""
    return logs.filter(F.contains(F.lower("body"), F.lit(term.lower())))


def body_matches(logs: DataFrame, pattern: str) -> DataFrame:
    """Log lines whose body matches a regular expression."""
    return logs.filter(F.col("body").rlike(pattern))
