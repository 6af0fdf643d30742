"""Rounding and sums whose result does not depend on row order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_even(value: Column | str, digits: int) -> Column:
    """Round a double to ``digits`` places, ties of the scaled value to even."""
    scale = F.lit(10.0**digits)
    return F.rint(_col(value) * scale) / scale


def ns_to_ms(duration_ns: Column | str, digits: int) -> Column:
    """Nanoseconds as rounded milliseconds."""
    return round_even(_col(duration_ns).cast("double") / F.lit(1000000.0), digits)


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as double, 0 where the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole.cast("double"))


def sum_fixed(amount: Column | str) -> Column:
    """Sum of a double column that hardly depends on the order of the rows.

    Nine decimal places are added up exactly, as decimals; what lies beyond them, and
    amounts a decimal cannot hold, are added as doubles on top, so nothing is lost.
    """
    fixed, rest = split_fixed(amount)
    return F.coalesce(F.sum(fixed).cast("double"), F.lit(0.0)) + F.coalesce(F.sum(rest), F.lit(0.0))


def split_fixed(amount: Column | str) -> tuple[Column, Column]:
    """A double as nine decimal places (NULL where they do not fit) and the rest."""
    value = _col(amount)
    fixed = value.try_cast("decimal(28,9)")
    return fixed, F.when(fixed.isNull(), value).otherwise(value - fixed.cast("double"))


def sum_long(value: Column | str) -> Column:
    """Sum of 64-bit integers, signed or not, that cannot overflow, as a double."""
    return F.coalesce(F.sum(_col(value).cast("decimal(20,0)")).cast("double"), F.lit(0.0))


def mean_long(value: Column | str) -> Column:
    """Mean of 64-bit integers, signed or not, from their exact sum."""
    return F.sum(_col(value).cast("decimal(20,0)")).cast("double") / F.count(_col(value)).cast("double")
