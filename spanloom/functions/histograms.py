"""Quantile of a bucketed histogram as a plain column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cumulative_counts(counts: Column) -> Column:
    """Running sum of per-bucket counts, wide enough for any number of unsigned 64-bit ones."""
    wide = "decimal(38,0)"
    return F.aggregate(
        counts,
        F.array().cast(f"array<{wide}>"),
        lambda acc, x: F.concat(acc, F.array((F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast(wide)) + x).cast(wide))),
    )


def histogram_quantile(
    bounds: Column | str, counts: Column | str, count: Column | str, q: float, cumulative: bool = True
) -> Column:
    """Value at quantile ``q``, linear inside the bucket that holds its rank.

    ``counts`` are "at or below this bound" counts when ``cumulative``, else
    counts per bucket. The first bucket starts at 0, ranks above the last
    bucket give the last bound, and an empty histogram gives NULL.
    """
    b = F.col(bounds) if isinstance(bounds, str) else bounds
    c = F.col(counts) if isinstance(counts, str) else counts
    n = F.col(count) if isinstance(count, str) else count
    cum = c if cumulative else cumulative_counts(c)
    rank = F.lit(float(q)) * n.cast("double")
    reached = F.filter(
        F.transform(cum, lambda x, i: F.when(x >= rank, i).otherwise(F.lit(-1))), lambda i: i >= 0
    )
    at = F.try_element_at(reached, F.lit(1))
    hi = F.get(b, at)
    lo = F.when(at == 0, F.lit(0.0)).otherwise(F.get(b, at - 1))
    upper = F.get(cum, at).cast("double")
    lower = F.when(at == 0, F.lit(0.0)).otherwise(F.get(cum, at - 1).cast("double"))
    inside = F.when(upper == lower, lo).otherwise(lo + (hi - lo) * (rank - lower) / (upper - lower))
    return F.when((n == 0) | (F.size(b) == 0), F.lit(None).cast("double")).otherwise(
        F.when(at.isNull(), F.element_at(b, -1)).otherwise(inside)
    )
