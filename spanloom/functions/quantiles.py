"""Exact quantiles per group without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .spread import lookup_join

# Bands per factor e of the value: neighbouring bands differ by about 1.6 %.
BANDS_PER_E = 64
# Bands a wide band is cut into when it is counted again.
SUB_BANDS = 4096
# Rows of a band that may be ranked in one window; a band of more is counted again in sub-bands.
ROWS_PER_WINDOW = 1_000_000


def value_band(value: Column) -> Column:
    """Band number that never decreases as the value grows."""
    size = F.floor(F.log1p(F.abs(value.cast("double"))) * F.lit(BANDS_PER_E)).cast("bigint")
    return F.when(value < 0, -size).otherwise(size)


def _rank_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("_rank")]


def _counted(rows: DataFrame, keys: Sequence[str], band: Column) -> DataFrame:
    """Per band: rows, least and greatest value, and what all rows of its keys carry."""
    carried = [c for c in rows.columns if c == "_from" or c.startswith("_rank")]
    return rows.groupBy(*keys, band.alias("_band")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_value").alias("_low"), F.max("_value").alias("_high"), *[F.max(c).alias(c) for c in carried]
    )


def _holding(bands: DataFrame, keys: Sequence[str], order: str = "_band") -> DataFrame:
    """The bands that hold a wanted rank, ``_from`` being the rows before them; ranks they do not hold are NULL."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ranks = _rank_names(bands)
    placed = bands.withColumn("_cum", F.sum("_n").over(upto) + F.col("_from")).withColumn("_from", F.col("_cum") - F.col("_n"))
    held = {r: F.when((F.col(r) > F.col("_from")) & (F.col(r) <= F.col("_cum")), F.col(r)) for r in ranks}
    return placed.withColumns(held).filter(F.coalesce(*ranks).isNotNull()).select("_group", "_from", "_n", "_low", "_high", *ranks)


def _inside(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows inside a wanted band, with that band's ``_first`` and ``_last`` value, ``_from`` and ranks.

    A group has at most one wanted band for each quantile, so they travel as one short list.
    """
    band = F.struct(F.col("_low").alias("_first"), F.col("_high").alias("_last"), "_from", *_rank_names(wanted))
    lists = wanted.groupBy("_group").agg(F.collect_list(band).alias("_bands"))
    at = F.get(F.filter("_bands", lambda b: F.col("_value").between(b["_first"], b["_last"])), F.lit(0))
    met = lookup_join(rows, lists, ["_group"], how="inner")
    return met.select("_group", "_value", at.alias("_in")).filter("_in IS NOT NULL").select("_group", "_value", "_in.*")


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, quantiles: Mapping[str, float], rows_per_window: int = ROWS_PER_WINDOW
) -> DataFrame:
    """One row per group with the smallest value whose rank reaches ``q * n``; NULL values do not count.

    The first pass runs at once: it counts rows per band of values, a few thousand
    bands per group however many rows there are. A band that holds a wanted rank and
    more than ``rows_per_window`` rows is counted again in ``SUB_BANDS`` parts between
    its least and greatest value, until it is small enough or holds a single value,
    which then is the quantile. A pass narrows a band 4,096-fold, so 64-bit values
    take six at most. The last pass ranks the values of the small bands: no window
    holds more than ``rows_per_window`` of them. Groups with a NULL key are groups.
    """
    by = list(by)
    # A struct is equal to another whose fields are NULL in the same places.
    group = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("_all"))
    rows = df.select(group.alias("_group"), F.col(value).alias("_value")).filter("_value IS NOT NULL")
    bands = written(_counted(rows, ["_group"], value_band(F.col("_value"))), "quantile-bands")
    everything = F.sum("_n").over(Window.partitionBy("_group"))
    ranks = {f"_rank{i}": F.greatest(F.ceil(F.lit(float(q)) * everything), F.lit(1)).cast("bigint") for i, q in enumerate(quantiles.values())}
    wanted = _holding(bands.withColumns({**ranks, "_from": F.lit(0).cast("bigint")}), ["_group"])

    wide = (F.col("_n") > rows_per_window) & (F.col("_low") < F.col("_high"))
    if not bands.filter(wide).isEmpty():
        wanted = written(wanted, "quantile-wanted")
        while not (left := wanted.filter(wide)).isEmpty():
            step = (F.col("_value") - F.col("_first")).cast("double") / (F.col("_last") - F.col("_first")).cast("double")
            part = F.least(F.floor(step * SUB_BANDS), F.lit(SUB_BANDS - 1))
            again = _holding(_counted(_inside(rows, left), ["_group", "_first"], part), ["_group", "_first"])
            wanted = written(wanted.filter(~wide).unionByName(again), "quantile-wanted")

    one_value = F.col("_low") == F.col("_high")
    counted = _counted(_inside(rows, wanted.filter(~one_value)), ["_group", "_first"], F.col("_value"))
    found = _holding(counted, ["_group", "_first"]).unionByName(wanted.filter(one_value))
    named = [F.max(F.when(F.col(r).isNotNull(), F.col("_low"))).alias(name) for r, name in zip(ranks, quantiles)]
    return found.groupBy("_group").agg(*named).select(*[F.col(f"_group.{c}").alias(c) for c in by], *quantiles)
