"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate = target share of the output / its size. A document's
number of copies is the Poisson quantile of that rate at a uniform number taken from a hash of
its id and the seed, so copies need no random state and come out alike on every run. Copies
are spread over the output by a second hash, a global shuffle; sources are never gathered.

The hash is MD5 of "seed:id" (first 52 bits), which SQL engines share.

Defined cases: a null source is a source of its own; a null id reads as the text ``null``;
a null text has size 0; a source of total size 0 keeps rate 1; rows repeated with an id get
equal counts; an empty table gives an empty result. Columns of the input stay as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, tuned

SEED = 7
#: Share of a source before scaling: its size to this power. 1 keeps natural shares, 0 makes all equal.
TEMPERATURE = 0.7


def uniform(text: Column) -> Column:
    """A number in [0, 1) from 52 bits of MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def id_text(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, temperature: float = TEMPERATURE,
                 source_col: str = "source", text_col: str = "text") -> DataFrame:
    """src, size, rate: one row per source; its size in code points, its mean repetition.

    ``weights`` are target shares by source, scaled to sum 1 over the sources present;
    sources it does not name get none. Without it shares are size ** temperature.
    """
    sizes = docs.groupBy(F.col(source_col).cast("string").alias("src")).agg(
        F.sum(F.length(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("size")
    )
    if weights is None:
        share = F.pow(F.col("size").cast("double"), F.lit(temperature))
    else:
        share = F.lit(0.0)
        for name, weight in weights.items():
            share = F.when(F.col("src") == name, F.lit(float(weight))).otherwise(share)
    shares = stored(sizes.withColumn("share", F.when(F.col("size") > 0, share).otherwise(F.lit(0.0))), "shares")
    all_size, all_share = shares.agg(F.sum("size"), F.sum("share")).first()  # one row
    if not all_share:  # no source has text and weight: nothing to scale to
        return shares.select("src", "size", F.when(F.col("size") > 0, 0.0).otherwise(1.0).alias("rate"))
    rate = F.lit(float(all_size)) * F.lit(float(epochs)) * F.col("share") / F.lit(float(all_share)) / F.col("size")
    return shares.select("src", "size", F.when(F.col("size") > 0, rate).otherwise(F.lit(1.0)).alias("rate"))


def window(rate: Column) -> tuple[Column, Column]:
    """The counts that matter: outside lies less than one 2^-53rd of the distribution on either side."""
    spread = F.sqrt(rate)
    low = F.when(rate >= 400, F.floor(rate - 9 * spread - 8)).otherwise(F.lit(0)).cast("long")
    return low, F.ceil(rate + 12 * spread + 24).cast("long")


def thresholds(rates: DataFrame) -> DataFrame:
    """Adds ``low`` and ``at_most``: the Poisson distribution function from ``low`` on, for any rate.

    One row for each count of a source's window, about 21 * sqrt(rate) of them, summed up in order
    and gathered: no step looks at what an earlier one has built. The first term comes from
    Stirling's series, and the sum is scaled to 1, so large rates neither underflow nor drift.
    """
    low, high = window(F.col("rate"))
    counts = rates.where("rate > 0").withColumn("low", low).select("src", "rate", "low", F.explode(F.sequence("low", high)).alias("k"))
    at = F.col("low").cast("double")
    series = 1 / (12 * at) - 1 / (360 * F.pow(at, F.lit(3))) + 1 / (1260 * F.pow(at, F.lit(5)))
    gap = F.col("rate") - at
    first = F.when(at == 0, -F.col("rate")).otherwise(at * F.log1p(gap / at) - gap - F.log(2 * math.pi * at) / 2 - series)
    by_source = Window.partitionBy("src").orderBy("k")
    change = F.when(F.col("k") == F.col("low"), first).otherwise(F.ln(F.col("rate") / F.col("k")))
    terms = counts.withColumn("term", F.exp(F.sum(change).over(by_source)))
    sums = terms.withColumn("sum", F.sum("term").over(by_source)).withColumn("all", F.sum("term").over(Window.partitionBy("src")))
    share = F.when(F.col("low") == 0, F.col("sum")).otherwise(F.col("sum") / F.col("all"))
    lists = sums.groupBy(F.col("src").alias("its_src")).agg(F.min("low").alias("low"), F.array_sort(F.collect_list(F.struct("k", share.alias("at_most")))).alias("found"))
    lists = lists.select("its_src", "low", F.transform("found", lambda x: x["at_most"]).alias("at_most"))
    joined = rates.join(lists, F.col("src").eqNullSafe(F.col("its_src")), "left")
    # Without a rate there is no copy: even no copies at all is at most any number.
    return joined.select("src", "rate", F.coalesce("low", F.lit(0)).alias("low"), F.coalesce("at_most", F.array(F.lit(1.0))).alias("at_most"))


BLOCK = 4096  # copies numbered at once


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, temperature: float = TEMPERATURE, seed: int = SEED,
              id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """row (the input row), copy (from 1), rate, place: every copy, dealt out by place and sorted.

    Rates have one row per source and are broadcast only while Spark finds them small;
    otherwise their join shuffles, with hot sources split. A document looks at no more
    thresholds than a small multiple of the copies it yields, and numbers its copies a
    block at a time, so a rate of a million is a million rows and no long list.
    """
    spark = tuned(docs.sparkSession)
    rates = stored(source_rates(docs, weights, epochs, temperature, source_col, text_col).select("src", "rate"), "source-rates")
    rates = stored(thresholds(rates), "rates")
    rows = docs.select(F.struct("*").alias("row"), F.col(source_col).cast("string").alias("source_key"), id_text(F.col(id_col)).alias("id_text"))
    u = uniform(F.concat(F.lit(f"{seed}:"), "id_text"))
    reached = F.size(F.filter("at_most", lambda c: c <= F.col("u"))).cast("long")
    counted = rows.join(rates, F.col("source_key").eqNullSafe(F.col("src"))).withColumn("u", u).withColumn("copies", F.col("low") + reached).drop("at_most")
    last = F.floor((F.col("copies") - 1) / BLOCK).cast("long")
    blocks = counted.where("copies > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    copies = blocks.withColumn("copy", F.explode(F.sequence(F.col("block") * BLOCK + 1, F.least("copies", (F.col("block") + 1) * BLOCK))))
    placed = copies.withColumn("place", uniform(F.concat(F.lit(f"{seed}:"), "id_text", F.lit(":"), F.col("copy").cast("string"))))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(parts, "place").sortWithinPartitions("place").select("row", "copy", "rate", "place")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: columns of the input, a row for each copy."""
    return replicate(docs, **options).select("row.*")
