"""Exact medians of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def grouped_median(df: DataFrame, keys: list[str], value: Column, width: float, out: str = "median") -> DataFrame:
    """Exact median per key without gathering a group.

    Equal values combine on the map side; buckets of ``width`` are counted to find those that hold the
    middle, and only their distinct values are ordered. A key with a third of all rows costs its
    buckets, not its rows. Nulls are left out; keys without values do not appear.
    """
    counts = df.select(*keys, value.alias("_v")).filter("_v is not null").groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_b", F.floor(F.col("_v") / F.lit(width)))
    buckets = counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_n"))
    part = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
    running = buckets.withColumns({"_upto": F.sum("_n").over(part.orderBy("_b")), "_all": F.sum("_n").over(part)})
    lo, hi = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    middle = running.filter((F.col("_upto") > lo) & (F.col("_upto") - F.col("_n") <= hi)).select(
        *keys, "_b", (F.col("_upto") - F.col("_n")).alias("_before"), "_all"
    )
    inside = counts.join(middle, [*keys, "_b"])
    upto = F.col("_before") + F.sum("_n").over(W.partitionBy(*keys, "_b").orderBy("_v"))
    ranked = inside.withColumn("_upto", upto).withColumn("_from", F.col("_upto") - F.col("_n"))
    at = lambda r: F.max(F.when((F.col("_from") <= r) & (F.col("_upto") > r), F.col("_v")))
    return ranked.groupBy(*keys).agg(((at(lo) + at(hi)) / 2).alias(out))


def mad(df: DataFrame, keys: list[str], x: str, width: float, out: str = "mad") -> DataFrame:
    """Median absolute deviation from the median."""
    centred = df.join(grouped_median(df, keys, F.col(x), width, "_m"), keys)
    return grouped_median(centred, keys, F.abs(F.col(x) - F.col("_m")), width, out)


def group_effects(df: DataFrame, keys: list[str], grp: str, r: str, width: float, min_group: int = 3) -> DataFrame:
    """Median of r and size per (key, group), for groups with enough rows."""
    sizes = df.filter(F.col(r).isNotNull()).groupBy(*keys, grp).agg(F.count("*").alias("n")).filter(F.col("n") >= min_group)
    return grouped_median(df, [*keys, grp], F.col(r), width, "effect").join(sizes, [*keys, grp])
