"""Nearest-rank quantiles and running sums over grouped rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(df: DataFrame, keys: list[str], value: str, percent: int, out: str) -> DataFrame:
    """Per key, the value at 0-based rank min(n - 1, n * percent div 100) of the ascending values.

    Values are counted first, so a key's rows are as many as its distinct values.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    up = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    ranked = counts.withColumns({"_cum": F.sum("_c").over(up), "_n": F.sum("_c").over(every)})
    hit = ranked.where(F.col("_cum") > F.least(F.col("_n") - 1, F.expr(f"(_n * {percent}) div 100")))
    return hit.groupBy(*keys).agg(F.min(value).alias(out))


def weighted_rank(df: DataFrame, keys: list[str], value: str, weight: str, q: float, out: str) -> DataFrame:
    """Per key, the least value at which the running weight reaches q of the total."""
    sums = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    up = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = sums.withColumns({"_cum": F.sum("_w").over(up), "_n": F.sum("_w").over(Window.partitionBy(*keys))})
    return ranked.where(F.col("_cum") >= F.col("_n") * F.lit(q)).groupBy(*keys).agg(F.min(value).alias(out))


def count() -> Column:
    return F.count(F.lit(1)).cast("long")
