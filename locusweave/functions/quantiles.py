"""Exact order statistics per group by counting values first.

Positions are integers on a bounded axis, so a group has at most as many distinct values as its span.
The count per value is a combinable aggregate; the window then sees distinct values only.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ranked(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    times = F.sum(weight) if weight else F.count(F.lit(1))
    counted = df.groupBy(*keys, F.col(value).alias("value")).agg(times.alias("c"))
    per = Window.partitionBy(*keys)
    return counted.withColumn("upto", F.sum("c").over(per.orderBy("value"))).withColumn("n", F.sum("c").over(per))


def at_index(df: DataFrame, keys: list[str], value: str, index) -> DataFrame:
    """(keys, value, n): the element at 0-based ``index(n)`` of the sorted values."""
    r = _ranked(df, keys, value)
    return r.where(F.col("upto") > index(F.col("n"))).groupBy(*keys).agg(
        F.min("value").alias("value"), F.max("n").alias("n")
    )


def nearest_rank(df: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """Element at round((n - 1) * q), halves rounded up."""
    return at_index(df, keys, value, lambda n: F.floor((n - 1) * F.lit(q) + F.lit(0.5)))


def floor_rank(df: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """Element at floor((n - 1) * q)."""
    return at_index(df, keys, value, lambda n: F.floor((n - 1) * F.lit(q)))


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Element at n div 2."""
    return at_index(df, keys, value, lambda n: F.floor(n / F.lit(2)))


def middle_median(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Middle element, or the integer half of the sum of both middle ones (truncated); ``weight`` says how often a row counts."""
    r = _ranked(df, keys, value, weight)
    after = lambda i: F.min(F.when(F.col("upto") > i, F.col("value")))
    both = r.groupBy(*keys).agg(
        after(F.floor((F.col("n") - 1) / F.lit(2))).alias("lo"),
        after(F.floor(F.col("n") / F.lit(2))).alias("hi"),
        F.max("n").alias("n"),
    )
    return both.select(*keys, F.expr("(lo + hi) div 2").alias("value"), "n")


def two_sided(df: DataFrame, key: str, low: str, high: str, index) -> DataFrame:
    """(key, low, high, n): an element of both columns from one pass; ``index(n)`` may use column ``side``."""
    sides = F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("at")) for c in (low, high)])
    tall = df.select(key, F.explode(sides).alias("x")).select(key, "x.side", "x.at")
    picked = at_index(tall, [key, "side"], "at", index)
    of = lambda c: F.max(F.when(F.col("side") == c, F.col("value"))).alias(c)
    return picked.groupBy(key).agg(of(low), of(high), F.max("n").alias("n"))


def interpolated(col: str, q: float) -> Column:
    """Aggregate: linear-interpolation percentile rounded half away from zero."""
    return F.round(F.percentile(F.col(col), F.lit(q))).cast("bigint")
