"""Mergeable quantile sketches as tables of bucket counts, with DataFrame functions only.

A value (a whole number, 0 or more) falls in a bucket of relative width 1/32 at most; values under
64 have buckets of their own. A sketch is the count of each bucket: merging adds counts, so any
order of merging, any partitioning and any rerun give the same sketch, and a sketch has some hundred
rows however many values it holds. A quantile is the upper end of the bucket that reaches it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(value: Column) -> Column:
    """The bucket of a value; null for null."""
    v = value.cast("long")
    e = F.length(F.bin(v)) - 6
    return F.when(v < 64, F.greatest(v, F.lit(0))).otherwise(e * 32 + F.floor(v / F.pow(F.lit(2), e)))


def upper(code: Column) -> Column:
    """The largest value of a bucket."""
    e = F.floor(code / 32) - 1
    return F.when(code < 64, code).otherwise(((code - e * 32 + 1) * F.pow(F.lit(2), e) - 1).cast("long")).cast("long")


def sketch(df: DataFrame, keys: list[str], metrics: dict[str, Column]) -> DataFrame:
    """keys, metric, code, n: the sketches of each metric for each combination of keys."""
    rows = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bucket(c).alias("code")) for m, c in metrics.items()])).alias("s"))
    return rows.select(*keys, "s.*").where("code is not null").groupBy(*keys, "metric", "code").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches merged down to fewer keys."""
    return sketches.groupBy(*keys, "metric", "code").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], at: dict[str, float]) -> DataFrame:
    """keys, metric, n and a column for each named quantile."""
    w = Window.partitionBy(*keys, "metric")
    run = sketches.withColumns({"upto": F.sum("n").over(w.orderBy("code")), "total": F.sum("n").over(w)})
    return run.groupBy(*keys, "metric").agg(
        F.max("total").alias("n"), *[F.min(F.when(F.col("upto") >= F.lit(q) * F.col("total"), upper(F.col("code")))).alias(name) for name, q in at.items()]
    )
