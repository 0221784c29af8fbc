"""Ordered computations over keys that may hold a large share of all rows.

A plain window over a hot key runs in one task.  These helpers split the key's
rows into ordered segments, work inside each segment, and carry one small summary
row per segment across.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window



def with_segment(df: DataFrame, segment: Column) -> DataFrame:
    return df.withColumn("_segment", segment)


def _attach(df: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Join one summary row per (key, segment) back; a hot segment may be split by AQE."""
    return df.join(summary, [*keys, "_segment"], "left")


def number_rows(df: DataFrame, keys: list[str], order: list[str], segment: Column, out: str = "ordinal") -> DataFrame:
    """Exact 1-based row number per key.  ``segment`` must grow with ``order``."""
    parts = with_segment(df, segment)
    before = Window.partitionBy(*keys).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    counts = (parts.groupBy(*keys, "_segment").agg(F.count("*").alias("_n"))
              .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    inside = Window.partitionBy(*keys, "_segment").orderBy(*order)
    ranked = parts.withColumn("_rank", F.row_number().over(inside))
    return _attach(ranked, counts, keys).withColumn(out, F.col("_before") + F.col("_rank")).drop("_segment", "_before", "_rank")


def last_before(df: DataFrame, keys: list[str], order: list[str], segment: Column, value: Column, out: str) -> DataFrame:
    """Last non-null ``value`` among the rows strictly before each row of its key."""
    parts = with_segment(df, segment).withColumn("_value", value)
    filled = F.when(F.col("_value").isNotNull(), F.struct(*[F.col(c) for c in order]))
    last_of = parts.groupBy(*keys, "_segment").agg(F.max_by("_value", filled).alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    carry = last_of.withColumn("_carry", F.last("_last", ignorenulls=True).over(earlier)).drop("_last")
    inside = Window.partitionBy(*keys, "_segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = parts.withColumn("_near", F.last("_value", ignorenulls=True).over(inside))
    return _attach(near, carry, keys).withColumn(out, F.coalesce("_near", "_carry")).drop("_segment", "_value", "_near", "_carry")


def running_sum(df: DataFrame, keys: list[str], order: list[str], segment: Column, value: Column, out: str) -> DataFrame:
    """Inclusive running sum per key."""
    parts = with_segment(df, segment).withColumn("_value", value)
    earlier = Window.partitionBy(*keys).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    totals = (parts.groupBy(*keys, "_segment").agg(F.sum("_value").alias("_t"))
              .withColumn("_carry", F.coalesce(F.sum("_t").over(earlier), F.lit(0))).drop("_t"))
    inside = Window.partitionBy(*keys, "_segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = parts.withColumn("_sum", F.sum("_value").over(inside))
    return _attach(summed, totals, keys).withColumn(out, F.col("_sum") + F.col("_carry")).drop("_segment", "_value", "_sum", "_carry")


def last_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows per key in ``order``; each task keeps at most n per key before the shuffle."""
    ranking = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(ranking)).filter(F.col("_rank") <= n).drop("_rank")


