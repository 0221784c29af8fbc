"""Putting one-row aggregates of different tables side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_totals(*rows: DataFrame) -> DataFrame:
    """One row with the columns of all inputs; a missing number is zero.

    A union of one-row frames and a last aggregate, where a join would have no key.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    names = [c for row in rows for c in row.columns]
    return stacked.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in names])
