"""Registered queries: a Spark function and, where SQL can say it, the same in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardenlake.sources.tables import load, spread

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def derive(spark: SparkSession, sf_dir: str, sql: str, *tables: str, deal: bool = False) -> DataFrame:
    """Run a SELECT that both engines accept; ``{table}`` names a given table.  ``deal`` spreads the rows of the tables over tasks first."""
    for t in tables:
        sql = sql.replace("{" + t + "}", f"wl_{t}")
        rows = load(spark, sf_dir, t)
        (spread(rows) if deal else rows).createOrReplaceTempView(f"wl_{t}")
    return spark.sql(sql)


def plain(sql: str) -> str:
    """The same SELECT with bare table names, for the oracle."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)
