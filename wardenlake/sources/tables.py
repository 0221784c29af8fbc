"""Table access: parquet in and out, and spreading of small CPU-heavy inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLIT_BYTES = 64 * 1024 * 1024
#: Session setting: the number of partitions over which inputs of CPU-heavy text work are dealt.
DEAL = "spark.wardenlake.deal"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate; grows with the files and is never a row count."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal an input of CPU-heavy work over ``spark.wardenlake.deal`` partitions, or as many as a shuffle has where that isn't set.

    A row group is never cut, so a file written as one row group is one task however many splits
    it has.  Set it to 0 where row groups are smaller than a split: nothing is shuffled then.
    Where texts are derived from a narrow table, deal that table (``derive(..., deal=True)``) and not the texts.
    Rows of equal ``keys``, if any are given, stay together.
    """
    conf = df.sparkSession.conf
    parts = int(conf.get(DEAL, conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *keys) if parts > 0 else df


def broadcast_if_small(df: DataFrame, limit: int = SPLIT_BYTES) -> DataFrame:
    """Hint a broadcast only while the estimate is under the limit; otherwise Spark shuffles."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def write_state(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "append") -> None:
    """Append rows of a state table (metrics, alerts, checks, budgets, index)."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_state(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)
