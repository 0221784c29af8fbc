"""Audit events as JSON lines, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIT_SCHEMA = """
event_id string, event_type string, timestamp_utc timestamp, timestamp_unix bigint, user string, action string, resource string, result string,
ip_address string, user_agent string, details map<string,string>, session_id string,
compliance struct<gdpr_pii_processed:boolean,hipaa_phi_accessed:boolean,data_classification:string>
"""


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Audit rows of a text column; blank and malformed lines are skipped."""
    schema = AUDIT_SCHEMA + ", _corrupt string"
    parsed = lines.select(F.from_json(F.col(column), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("e"))
    return parsed.filter((F.trim(F.coalesce(F.col("e._corrupt"), F.lit(""))) == "") & F.col("e.event_type").isNotNull()).select("e.*").drop("_corrupt")


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))


def read_audit_or_empty(spark: SparkSession, path: str) -> DataFrame:
    """An absent log is an empty one."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], AUDIT_SCHEMA)
    return read_audit(spark, path)


def stream_audit(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.readStream.text(path))


def to_lines(events: DataFrame) -> DataFrame:
    """One JSON text per event; an event without an id or type becomes a redacted fallback line."""
    full = F.to_json(F.struct(*events.columns))
    fallback = F.to_json(F.struct(
        F.coalesce("event_id", F.lit("")).alias("event_id"), F.coalesce("event_type", F.lit("UNKNOWN")).alias("event_type"), F.lit("ANONYMIZED").alias("user"),
        F.col("action"), F.lit("REDACTED").alias("resource"), F.col("result"), F.lit("JSON_SERIALIZATION_FAILED").alias("error")))
    sound = F.col("event_id").isNotNull() & F.col("event_type").isNotNull()
    return events.select(F.when(sound, full).otherwise(fallback).alias("value"))


def append_audit(events: DataFrame, path: str) -> None:
    to_lines(events).write.mode("append").text(path)
