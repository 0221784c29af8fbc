"""Operation log: idempotent results, approvals, workspace use and expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INPUTS = ["action", "workspace_id", "migration_type", "source_revision"]


def deduplicate(operations: DataFrame) -> DataFrame:
    """First record per operation id, with a flag for repeats that had other inputs.

    Both come from partial aggregates, so an id repeated a billion times is reduced in
    each task before the shuffle: the inputs differ exactly when their smallest and
    largest value differ.
    """
    inputs = F.struct(*INPUTS)
    kept = [c for c in operations.columns if c != "operation_id"]
    return operations.groupBy("operation_id").agg(
        F.min_by(F.struct(*kept), F.struct("created_at", *INPUTS)).alias("first"), F.count("*").alias("attempts"),
        F.min(inputs).alias("_lo"), F.max(inputs).alias("_hi")).select(
        "operation_id", "first.*", "attempts", (F.col("_lo") != F.col("_hi")).alias("conflict"))


def status(requested: DataFrame, operations: DataFrame) -> DataFrame:
    """completed or not_found per requested id."""
    known = operations.select("operation_id").distinct().withColumn("_found", F.lit(True))
    return requested.join(known, "operation_id", "left").select("operation_id", F.when(F.col("_found"), "completed").otherwise("not_found").alias("status"))


def approval_violations(applies: DataFrame, previews: DataFrame) -> DataFrame:
    """Applies without an earlier dry run of the same workspace and revision.

    The dry runs are reduced to the earliest one per id, workspace and revision, so
    the join side is unique and no pair list is built.
    """
    earliest = previews.groupBy(F.col("operation_id").alias("dry_run_id"), "workspace_id", "source_revision").agg(F.min("created_at").alias("_preview_at"))
    joined = applies.join(earliest, ["dry_run_id", "workspace_id", "source_revision"], "left")
    by_id = previews.select(F.col("operation_id").alias("dry_run_id")).distinct().withColumn("_known", F.lit(True))
    failing = joined.filter(F.col("_preview_at").isNull() | (F.col("_preview_at") > F.col("created_at"))).join(by_id, "dry_run_id", "left")
    reason = (F.when(F.col("_known").isNull(), "missing_dry_run").when(F.col("_preview_at").isNull(), "revision_changed").otherwise("dry_run_too_late"))
    return failing.select("operation_id", "dry_run_id", reason.alias("reason"))


def workspace_usage(files: DataFrame, max_files: int, max_bytes: int) -> DataFrame:
    per = files.groupBy("workspace_id").agg(F.count("*").alias("file_count"), F.sum("size_bytes").alias("size_bytes"))
    return per.withColumn("over_quota", (F.col("file_count") > max_files) | (F.col("size_bytes") > max_bytes))


def expired_workspaces(workspaces: DataFrame, as_of: Column) -> DataFrame:
    return workspaces.filter(F.col("expires_at") <= as_of)


def redact_prefix(json_text: Column, prefix: str, replacement: str) -> Column:
    """Replace a path prefix at every place of a nested JSON result."""
    return F.replace(json_text, F.lit(prefix), F.lit(replacement))


def audit_event(operations: DataFrame) -> DataFrame:
    """Flat audit rows of the operation log."""
    return operations.select(
        F.substring(F.sha2(F.concat_ws("|", "operation_id", "action", F.col("created_at").cast("string")), 256), 1, 16).alias("event_id"),
        "operation_id", "action", "workspace_id", "actor", "trace_id", (F.col("action") == "dry_run").alias("dry_run"),
        F.col("dry_run_id").isNotNull().alias("approved"), "created_at")
