"""Streaming forms of the audit, scan, rollout and ledger operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenlake.functions import sensitive_patterns as sp
from wardenlake.operators import rollout, scan
from wardenlake.session import ensure_checkpoint_dir
from wardenlake.sources.tables import broadcast_if_small
from wardenlake.streaming.ordered import OrderedProcessor, run_ordered


def event_time(stream: DataFrame) -> DataFrame:
    """Parquet times load without a zone, which a watermark does not take."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counters(events: DataFrame, duration: str = "5 minutes", delay: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Events per window and type; rows later than the delay are dropped."""
    window = F.window("ts", duration, slide)
    counted = event_time(events).withWatermark("ts", delay).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n")


def active_users(requests: DataFrame, duration: str, delay: str) -> DataFrame:
    """Approximate distinct users and exact requests per window and operation."""
    counted = event_time(requests).withWatermark("ts", delay).groupBy(F.window("ts", duration).alias("w"), "op").agg(
        F.approx_count_distinct("user_id").alias("active_users"), F.count("*").alias("requests"))
    return counted.select(F.col("w.start").alias("window_start"), "op", "active_users", "requests")


def finding_stream(files: DataFrame, key: str, text: str) -> DataFrame:
    """Findings of arriving files; stateless."""
    return scan.findings_core(files, key, text)


def risk_stream(files: DataFrame, text: str, duration: str, delay: str) -> DataFrame:
    """Findings and risk score per arrival window; ``ts`` is the event time of a file."""
    timed = event_time(files).withWatermark("ts", delay)
    found = scan.findings_core(timed, "ts", text)
    weight = F.create_map(*[F.lit(v) for kv in sp.SEVERITY_WEIGHT.items() for v in kv])
    counted = found.groupBy(F.window("ts", duration).alias("w"), "regulation").agg(
        F.count("*").alias("findings"), F.sum(weight[F.col("severity")]).alias("risk_score"))
    return counted.select(F.col("w.start").alias("window_start"), "regulation", "findings", "risk_score")


def alert_stream(metrics: DataFrame) -> DataFrame:
    return rollout.threshold_alerts(metrics)


class HealthStates(OrderedProcessor):
    """Two counters per check; emits every result with the status before and after."""

    key_columns = ["check_id"]
    fields = ["event_id", "success"]
    output = "check_id string, event_id bigint, old_status string, status string"

    def __init__(self, healthy_at: int = 2, unhealthy_at: int = 3, only_changes: bool = False) -> None:
        self.healthy_at, self.unhealthy_at, self.only_changes = healthy_at, unhealthy_at, only_changes

    def start(self) -> dict:
        return {"ok": 0, "bad": 0, "status": "UNKNOWN"}

    def step(self, memory, row):
        ok = memory["ok"] + 1 if row["success"] else 0
        bad = 0 if row["success"] else memory["bad"] + 1
        status = "HEALTHY" if ok >= self.healthy_at else "UNHEALTHY" if bad >= self.unhealthy_at else "DEGRADED"
        out = {"event_id": row["event_id"], "old_status": memory["status"], "status": status}
        if self.only_changes and status == memory["status"]:
            out = None
        return {"ok": ok, "bad": bad, "status": status}, out


class FirstRows(OrderedProcessor):
    """The first row of each key in event-time order, whatever arrives first; one flag a key stays."""

    def start(self) -> dict:
        return {"seen": False}

    def step(self, memory, row):
        if memory["seen"]:
            return memory, None
        return {"seen": True}, {name: row[name] for name in self.fields} | {self.time: pd.Timestamp(row["at"], unit="us")}

    time = "at"


class FirstCrossings(FirstRows):
    key_columns = ["deployment_id", "metric_name"]
    fields = ["event_id", "value"]
    time = "triggered_at"
    output = "deployment_id string, metric_name string, triggered_at timestamp, event_id bigint, value double"


class FirstRecords(FirstRows):
    key_columns = ["operation_id"]
    fields = ["event_id", "action", "workspace_id", "migration_type", "source_revision"]
    time = "created_at"
    output = "operation_id string, created_at timestamp, event_id bigint, action string, workspace_id string, migration_type string, source_revision string"


class CanarySteps(OrderedProcessor):
    """Percentage per canary; a rollback ends it."""

    key_columns = ["canary_id"]
    fields = ["event_id", "should_rollback", "should_advance"]
    output = "canary_id string, event_id bigint, percentage int, state string"

    def start(self) -> dict:
        return {"percentage": 0, "ended": False}

    def step(self, memory, row):
        if memory["ended"]:
            return memory, None
        percentage = memory["percentage"]
        if row["should_advance"] and not row["should_rollback"]:
            percentage = next((s for s in rollout.CANARY_STEPS if s > percentage), percentage)
        state = "ROLLED_BACK" if row["should_rollback"] else "COMPLETED" if percentage >= 100 else "RUNNING"
        return ({"percentage": percentage, "ended": bool(row["should_rollback"])},
                {"event_id": row["event_id"], "percentage": percentage, "state": state})


class Admissions(OrderedProcessor):
    """Sliding-window admission; the memory holds the admitted times of one window."""

    key_columns = ["op", "user_id"]
    fields = ["event_id", "max_requests", "window_seconds"]
    output = "op string, user_id string, event_id bigint, admitted boolean"

    def start(self) -> dict:
        return {"times": []}

    def step(self, memory, row):
        times = [t for t in memory["times"] if row["at"] - t < row["window_seconds"] * rollout.SECOND]
        admitted = len(times) < row["max_requests"]
        return {"times": times + [row["at"]] if admitted else times}, {"event_id": row["event_id"], "admitted": admitted}


class Evictions(OrderedProcessor):
    """Points that fall out of the newest ``keep`` of a deployment; the memory holds those ``keep`` ids and no more."""

    key_columns = ["deployment_id"]
    fields = ["event_id"]
    output = "deployment_id string, event_id bigint"

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def start(self) -> dict:
        return {"newest": []}

    def step(self, memory, row):
        newest = memory["newest"] + [row["event_id"]]
        if len(newest) <= self.keep:
            return {"newest": newest}, None
        return {"newest": newest[1:]}, {"event_id": newest[0]}


def retention_stream(metrics: DataFrame, keep: int, delay: str, range_ms: int | None = None) -> DataFrame:
    """The points that retention of the newest ``keep`` of each deployment drops, as they drop; the counterpart of ``rollout.retain_newest``."""
    return run_ordered(event_time(metrics).withWatermark("ts", delay), Evictions(keep), range_ms)


def trigger_stream(metrics: DataFrame, delay: str, range_ms: int | None = None) -> DataFrame:
    """One-shot triggers: the earliest point past its threshold of each deployment and metric."""
    timed = event_time(metrics).withWatermark("ts", delay)
    return run_ordered(timed.filter(rollout.crossed()), FirstCrossings(), range_ms)


def ledger_stream(operations: DataFrame, delay: str, range_ms: int | None = None) -> DataFrame:
    """The earliest record of each operation id; ``created_at`` is its event time."""
    return run_ordered(event_time(operations.withColumn("ts", F.col("created_at"))).withWatermark("ts", delay), FirstRecords(), range_ms)


def health_stream(checks: DataFrame, delay: str, range_ms: int | None = None, **thresholds) -> DataFrame:
    return run_ordered(event_time(checks).withWatermark("ts", delay), HealthStates(**thresholds), range_ms)


def canary_stream(evaluations: DataFrame, delay: str, range_ms: int | None = None) -> DataFrame:
    return run_ordered(event_time(evaluations).withWatermark("ts", delay), CanarySteps(), range_ms)


def limiter_stream(requests: DataFrame, limits: DataFrame, delay: str, range_ms: int | None = None) -> DataFrame:
    """Admission of limited operations; every request, limited or not, moves the watermark."""
    timed = event_time(requests).withWatermark("ts", delay)
    return run_ordered(timed.join(broadcast_if_small(limits), "op"), Admissions(), range_ms)


def on_change(transitions: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str):
    """Hand each micro-batch of changes to a callback."""
    return transitions.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint).outputMode("append")


def with_closing_mark(stream: DataFrame, last: DataFrame, after: str, **values) -> DataFrame:
    """A bounded stream with one more row whose time lies ``after`` the last of the source.

    Its other columns are null, or as given by name where a later join would drop nulls.  It moves the watermark past all real rows, so that every window
    closes and every waiting row is handled; its own window or key never closes.  ``last`` has
    the latest time of the source in ``ts``, one row.
    """
    spark: SparkSession = stream.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/mark-{uuid.uuid4().hex}"
    ts = (F.col("ts") + F.expr(f"INTERVAL {after}")).cast(stream.schema["ts"].dataType)
    last.select(*[(ts if f.name == "ts" else F.lit(values.get(f.name)).cast(f.dataType)).alias(f.name) for f in stream.schema]).write.parquet(folder)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(folder))


def run_available(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Run a stream over what is there now into a table in the shared checkpoint folder, and read it."""
    spark: SparkSession = stream.sparkSession
    base = folder or f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    started = (stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/progress")
               .outputMode("append").trigger(availableNow=True).start())
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
