"""Rollout monitoring in batch: metrics, alerts, health states, canaries, triggers, limits.

Time-ordered operators never put a whole key into one window: keys are cut into
time segments (see ``functions.windows``), because one deployment, check or user
may hold a third of the stream.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps
from pyspark.sql.window import Window

from wardenlake.functions.windows import last_before, last_n, number_rows, running_sum
from wardenlake.session import cut_and_count, cut_lineage
from wardenlake.sources.tables import broadcast_if_small

# Metric, direction, limit, high limit, alert type.
ALERT_RULES = [
    ("error_rate", "above", 0.05, 0.1, "high_error_rate"),
    ("response_time", "above", 2000.0, 5000.0, "high_response_time"),
    ("health_score", "below", 0.95, 0.8, "low_health_score"),
]
# Trigger metric, direction, threshold.
TRIGGER_RULES = [("health_score", "below", 0.95), ("error_rate", "above", 0.05), ("response_time", "above", 2000.0)]
CANARY_STEPS = [5, 10, 25, 50, 75, 100]
# Operation, admitted requests, window in seconds.
LIMITS = [("migration", 10, 3600), ("file_ops", 100, 60), ("api_calls", 60, 60), ("analysis", 50, 3600)]
DEPLOYMENT_POINTS, ALERT_CAP, CHECK_CAP = 1000, 1000, 100


SECOND = 1_000_000


def micros(ts: str = "ts") -> Column:
    """Whole microseconds of a timestamp, whichever timestamp type it has; spans compare exactly."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def hour_of(ts: str = "ts") -> Column:
    return F.floor(micros(ts) / (3600 * SECOND))


def query_metrics(metrics: DataFrame, deployment_id: str | None = None, metric_name: str | None = None, start: Column | None = None,
                  end: Column | None = None, limit: int | None = None) -> DataFrame:
    """Both ends inclusive; all points, or the newest ``limit``."""
    found = metrics
    for condition in (deployment_id is not None and F.col("deployment_id") == deployment_id,
                      metric_name is not None and F.col("metric_name") == metric_name,
                      start is not None and F.col("ts") >= start, end is not None and F.col("ts") <= end):
        if condition is not False:
            found = found.filter(condition)
    return found if limit is None else found.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)


def trailing(metrics: DataFrame, as_of: Column, minutes: int) -> DataFrame:
    return metrics.filter((F.col("ts") >= as_of - F.expr(f"INTERVAL {minutes} MINUTES")) & (F.col("ts") <= as_of))


def exact_median(df: DataFrame, keys: list[str], value: str, accuracy: int = 10000) -> DataFrame:
    """Median per key without holding a group in memory.

    An approximate-percentile sketch brackets the middle within ±2/accuracy of the
    rows.  Equal values are counted before they move, so a constant metric is one row a
    task; values outside the bracket are only summed up, and the few inside are ranked by their counts.
    """
    margin = 2.0 / accuracy
    sketch = F.percentile_approx(value, F.array(F.lit(0.5 - margin), F.lit(0.5 + margin)), accuracy)
    bracket = df.groupBy(*keys).agg(F.count(value).alias("_n"), sketch.alias("_b"))
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    marked = counts.join(bracket, keys).filter(F.col(value) <= F.col("_b")[1])
    below = marked.groupBy(*keys).agg(F.sum(F.when(F.col(value) < F.col("_b")[0], F.col("_c")).otherwise(0)).alias("_below"))
    middle = marked.filter(F.col(value) >= F.col("_b")[0]).join(below, keys)
    upto = F.col("_below") + F.sum("_c").over(Window.partitionBy(*keys).orderBy(value))
    holds = [(F.col("_upto") - F.col("_c") < rank) & (rank <= F.col("_upto")) for rank in (F.floor((F.col("_n") + 1) / 2), F.ceil((F.col("_n") + 1) / 2))]
    low, high = (F.max(F.when(hold, F.col(value))) for hold in holds)
    return middle.withColumn("_upto", upto).groupBy(*keys).agg(((low + high) / 2).alias("median"))


def metric_statistics(metrics: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Count, mean, min, max, median and sample deviation per deployment and metric."""
    keys = keys or ["deployment_id", "metric_name"]
    plain = metrics.groupBy(*keys).agg(
        F.count("*").alias("count"), F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std_dev"))
    return plain.join(exact_median(metrics, keys, "value"), keys)


def threshold_alerts(metrics: DataFrame) -> DataFrame:
    """Stateless alert rows; the same expression runs on a stream."""
    def alert(metric: str, side: str, limit: float, high: float, kind: str) -> Column:
        value = F.col("value")
        hit, severe = (value > limit, value > high) if side == "above" else (value < limit, value < high)
        return F.when((F.col("metric_name") == metric) & hit, F.struct(
            F.lit(kind).alias("alert_type"), F.when(severe, "HIGH").otherwise("MEDIUM").alias("severity"),
            value.alias("metric_value"), F.lit(limit).alias("threshold")))

    hit = F.coalesce(*[alert(*rule) for rule in ALERT_RULES])
    rows = metrics.withColumn("_a", hit).filter(F.col("_a").isNotNull())
    identity = F.concat_ws("|", "deployment_id", "_a.alert_type", F.col("ts").cast("string"), F.col("event_id").cast("string"))
    return rows.select(F.substring(F.sha2(identity, 256), 1, 16).alias("alert_id"), "deployment_id", "event_id", "_a.*", F.col("ts").alias("created_at"))


def _means(stats: DataFrame) -> DataFrame:
    return stats.groupBy("deployment_id").pivot("metric_name", ["error_rate", "response_time", "health_score"]).agg(F.first("avg"))


def deployment_status(stats: DataFrame) -> DataFrame:
    """CRITICAL, WARNING, DEGRADED or HEALTHY from the window means."""
    error, response, health = F.col("error_rate"), F.col("response_time"), F.col("health_score")
    return _means(stats).select("deployment_id", F.when((error > 0.1) | (health < 0.8), "CRITICAL").when((error > 0.05) | (response > 2000), "WARNING")
                                .when(health < 0.95, "DEGRADED").otherwise("HEALTHY").alias("status"))


def metric_recommendations(stats: DataFrame) -> DataFrame:
    advice = F.array_compact(F.array(
        F.when(F.col("error_rate") > 0.05, F.lit("investigate_errors")), F.when(F.col("response_time") > 1000, F.lit("optimise_response_time")),
        F.when(F.col("health_score") < 0.95, F.lit("inspect_health_checks"))))
    return _means(stats).select("deployment_id", F.explode(advice).alias("recommendation"))


def alert_states(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Alerts with acknowledged/resolved flags folded from an append-only action table."""
    folded = actions.groupBy("alert_id").agg(
        F.max((F.col("action") == "acknowledge").cast("int")).alias("_a"), F.max((F.col("action") == "resolve").cast("int")).alias("_r"))
    return (alerts.join(folded, "alert_id", "left").withColumn("acknowledged", F.coalesce("_a", F.lit(0)) == 1)
            .withColumn("resolved", F.coalesce("_r", F.lit(0)) == 1).drop("_a", "_r"))


def search_alerts(alerts: DataFrame, deployment_id: str | None = None, severity: str | None = None, acknowledged: bool | None = None,
                  resolved: bool | None = None, limit: int | None = None) -> DataFrame:
    """All alerts that match, or the newest ``limit``."""
    found = alerts
    for column, wanted in (("deployment_id", deployment_id), ("severity", severity), ("acknowledged", acknowledged), ("resolved", resolved)):
        if wanted is not None:
            found = found.filter(F.col(column) == wanted)
    return found if limit is None else found.orderBy(F.desc("created_at"), "alert_id").limit(limit)


def recent_alerts(alerts: DataFrame, k: int = 10) -> DataFrame:
    """Newest k per deployment as one list; only k rows per deployment reach the list."""
    return (last_n(alerts, ["deployment_id"], [F.desc("created_at"), F.desc("event_id")], k).groupBy("deployment_id")
            .agg(F.sort_array(F.collect_list("alert_id")).alias("recent_alerts")))


def dashboard(metrics: DataFrame, alerts: DataFrame) -> DataFrame:
    stats = metric_statistics(metrics)
    per = stats.groupBy("deployment_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric_name", "avg")))).alias("means"),
                                             F.sum("count").alias("points"))
    return per.join(deployment_status(stats), "deployment_id").join(recent_alerts(alerts), "deployment_id", "left")


def retain_newest(df: DataFrame, key: str, n: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    return last_n(df, [key], [F.desc(ts), F.desc(tie)], n)


def health_states(checks: DataFrame, healthy_at: int = 2, unhealthy_at: int = 3, tie: str = "event_id") -> DataFrame:
    """Status after every result, the status before it, and both run lengths.

    Inside an hour segment a window finds the last failure and last success; one
    summary row per segment carries their positions over the earlier segments.
    """
    # The join below needs both keys; saying so here gives both of its sides the same
    # plan up to the shuffle, which Spark then runs once.
    keyed = checks.withColumn("_segment", hour_of()).filter(F.col("check_id").isNotNull() & F.col("_segment").isNotNull())
    inside = Window.partitionBy("check_id", "_segment").orderBy("ts", tie)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rank = F.row_number().over(inside)
    ranked = keyed.withColumn("_rank", rank)
    ranked = (ranked.withColumn("_fail", F.max(F.when(~F.col("success"), F.col("_rank"))).over(upto))
              .withColumn("_ok", F.max(F.when(F.col("success"), F.col("_rank"))).over(upto)))
    order = Window.partitionBy("check_id").orderBy("_segment")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    summary = (ranked.groupBy("check_id", "_segment").agg(F.count("*").alias("_n"), F.max("_fail").alias("_sf"), F.max("_ok").alias("_so"))
               .withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
               .withColumn("_carry_fail", F.coalesce(F.max(F.col("_base") + F.col("_sf")).over(before), F.lit(0)))
               .withColumn("_carry_ok", F.coalesce(F.max(F.col("_base") + F.col("_so")).over(before), F.lit(0)))
               .select("check_id", "_segment", "_base", "_carry_fail", "_carry_ok"))
    position = F.col("_base") + F.col("_rank")
    joined = (ranked.join(summary, ["check_id", "_segment"])
              .withColumn("consecutive_successes", position - F.coalesce(F.col("_base") + F.col("_fail"), F.col("_carry_fail")))
              .withColumn("consecutive_failures", position - F.coalesce(F.col("_base") + F.col("_ok"), F.col("_carry_ok"))))
    fail, ok = F.col("consecutive_failures"), F.col("consecutive_successes")

    def status(s: Column, f: Column) -> Column:
        return F.when(s >= healthy_at, "HEALTHY").when(f >= unhealthy_at, "UNHEALTHY").when((s > 0) | (f > 0), "DEGRADED").otherwise("UNKNOWN")

    # The run lengths before this row follow from the run lengths after it, except
    # where the row itself starts a run; there the other run ended just before.
    previous_ok = F.when(F.col("success"), ok - 1).otherwise(position - 1 - F.coalesce(
        F.col("_base") + F.max(F.when(~F.col("success"), F.col("_rank"))).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carry_fail")))
    previous_fail = F.when(~F.col("success"), fail - 1).otherwise(position - 1 - F.coalesce(
        F.col("_base") + F.max(F.when(F.col("success"), F.col("_rank"))).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carry_ok")))
    return (joined.withColumn("status", status(ok, fail)).withColumn("old_status", status(previous_ok, previous_fail))
            .drop("_segment", "_rank", "_fail", "_ok", "_base", "_carry_fail", "_carry_ok"))


def custom_checks(observations: DataFrame, success: Column) -> DataFrame:
    """Check results whose success is the caller's own predicate over each observation."""
    return observations.withColumn("success", F.coalesce(success, F.lit(False)))


def transitions(states: DataFrame) -> DataFrame:
    return states.filter(F.col("old_status") != F.col("status"))


def latest_check_states(states: DataFrame) -> DataFrame:
    return states.groupBy("check_id").agg(F.max_by(F.struct("deployment_id", "status"), F.struct("ts", "event_id")).alias("s")).select("check_id", "s.*")


def deployment_health(latest: DataFrame) -> DataFrame:
    is_in = {s: (F.col("status") == s) for s in ("HEALTHY", "UNHEALTHY", "DEGRADED")}
    per = latest.groupBy("deployment_id").agg(
        F.avg(is_in["HEALTHY"].cast("int")).alias("health_score"), F.count("*").alias("total_checks"), F.sum(is_in["HEALTHY"].cast("int")).alias("healthy_checks"),
        F.sum(is_in["UNHEALTHY"].cast("int")).alias("unhealthy_checks"), F.bool_and(is_in["HEALTHY"]).alias("_all"),
        F.bool_or(is_in["UNHEALTHY"]).alias("_bad"), F.bool_or(is_in["DEGRADED"]).alias("_weak"))
    return per.withColumn("overall_status", F.when(F.col("_all"), "HEALTHY").when(F.col("_bad"), "UNHEALTHY").when(F.col("_weak"), "DEGRADED")
                          .otherwise("UNKNOWN")).drop("_all", "_bad", "_weak")


def canary_counters(points: DataFrame) -> DataFrame:
    """points(canary_id, ts, event_id, metric_type, value)."""
    kind = F.col("metric_type")
    return points.groupBy("canary_id").agg(
        F.sum((kind == "error").cast("int")).alias("errors"), F.sum((kind == "request").cast("int")).alias("requests"),
        F.max_by(F.when(kind == "health_score", F.col("value")), F.when(kind == "health_score", F.struct("ts", "event_id"))).alias("health_score"))


def canary_decisions(counters: DataFrame, health_threshold: float = 0.95, error_threshold: float = 0.05) -> DataFrame:
    health = F.coalesce("health_score", F.lit(1.0))
    rate = F.col("errors") / F.greatest("requests", F.lit(1))
    return (counters.withColumn("error_rate", rate)
            .withColumn("should_rollback", (health < health_threshold) | (F.col("error_rate") > error_threshold))
            .withColumn("should_advance", (health >= health_threshold) | (F.col("error_rate") <= error_threshold))
            .withColumn("decision", F.when(F.col("should_rollback"), "ROLLBACK").when(F.col("should_advance"), "ADVANCE").otherwise("HOLD")))


def next_step(percentage: Column) -> Column:
    return F.get(F.filter(F.array(*[F.lit(s) for s in CANARY_STEPS]), lambda s: s > percentage), F.lit(0))


def canary_progress(evaluations: DataFrame) -> DataFrame:
    """evaluations(canary_id, ts, event_id, should_rollback, should_advance) → percentage after each one.

    The first rollback ends a canary, and the percentage only depends on how many
    advances came before, so a segmented running count replaces the state loop.
    """
    stop = evaluations.filter("should_rollback").groupBy("canary_id").agg(F.min(F.struct("ts", "event_id")).alias("_stop"))
    live = evaluations.join(stop, "canary_id", "left").filter(F.col("_stop").isNull() | (F.struct("ts", "event_id") <= F.col("_stop")))
    step = (F.col("should_advance") & ~F.col("should_rollback")).cast("int")
    counted = running_sum(live, ["canary_id"], ["ts", "event_id"], hour_of(), step, "_advances")
    steps = F.array(F.lit(0), *[F.lit(s) for s in CANARY_STEPS])
    return (counted.withColumn("percentage", F.get(steps, F.least(F.col("_advances"), F.lit(len(CANARY_STEPS))).cast("int")))
            .withColumn("state", F.when(F.col("should_rollback"), "ROLLED_BACK").when(F.col("percentage") >= 100, "COMPLETED").otherwise("RUNNING"))
            .drop("_advances", "_stop"))


def crossed() -> Column:
    """Whether a metric point lies past the threshold of its metric."""
    out = F.lit(False)
    for metric, side, limit in TRIGGER_RULES:
        out = out | ((F.col("metric_name") == metric) & (F.col("value") < limit if side == "below" else F.col("value") > limit))
    return out


def first_crossings(metrics: DataFrame) -> DataFrame:
    """One-shot triggers: the first point of each deployment and metric past its threshold."""
    return (metrics.filter(crossed()).groupBy("deployment_id", "metric_name").agg(F.min(F.struct("ts", "event_id", "value")).alias("f"))
            .select("deployment_id", "metric_name", F.col("f.ts").alias("triggered_at"), F.col("f.event_id").alias("event_id"), F.col("f.value").alias("value")))


def roster(deployments: DataFrame, k: int | None = None) -> DataFrame:
    """All deployments with their latest row, or the newest ``k``."""
    latest = deployments.groupBy("deployment_id").agg(F.min("ts").alias("created_at"), F.max_by(F.struct("status", "target_percentage"), F.struct("ts", "event_id")).alias("s"))
    rows = latest.select("deployment_id", "created_at", "s.status", F.col("s.target_percentage").alias("target"),
                         (100 - F.col("s.target_percentage")).alias("current"))
    return rows if k is None else rows.orderBy(F.desc("created_at"), "deployment_id").limit(k)


def traffic_split(users: DataFrame, user: str, percentage: int) -> DataFrame:
    """Stable assignment of a user to the target version by a hash bucket of 100."""
    bucket = F.pmod(F.conv(F.substring(F.md5(F.col(user).cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(100))
    return users.withColumn("to_target", bucket < percentage)


def limit_table(spark) -> DataFrame:
    return spark.createDataFrame(LIMITS, "op string, max_requests int, window_seconds int")


ADMIT_SCHEMA = "op string, user_id string, event_id bigint, at bigint, admitted boolean"


def _admit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sliding-window admission over rows sorted by key and time; holds at most one window of admitted times."""
    key: tuple | None = None
    recent: deque[int] = deque()
    for batch in batches:
        flags = []
        for op, user, session, at, most, span in zip(batch["op"], batch["user_id"], batch["session"], batch["at"],
                                                     batch["max_requests"], batch["window_seconds"]):
            if (op, user, session) != key:
                key = (op, user, session)
                recent.clear()
            while recent and at - recent[0] >= span * SECOND:
                recent.popleft()
            flags.append(len(recent) < most)
            if flags[-1]:
                recent.append(at)
        yield pd.DataFrame({"op": batch["op"], "user_id": batch["user_id"], "event_id": batch["event_id"], "at": batch["at"], "admitted": flags})


#: Requests of one session that a task evaluates in one go; longer sessions are cut into blocks of so many,
#: or smaller blocks into spans that together have so many.
SESSION_BLOCK = 50_000
_SESSION = ["op", "user_id", "session"]
_BLOCK, _SPAN = [*_SESSION, "block"], [*_SESSION, "span"]


def _walk(rows: pd.DataFrame, entered: list[int]) -> tuple[list[bool], list[int]]:
    """Admission of a block's requests after the admitted times ``entered``, and the admitted times still in the window at its end."""
    rows = rows.sort_values(["at", "event_id"])
    most, span = int(rows["max_requests"].iloc[0]), int(rows["window_seconds"].iloc[0]) * SECOND
    recent, flags = deque(entered), []
    for at in rows["at"]:
        while recent and at - recent[0] >= span:
            recent.popleft()
        flags.append(len(recent) < most)
        if flags[-1]:
            recent.append(at)
    return flags, list(recent)


def _beside(rows: DataFrame, states: DataFrame, keys: list[str]) -> PandasCogroupedOps:
    """The requests of each block or span next to the state it is entered with."""
    given = states.select(*[F.col(c).alias(f"_{c}") for c in keys], "entered")
    return rows.groupBy(*keys).cogroup(given.groupBy(*[f"_{c}" for c in keys]))


def _span_states(rows: DataFrame, due: DataFrame) -> DataFrame:
    """What each block of the spans in ``due`` is entered with and ends with, given the admitted times the span is entered with."""

    def states(key, requests: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        out, entered = [], list(given["entered"].iloc[0])
        for block, inside in requests.groupby("block", sort=True):
            left = _walk(inside, entered)[1]
            out.append((*key, block, entered, left))
            entered = left
        return pd.DataFrame(out, columns=[*_SPAN, "block", "entered", "left"])

    return _beside(rows.join(due, _SPAN, "left_semi"), due, _SPAN).applyInPandas(
        states, "op string, user_id string, session bigint, span bigint, block bigint, entered array<bigint>, left array<bigint>")


def _settled_states(rows: DataFrame) -> DataFrame:
    """The admitted times that each block of a long session is entered with.

    Spans are neighbouring blocks that one task follows from end to end.  All are evaluated at once, as
    if nothing was admitted before them.  Each is then given what the span before it ended with, and the
    spans for which that is news are evaluated again, until there are none.  States meet as soon as a
    span ends in a window that its limit doesn't bind; n spans whose limit binds throughout may take n rounds.
    """
    none = F.array().cast("array<bigint>")
    states = cut_lineage(_span_states(rows, rows.select(*_SPAN).distinct().withColumn("entered", none)))
    while True:
        ends = states.groupBy(*_SPAN).agg(F.min_by("entered", "block").alias("entered"), F.max_by("left", "block").alias("_left"))
        before = ends.select(*_SESSION, (F.col("span") + 1).alias("span"), F.col("_left").alias("_now"))
        now = F.coalesce("_now", none)
        news = ends.join(before, _SPAN, "left").filter(F.col("entered") != now).select(*_SPAN, now.alias("entered"))
        due, count = cut_and_count(news)
        if not count:
            return states
        states = cut_lineage(states.join(due, _SPAN, "left_anti").unionByName(_span_states(rows, due)))


def _admit_long(sessions: DataFrame, block: int) -> DataFrame:
    """Admission in sessions that are longer than a block, spread over tasks block by block."""
    placed = number_rows(sessions, _SESSION, ["at", "event_id"], F.floor(F.col("at") / (3600 * SECOND)))
    blocks = placed.withColumn("block", F.floor((F.col("ordinal") - 1) / block)).drop("ordinal")
    rows = cut_lineage(blocks.withColumn("span", F.floor(F.col("block") / max(1, SESSION_BLOCK // block))))

    def decide(key, requests: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        flags = _walk(requests, list(given["entered"].iloc[0]))[0]
        return requests.sort_values(["at", "event_id"])[["op", "user_id", "event_id", "at"]].assign(admitted=flags)

    return _beside(rows, _settled_states(rows), _BLOCK).applyInPandas(decide, ADMIT_SCHEMA)


def rate_limit(requests: DataFrame, limits: DataFrame, block: int = SESSION_BLOCK) -> DataFrame:
    """Admission per request(op, user_id, ts, event_id); only admitted requests count.

    Whether a request is admitted depends on the ones before it, but a pause of at
    least one window resets the state.  Sessions between such pauses are therefore
    independent.  Those of at most ``block`` requests stream through tasks in sorted order;
    the blocks of a longer one are evaluated at once from assumed states until these hold,
    so a user who never pauses isn't one task.  The result is the same whatever ``block``
    is.  Operations without a limit are admitted without leaving the JVM.
    """
    timed = requests.withColumn("at", micros()).join(broadcast_if_small(limits), "op", "left")
    free = timed.filter(F.col("max_requests").isNull()).select("op", "user_id", "event_id", "at", F.lit(True).alias("admitted"))
    limited = timed.filter(F.col("max_requests").isNotNull())
    keys, order = ["op", "user_id"], ["at", "event_id"]
    previous = last_before(limited, keys, order, hour_of(), F.col("at"), "_previous")
    starts = (F.col("_previous").isNull() | (F.col("at") - F.col("_previous") >= F.col("window_seconds").cast("bigint") * F.lit(SECOND))).cast("int")
    sessions = cut_lineage(running_sum(previous, keys, order, hour_of(), starts, "session")
                           .select(*_SESSION, "at", "event_id", "max_requests", "window_seconds"))
    long, count = cut_and_count(sessions.groupBy(*_SESSION).agg(F.count("*").alias("_n")).filter(F.col("_n") > block).drop("_n"))
    short = sessions if not count else sessions.join(long, _SESSION, "left_anti")
    decided = short.repartition(*_SESSION).sortWithinPartitions(*_SESSION, "at", "event_id").mapInPandas(_admit, ADMIT_SCHEMA).unionByName(free)
    return decided if not count else decided.unionByName(_admit_long(sessions.join(long, _SESSION, "left_semi"), block))


def limiter_state(decisions: DataFrame, limits: DataFrame, as_of: Column) -> DataFrame:
    """Per (op, user): admitted requests still in the window and whole seconds until one leaves it."""
    now = F.unix_micros(as_of.cast("timestamp"))
    span = F.col("window_seconds").cast("bigint") * F.lit(SECOND)
    live = decisions.filter("admitted").join(broadcast_if_small(limits), "op").filter((F.col("at") <= now) & (now - F.col("at") < span))
    return live.groupBy("op", "user_id").agg(
        F.count("*").alias("in_window"), F.floor((F.min(F.col("at") + span) - now) / SECOND).cast("int").alias("retry_after"))


def limiter_statistics(state: DataFrame) -> DataFrame:
    return state.groupBy("op").agg(F.count("*").alias("active_users"), F.sum("in_window").alias("total_requests"))


def windowed_counts(events: DataFrame, duration: str, slide: str | None = None) -> DataFrame:
    """Tumbling, or sliding with ``slide``."""
    window = F.window(F.col("ts").cast("timestamp"), duration, slide)
    return events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")
