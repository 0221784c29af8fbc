"""Rollout monitoring over the event stream in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardenlake.operators import rollout as ro
from wardenlake.plans.derived import CHECKS, METRICS, OBSERVATIONS, REQUESTS
from wardenlake.plans.registry import derive, plain, query
from wardenlake.sources.tables import load

_M, _C, _R = plain(METRICS), plain(CHECKS), plain(REQUESTS)
AS_OF = "2024-01-25 12:00:00"
MINUTES = 7 * 24 * 60


def _metrics(spark, sf_dir):
    return derive(spark, sf_dir, METRICS, "events")


def _trailing(spark, sf_dir):
    return ro.trailing(_metrics(spark, sf_dir), F.lit(AS_OF).cast("timestamp_ntz"), MINUTES)


_T = f"SELECT * FROM ({_M}) WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL {MINUTES} MINUTE AND ts <= TIMESTAMP '{AS_OF}'"


@query("metric_query", f"""
SELECT event_id, round(value, 6) AS value FROM ({_M}) WHERE deployment_id = 'deploy-3' AND metric_name = 'response_time'
  AND ts >= TIMESTAMP '2024-01-02 00:00:00' AND ts <= TIMESTAMP '2024-01-28 00:00:00'""")
def metric_query(spark, sf_dir):
    found = ro.query_metrics(_metrics(spark, sf_dir), "deploy-3", "response_time", F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"),
                             F.lit("2024-01-28 00:00:00").cast("timestamp_ntz"))
    return found.select("event_id", F.round("value", 6).alias("value"))


_STATS = """count(*) AS "count", avg(value) AS "avg", min(value) AS "min", max(value) AS "max", median(value) AS median, coalesce(stddev_samp(value), 0.0) AS std_dev"""


def _rounded(df, *columns):
    return df.select(*[F.round(c, 6).alias(c) if c in columns else F.col(c) for c in df.columns])


@query("metric_stats", f"""
SELECT deployment_id, metric_name, "count", {', '.join(f'round("{c}", 6) AS "{c}"' for c in ('avg', 'min', 'max', 'median', 'std_dev'))}
FROM (SELECT deployment_id, metric_name, {_STATS} FROM ({_T}) GROUP BY ALL)""")
def metric_stats(spark, sf_dir):
    return _rounded(ro.metric_statistics(_trailing(spark, sf_dir)), "avg", "min", "max", "median", "std_dev")


_ALERTS = f"""
SELECT deployment_id, event_id, ts AS created_at, value AS metric_value,
  CASE metric_name WHEN 'error_rate' THEN 'high_error_rate' WHEN 'response_time' THEN 'high_response_time' ELSE 'low_health_score' END AS alert_type,
  CASE WHEN (metric_name = 'error_rate' AND value > 0.1) OR (metric_name = 'response_time' AND value > 5000) OR (metric_name = 'health_score' AND value < 0.8) THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  CASE metric_name WHEN 'error_rate' THEN 0.05::DOUBLE WHEN 'response_time' THEN 2000.0::DOUBLE ELSE 0.95::DOUBLE END AS threshold
FROM ({_M}) WHERE (metric_name = 'error_rate' AND value > 0.05) OR (metric_name = 'response_time' AND value > 2000) OR (metric_name = 'health_score' AND value < 0.95)"""


@query("metric_alerts", f"SELECT deployment_id, event_id, alert_type, severity, round(metric_value, 6) AS metric_value, threshold FROM ({_ALERTS})")
def metric_alerts(spark, sf_dir):
    a = ro.threshold_alerts(_metrics(spark, sf_dir))
    return a.select("deployment_id", "event_id", "alert_type", "severity", F.round("metric_value", 6).alias("metric_value"), "threshold")


_MEANS = f"""
SELECT deployment_id, avg(value) FILTER (metric_name = 'error_rate') AS e, avg(value) FILTER (metric_name = 'response_time') AS r,
  avg(value) FILTER (metric_name = 'health_score') AS h FROM ({_T}) GROUP BY deployment_id"""
_STATUS = f"""
SELECT deployment_id, CASE WHEN e > 0.1 OR h < 0.8 THEN 'CRITICAL' WHEN e > 0.05 OR r > 2000 THEN 'WARNING' WHEN h < 0.95 THEN 'DEGRADED' ELSE 'HEALTHY' END AS status FROM ({_MEANS})"""


@query("deployment_status", _STATUS)
def deployment_status(spark, sf_dir):
    return ro.deployment_status(ro.metric_statistics(_trailing(spark, sf_dir)))


@query("metric_recommendations", f"""
SELECT deployment_id, 'investigate_errors' AS recommendation FROM ({_MEANS}) WHERE e > 0.05
UNION ALL SELECT deployment_id, 'optimise_response_time' FROM ({_MEANS}) WHERE r > 1000
UNION ALL SELECT deployment_id, 'inspect_health_checks' FROM ({_MEANS}) WHERE h < 0.95""")
def metric_recommendations(spark, sf_dir):
    return ro.metric_recommendations(ro.metric_statistics(_trailing(spark, sf_dir)))


def _actions(alerts):
    even = alerts.filter("event_id % 2 = 0").select("alert_id", F.lit("acknowledge").alias("action"))
    return even.unionByName(alerts.filter("event_id % 3 = 0").select("alert_id", F.lit("resolve").alias("action")))


@query("alert_lifecycle", f"SELECT event_id, severity, event_id % 2 = 0 AS acknowledged, event_id % 3 = 0 AS resolved FROM ({_ALERTS})")
def alert_lifecycle(spark, sf_dir):
    alerts = ro.threshold_alerts(_metrics(spark, sf_dir))
    return ro.alert_states(alerts, _actions(alerts)).select("event_id", "severity", "acknowledged", "resolved")


@query("alert_search", f"""
SELECT event_id FROM ({_ALERTS}) WHERE severity = 'HIGH' AND event_id % 2 = 0 AND event_id % 3 <> 0""")
def alert_search(spark, sf_dir):
    alerts = ro.threshold_alerts(_metrics(spark, sf_dir))
    return ro.search_alerts(ro.alert_states(alerts, _actions(alerts)), severity="HIGH", acknowledged=True, resolved=False).select("event_id")


_NAMES = ["error_rate", "response_time", "health_score", "throughput"]


@query("dashboard", f"""
SELECT s.deployment_id, s.status, p.points, p.error_rate, p.response_time, p.health_score, p.throughput, a.recent_alerts FROM ({_STATUS}) s
JOIN (SELECT deployment_id, count(*) AS points, {", ".join(f"round(avg(value) FILTER (metric_name = '{m}'), 6) AS {m}" for m in _NAMES)} FROM ({_T}) GROUP BY 1) p USING (deployment_id)
LEFT JOIN (SELECT deployment_id, string_agg(event_id, ',' ORDER BY event_id) AS recent_alerts FROM (
  SELECT *, row_number() OVER (PARTITION BY deployment_id ORDER BY created_at DESC, event_id DESC) AS rn FROM ({_ALERTS})) WHERE rn <= 10 GROUP BY 1) a USING (deployment_id)""")
def dashboard(spark, sf_dir):
    alerts = ro.threshold_alerts(_metrics(spark, sf_dir))
    board = ro.dashboard(_trailing(spark, sf_dir), alerts)
    shown = board.select("deployment_id", F.explode("recent_alerts").alias("alert_id")).join(alerts.select("alert_id", "event_id"), "alert_id")
    events = shown.groupBy("deployment_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("event_id")), lambda e: e.cast("string")), ",").alias("recent_alerts"))
    means = [F.round(F.col("means")[m], 6).alias(m) for m in _NAMES]
    return board.select("deployment_id", "status", "points", *means).join(events, "deployment_id", "left")


@query("metric_retention", f"""
SELECT deployment_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY deployment_id ORDER BY ts DESC, event_id DESC) AS rn FROM ({_M})) WHERE rn <= 100""")
def metric_retention(spark, sf_dir):
    return ro.retain_newest(_metrics(spark, sf_dir), "deployment_id", 100).select("deployment_id", "event_id")


_RUNS = f"""
SELECT *, count(*) OVER (PARTITION BY check_id, success, island ORDER BY ts, event_id) AS run FROM (
  SELECT *, row_number() OVER (PARTITION BY check_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY check_id, success ORDER BY ts, event_id) AS island FROM ({_C}))"""
_STATES = f"""
SELECT *, coalesce(lag(status) OVER (PARTITION BY check_id ORDER BY ts, event_id), 'UNKNOWN') AS old_status FROM (
  SELECT *, CASE WHEN success AND run >= 2 THEN 'HEALTHY' WHEN NOT success AND run >= 3 THEN 'UNHEALTHY' ELSE 'DEGRADED' END AS status FROM ({_RUNS}))"""


def _states(spark, sf_dir):
    return ro.health_states(derive(spark, sf_dir, CHECKS, "events"))


@query("health_states", f"""
SELECT check_id, event_id, status, old_status, CASE WHEN success THEN run ELSE 0 END AS consecutive_successes, CASE WHEN success THEN 0 ELSE run END AS consecutive_failures FROM ({_STATES})""")
def health_states(spark, sf_dir):
    return _states(spark, sf_dir).select("check_id", "event_id", "status", "old_status", "consecutive_successes", "consecutive_failures")


@query("health_transitions", f"SELECT old_status, status, count(*) AS n FROM ({_STATES}) WHERE old_status <> status GROUP BY ALL")
def health_transitions(spark, sf_dir):
    return ro.transitions(_states(spark, sf_dir)).groupBy("old_status", "status").agg(F.count("*").alias("n"))


@query("deployment_health", f"""
SELECT deployment_id, round(avg(CASE WHEN status = 'HEALTHY' THEN 1 ELSE 0 END), 6) AS health_score, count(*) AS total_checks,
  count(*) FILTER (status = 'HEALTHY') AS healthy_checks, count(*) FILTER (status = 'UNHEALTHY') AS unhealthy_checks,
  CASE WHEN bool_and(status = 'HEALTHY') THEN 'HEALTHY' WHEN bool_or(status = 'UNHEALTHY') THEN 'UNHEALTHY' ELSE 'DEGRADED' END AS overall_status
FROM (SELECT *, row_number() OVER (PARTITION BY check_id ORDER BY ts DESC, event_id DESC) AS rn FROM ({_STATES})) WHERE rn = 1 GROUP BY deployment_id""")
def deployment_health(spark, sf_dir):
    return _rounded(ro.deployment_health(ro.latest_check_states(_states(spark, sf_dir))), "health_score")


_CUSTOM_RUNS = f"""
SELECT *, count(*) OVER (PARTITION BY check_id, success, island ORDER BY ts, event_id) AS run FROM (
  SELECT *, row_number() OVER (PARTITION BY check_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY check_id, success ORDER BY ts, event_id) AS island
  FROM (SELECT *, response_time < 60 AS success FROM ({plain(OBSERVATIONS)})))"""


@query("custom_health_check", f"""
SELECT event_id, CASE WHEN success AND run >= 2 THEN 'HEALTHY' WHEN NOT success AND run >= 3 THEN 'UNHEALTHY' ELSE 'DEGRADED' END AS status FROM ({_CUSTOM_RUNS})""")
def custom_health_check(spark, sf_dir):
    results = ro.custom_checks(derive(spark, sf_dir, OBSERVATIONS, "events"), F.col("response_time") < 60)
    return ro.health_states(results).select("event_id", "status")


POINTS = """
SELECT concat('canary-', cast(user_id % 40 AS string)) AS canary_id, ts, event_id,
       CASE WHEN event_type = 'error' AND value > 100 THEN 'error' WHEN event_type = 'click' THEN 'health_score' ELSE 'request' END AS metric_type,
       1 - value / 3000 AS value FROM {events}
"""
_P = plain(POINTS)


@query("canary_decisions", f"""
SELECT canary_id, errors, requests, round(health, 6) AS health_score, health < 0.95 OR errors / greatest(requests, 1) > 0.05 AS should_rollback,
  health >= 0.95 OR errors / greatest(requests, 1) <= 0.05 AS should_advance,
  CASE WHEN health < 0.95 OR errors / greatest(requests, 1) > 0.05 THEN 'ROLLBACK' ELSE 'ADVANCE' END AS decision
FROM (SELECT canary_id, count(*) FILTER (metric_type = 'error') AS errors, count(*) FILTER (metric_type = 'request') AS requests,
  arg_max(value, ts) FILTER (metric_type = 'health_score') AS health FROM ({_P}) GROUP BY canary_id)""")
def canary_decisions(spark, sf_dir):
    d = ro.canary_decisions(ro.canary_counters(derive(spark, sf_dir, POINTS, "events")))
    return d.select("canary_id", "errors", "requests", F.round("health_score", 6).alias("health_score"), "should_rollback", "should_advance", "decision")


# One evaluation per event: a rare rollback, an advance on most clicks.
EVALUATIONS = """
SELECT concat('canary-', cast(user_id AS string)) AS canary_id, ts, event_id, value > 250 AS should_rollback, event_type = 'click' AND value > 60 AS should_advance FROM {events}
"""


@query("canary_progress", f"""
SELECT canary_id, event_id, CAST([0, 5, 10, 25, 50, 75, 100][1 + least(adv, 6)] AS INT) AS percentage,
  CASE WHEN should_rollback THEN 'ROLLED_BACK' WHEN adv >= 6 THEN 'COMPLETED' ELSE 'RUNNING' END AS state
FROM (SELECT *, CAST(sum(CASE WHEN should_advance AND NOT should_rollback THEN 1 ELSE 0 END) OVER w AS BIGINT) AS adv,
        coalesce(sum(CASE WHEN should_rollback THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped
      FROM ({plain(EVALUATIONS)}) WINDOW w AS (PARTITION BY canary_id ORDER BY ts, event_id)) WHERE stopped = 0""")
def canary_progress(spark, sf_dir):
    return ro.canary_progress(derive(spark, sf_dir, EVALUATIONS, "events")).select("canary_id", "event_id", "percentage", "state")


@query("canary_next_step", f"""
SELECT event_id, CAST(CASE WHEN p < 5 THEN 5 WHEN p < 10 THEN 10 WHEN p < 25 THEN 25 WHEN p < 50 THEN 50 WHEN p < 75 THEN 75 WHEN p < 100 THEN 100 END AS INT) AS next
FROM (SELECT event_id, event_id % 101 AS p FROM events)""")
def canary_next_step(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", ro.next_step(F.col("event_id") % 101).alias("next"))


@query("rollback_first_crossing", f"""
SELECT deployment_id, metric_name, event_id, round(value, 6) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY deployment_id, metric_name ORDER BY ts, event_id) AS rn FROM ({_M})
  WHERE (metric_name = 'health_score' AND value < 0.95) OR (metric_name = 'error_rate' AND value > 0.05) OR (metric_name = 'response_time' AND value > 2000)) WHERE rn = 1""")
def rollback_first_crossing(spark, sf_dir):
    c = ro.first_crossings(_metrics(spark, sf_dir))
    return c.select("deployment_id", "metric_name", "event_id", F.round("value", 6).alias("value"))


DEPLOYMENTS = """
SELECT concat('deploy-', cast(user_id AS string)) AS deployment_id, ts, event_id, upper(event_type) AS status, cast(event_id % 101 AS int) AS target_percentage FROM {events}
"""


@query("deployment_roster", f"""
SELECT deployment_id, arg_max(status, ts) AS status, arg_max(target_percentage, ts) AS target, CAST(100 - arg_max(target_percentage, ts) AS INT) AS current
FROM ({plain(DEPLOYMENTS)}) GROUP BY deployment_id""")
def deployment_roster(spark, sf_dir):
    return ro.roster(derive(spark, sf_dir, DEPLOYMENTS, "events")).drop("created_at")


@query("traffic_split", """
SELECT c_custkey, CAST('0x' || left(md5(CAST(c_custkey AS VARCHAR)), 8) AS BIGINT) % 100 < 30 AS to_target FROM customer""")
def traffic_split(spark, sf_dir):
    return ro.traffic_split(load(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 30)


# The standard limits bind rarely on this stream, so a tight table is used as well.
TIGHT = [("migration", 2, 86400), ("file_ops", 5, 43200), ("api_calls", 1, 86400), ("analysis", 3, 172800)]


# Request by request, carrying the admitted times of one window.
def _admitted(limits) -> str:
    values = ", ".join(f"('{op}', {most}, {span})" for op, most, span in limits)
    return f"""
WITH RECURSIVE r AS (SELECT q.op, q.user_id, q.event_id, epoch_us(q.ts) AS t, l.most, CAST(l.span AS BIGINT) * 1000000 AS span,
    row_number() OVER (PARTITION BY q.op, q.user_id ORDER BY q.ts, q.event_id) AS rn
  FROM ({_R}) q JOIN (VALUES {values}) l(op, most, span) ON l.op = q.op),
a AS (SELECT op, user_id, event_id, t, rn, true AS admitted, [t] AS times FROM r WHERE rn = 1
  UNION ALL SELECT op, user_id, event_id, t, rn, len(live) < most, CASE WHEN len(live) < most THEN list_append(live, t) ELSE live END
  FROM (SELECT r.*, list_filter(a.times, lambda x: r.t - x < r.span) AS live FROM a JOIN r ON r.op = a.op AND r.user_id = a.user_id AND r.rn = a.rn + 1)),
free AS (SELECT op, user_id, event_id, true AS admitted FROM ({_R}) WHERE op = 'other')"""


_ADMITTED = _admitted(TIGHT)
STATE_AT = "2024-01-20 12:00:00"
_LIVE = _ADMITTED + f""",
live AS (SELECT a.op, a.user_id, count(*) AS in_window, CAST((min(a.t) + any_value(r.span) - epoch_us(TIMESTAMP '{STATE_AT}')) // 1000000 AS INT) AS retry_after
  FROM a JOIN r USING (op, user_id, rn) WHERE a.admitted AND a.t <= epoch_us(TIMESTAMP '{STATE_AT}') AND epoch_us(TIMESTAMP '{STATE_AT}') - a.t < r.span GROUP BY a.op, a.user_id)"""


def _decisions(spark, sf_dir, rows=None):
    limits = spark.createDataFrame(rows, "op string, max_requests int, window_seconds int") if rows else ro.limit_table(spark)
    return ro.rate_limit(derive(spark, sf_dir, REQUESTS, "events"), limits), limits


@query("rate_limit_admissions", _ADMITTED + " SELECT op, user_id, event_id, admitted FROM a UNION ALL SELECT * FROM free")
def rate_limit_admissions(spark, sf_dir):
    return _decisions(spark, sf_dir, TIGHT)[0].select("op", "user_id", "event_id", "admitted")


@query("rate_limit_standard", _admitted(ro.LIMITS) + " SELECT op, user_id, event_id, admitted FROM a UNION ALL SELECT * FROM free")
def rate_limit_standard(spark, sf_dir):
    return _decisions(spark, sf_dir)[0].select("op", "user_id", "event_id", "admitted")


# Blocks of 200 requests: sessions are cut, and the states of the blocks have to meet.
@query("rate_limit_blocks", _ADMITTED + " SELECT op, user_id, event_id, admitted FROM a UNION ALL SELECT * FROM free")
def rate_limit_blocks(spark, sf_dir):
    limits = spark.createDataFrame(TIGHT, "op string, max_requests int, window_seconds int")
    return ro.rate_limit(derive(spark, sf_dir, REQUESTS, "events"), limits, block=200).select("op", "user_id", "event_id", "admitted")


def _limiter_state(spark, sf_dir):
    return ro.limiter_state(*_decisions(spark, sf_dir, TIGHT), F.lit(STATE_AT))


@query("rate_limit_state", _LIVE + " SELECT * FROM live")
def rate_limit_state(spark, sf_dir):
    return _limiter_state(spark, sf_dir)


@query("rate_limit_statistics", _LIVE + " SELECT op, count(*) AS active_users, CAST(sum(in_window) AS BIGINT) AS total_requests FROM live GROUP BY op")
def rate_limit_statistics(spark, sf_dir):
    return ro.limiter_statistics(_limiter_state(spark, sf_dir))


# With one admission per window the next admitted request is a fixed function of the last, which SQL can follow.
@query("rate_limit_single", """
WITH RECURSIVE r AS (SELECT concat('user-', user_id % 5) AS user_id, ts, event_id FROM events WHERE event_type = 'click'),
n AS (SELECT a.user_id, a.ts, a.event_id, (SELECT min(b.ts) FROM r b WHERE b.user_id = a.user_id AND b.ts >= a.ts + INTERVAL 1 DAY) AS nxt FROM r a),
a AS (SELECT n.* FROM n JOIN (SELECT user_id, min(ts) AS t FROM r GROUP BY 1) f ON f.user_id = n.user_id AND f.t = n.ts
  UNION ALL SELECT n.* FROM a JOIN n ON n.user_id = a.user_id AND n.ts = a.nxt)
SELECT user_id, event_id FROM a""")
def rate_limit_single(spark, sf_dir):
    return _decisions(spark, sf_dir, TIGHT)[0].filter("op = 'api_calls' AND admitted").select("user_id", "event_id")


@query("event_windows_tumbling", """
SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def event_windows_tumbling(spark, sf_dir):
    out = ro.windowed_counts(load(spark, sf_dir, "events"), "1 hour")
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


@query("event_windows_sliding", """
SELECT strftime(time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * i, '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n
FROM events, range(0, 4) t(i) GROUP BY ALL""")
def event_windows_sliding(spark, sf_dir):
    out = ro.windowed_counts(load(spark, sf_dir, "events"), "1 hour", "15 minutes")
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))
