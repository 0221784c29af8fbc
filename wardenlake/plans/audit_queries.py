"""Audit-log analytics over the event stream as audit events."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardenlake.operators import audit
from wardenlake.plans.derived import AUDIT_RAW
from wardenlake.plans.registry import derive, plain, query

_RAW = plain(AUDIT_RAW)
# The audit schema in SQL, with the flags spelled out.
_NORM = f"""
SELECT tenant, source_id, event_type, ts AS timestamp_utc, CAST(floor(epoch(ts)) AS BIGINT) AS timestamp_unix,
  left(sha256(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || user_name || resource || action), 16) AS event_id,
  CASE WHEN user_name = '' THEN 'ANONYMOUS' ELSE left(sha256(user_name), 16) END AS user_hash, upper(action) AS action, upper(result) AS result,
  CASE WHEN resource = '' THEN 'UNKNOWN' WHEN starts_with(resource, '/') THEN string_split(resource, '/')[-1] ELSE resource END AS resource,
  CASE WHEN starts_with(project_path, '/') THEN string_split(project_path, '/')[-1] ELSE project_path END AS project_path, severity,
  regexp_matches(lower(resource), 'user|profile|personal|contact|email|phone') AS pii,
  regexp_matches(lower(resource), 'medical|health|patient|diagnosis|treatment|pharmacy') AS phi,
  CASE WHEN regexp_matches(lower(resource), 'secret|key|password|token') THEN 'RESTRICTED'
       WHEN regexp_matches(lower(resource), 'user|personal|profile') THEN 'CONFIDENTIAL'
       WHEN regexp_matches(lower(resource), 'config|setting|log') THEN 'INTERNAL' ELSE 'PUBLIC' END AS classification
FROM ({_RAW})"""
AS_OF = "2024-01-31 00:00:00"


def _events(spark, sf_dir):
    raw = derive(spark, sf_dir, AUDIT_RAW, "events")
    shaped = raw.withColumn("details", F.create_map(F.lit("severity"), "severity", F.lit("project_path"), "project_path")).withColumnRenamed("user_name", "user")
    return _with_tenant(shaped)


def _with_tenant(shaped):
    """Normalise and keep the tenant, which the audit schema itself does not hold."""
    carried = shaped.withColumn("details", F.map_concat("details", F.create_map(F.lit("tenant"), "tenant", F.lit("source"), F.col("source_id").cast("string"))))
    return audit.normalise(carried).withColumn("tenant", F.col("details")["tenant"])


@query("audit_normalised", f"""
SELECT source_id, event_id, event_type, timestamp_unix, user_hash AS "user", action, resource, result, project_path, pii AS gdpr_pii_processed,
  phi AS hipaa_phi_accessed, classification AS data_classification FROM ({_NORM})""")
def audit_normalised(spark, sf_dir):
    return shown(_events(spark, sf_dir))


def shown(events):
    return events.select(F.col("details")["source"].cast("bigint").alias("source_id"), "event_id", "event_type", "timestamp_unix", "user", "action",
                         "resource", "result", F.col("details")["project_path"].alias("project_path"), "compliance.*")


@query("audit_search", f"""
SELECT event_id, event_type, "action", result FROM ({_NORM})
WHERE event_type = 'FILE_ACCESS' AND user_hash = left(sha256('user-7'), 16)
  AND timestamp_utc >= TIMESTAMP '2024-01-05 00:00:00' AND timestamp_utc < TIMESTAMP '2024-01-25 00:00:00'
ORDER BY timestamp_utc, event_id LIMIT 20""")
def audit_search(spark, sf_dir):
    found = audit.search(_events(spark, sf_dir), "FILE_ACCESS", "user-7", F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"),
                         F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"), 20)
    return found.select("event_id", "event_type", "action", "result")


_AGG = """count(*) AS total_events, count(DISTINCT user_hash) AS unique_users,
  count(*) FILTER (event_type = 'FILE_ACCESS') AS file_access_count, count(*) FILTER (event_type = 'MIGRATION_EVENT') AS migration_events,
  count(*) FILTER (event_type = 'SECURITY_VIOLATION') AS security_violations, count(*) FILTER (pii) AS gdpr_pii_events,
  count(*) FILTER (phi) AS hipaa_phi_events, count(*) FILTER (action IN ('READ', 'WRITE', 'DELETE')) AS data_access_events,
  count(*) FILTER (result = 'FAILURE') AS failed_operations"""
_PERIOD = f"timestamp_utc >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY AND timestamp_utc < TIMESTAMP '{AS_OF}'"


def _in_compliance_period(spark, sf_dir):
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    return audit.in_period(_events(spark, sf_dir), *audit.default_period("compliance", as_of))


@query("audit_compliance", f"SELECT {_AGG} FROM ({_NORM}) WHERE {_PERIOD}")
def audit_compliance(spark, sf_dir):
    return audit.compliance_aggregate(_in_compliance_period(spark, sf_dir))


@query("audit_compliance_by_tenant_day", f"SELECT tenant, CAST(timestamp_utc AS DATE) AS day, {_AGG} FROM ({_NORM}) GROUP BY ALL")
def audit_compliance_by_tenant_day(spark, sf_dir):
    events = _events(spark, sf_dir).withColumn("day", F.to_date("timestamp_utc"))
    return audit.compliance_aggregate(events, ["tenant", "day"])


@query("audit_top_users", f"""SELECT user_hash AS value, count(*) AS events FROM ({_NORM}) GROUP BY 1 ORDER BY events DESC, value LIMIT 10""")
def audit_top_users(spark, sf_dir):
    return audit.top_values(_events(spark, sf_dir), "user")


@query("audit_top_resources", f"""SELECT resource AS value, count(*) AS events FROM ({_NORM}) GROUP BY 1 ORDER BY events DESC, value LIMIT 10""")
def audit_top_resources(spark, sf_dir):
    return audit.top_values(_events(spark, sf_dir), "resource")


def _score_sql(framework: str) -> str:
    rows = ", ".join(f"('{s}', '{c}', {score}, '{driver or ''}')" for f, s, c, score, driver in audit.CONTROLS if f == framework)
    return f"""
WITH a AS (SELECT tenant, count(*) FILTER (event_type = 'SECURITY_VIOLATION') AS violations, count(*) FILTER (pii) AS pii FROM ({_NORM}) GROUP BY tenant),
s AS (SELECT tenant, section, control, CAST(CASE WHEN driver = 'violations' AND violations > 0 THEN 50 ELSE score END AS INT) AS score,
      CASE driver WHEN 'violations' THEN violations = 0 WHEN 'pii_events' THEN pii > 0 ELSE true END AS compliant
      FROM a, (VALUES {rows}) c(section, control, score, driver))"""


def _controls(spark, sf_dir, framework):
    return audit.control_scores(audit.compliance_aggregate(_events(spark, sf_dir), ["tenant"]), framework, ["tenant"])


def _register_scores(framework: str) -> None:
    @query(f"audit_{framework.lower()}_score", _score_sql(framework) + f"""
SELECT tenant, '{framework}' AS framework, count(*) AS controls, round(avg(score), 1) AS overall_score,
  CASE WHEN avg(score) >= 90 THEN 'A' WHEN avg(score) >= 80 THEN 'B' ELSE 'C' END AS grade,
  CASE WHEN avg(score) >= 80 THEN 'COMPLIANT' ELSE 'NEEDS_IMPROVEMENT' END AS status FROM s GROUP BY tenant""")
    def run(spark, sf_dir):
        return audit.framework_score(_controls(spark, sf_dir, framework), ["tenant"])

    @query(f"audit_{framework.lower()}_controls", _score_sql(framework) + "SELECT tenant, section, control, score, compliant FROM s")
    def controls(spark, sf_dir):
        return _controls(spark, sf_dir, framework).drop("framework")


for _framework in ("SOC2", "GDPR", "HIPAA"):
    _register_scores(_framework)


@query("audit_soc2_improvements", _score_sql("SOC2") + """
SELECT tenant, section, control, score, 'Improve ' || section || ' - ' || control || ': Current score ' || score AS recommendation FROM s WHERE score < 90""")
def audit_soc2_improvements(spark, sf_dir):
    return audit.improvements(_controls(spark, sf_dir, "SOC2"), ["tenant"]).drop("framework")


@query("audit_security_report", f"""
SELECT tenant, count(*) FILTER (contains(lower(action), 'auth')) AS total_attempts,
  count(*) FILTER (contains(lower(action), 'auth') AND result = 'SUCCESS') AS successful_logins,
  count(*) FILTER (contains(lower(action), 'auth') AND result = 'FAILURE') AS failed_logins,
  count(*) FILTER (result = 'SUCCESS') AS access_granted, count(*) FILTER (result = 'DENIED') AS access_denied,
  count(*) FILTER (event_type = 'SECURITY_VIOLATION') AS total_incidents,
  count(*) FILTER (event_type = 'SECURITY_VIOLATION' AND severity = 'CRITICAL') AS critical_incidents,
  count(*) FILTER (event_type = 'SECURITY_VIOLATION') AS resolved_incidents
FROM ({_NORM}) WHERE timestamp_utc >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND timestamp_utc < TIMESTAMP '{AS_OF}' GROUP BY tenant""")
def audit_security_report(spark, sf_dir):
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    return audit.security_audit(audit.in_period(_events(spark, sf_dir), *audit.default_period("security", as_of)), ["tenant"])


@query("audit_detail_redaction", f"""
SELECT source_id, '{{"project_path":"' || project_path || '","note":"/kept"}}' AS details FROM ({_NORM})""")
def audit_detail_redaction(spark, sf_dir):
    raw = derive(spark, sf_dir, AUDIT_RAW, "events")
    details = F.concat(F.lit('{"project_path":"'), "project_path", F.lit('","note":"/kept"}'))
    return raw.select("source_id", audit.clean_details_json(details).alias("details"))
