"""Audit-event normalisation, search, compliance aggregates and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenlake.functions.text import contains_any

# Words that mark personal, health and classified resources.
PERSONAL_WORDS = ["user", "profile", "personal", "contact", "email", "phone"]
HEALTH_WORDS = ["medical", "health", "patient", "diagnosis", "treatment", "pharmacy"]
RESTRICTED_WORDS = ["secret", "key", "password", "token"]
CONFIDENTIAL_WORDS = ["user", "personal", "profile"]
INTERNAL_WORDS = ["config", "setting", "log"]

# Framework, section, control, score, what makes it data-driven.
CONTROLS = [
    ("SOC2", "security", "access_control", 100, "violations"),
    ("SOC2", "security", "incident_response", 90, None),
    ("SOC2", "security", "risk_management", 85, None),
    ("SOC2", "availability", "service_availability", 95, None),
    ("SOC2", "availability", "disaster_recovery", 80, None),
    ("SOC2", "processing_integrity", "data_accuracy", 90, None),
    ("SOC2", "processing_integrity", "processing_completeness", 85, None),
    ("SOC2", "confidentiality", "data_encryption", 95, None),
    ("SOC2", "confidentiality", "access_controls", 85, "pii_events"),
    ("SOC2", "privacy", "privacy_policy", 90, None),
    ("SOC2", "privacy", "consent_management", 85, None),
    ("GDPR", "article_5_data_principles", "lawfulness", 90, None),
    ("GDPR", "article_5_data_principles", "fairness", 90, None),
    ("GDPR", "article_5_data_principles", "transparency", 85, None),
    ("GDPR", "article_5_data_principles", "purpose_limitation", 85, None),
    ("GDPR", "article_5_data_principles", "data_minimization", 80, None),
    ("GDPR", "article_5_data_principles", "accuracy", 90, None),
    ("GDPR", "article_5_data_principles", "storage_limitation", 85, None),
    ("GDPR", "article_5_data_principles", "security", 90, None),
    ("GDPR", "article_25_privacy_by_design", "privacy_by_design", 85, None),
    ("GDPR", "article_25_privacy_by_design", "privacy_by_default", 85, None),
    ("GDPR", "article_32_security_of_processing", "technical_measures", 90, None),
    ("GDPR", "article_32_security_of_processing", "organizational_measures", 85, None),
    ("GDPR", "article_33_breach_notification", "notification_procedure", 85, None),
    ("GDPR", "article_33_breach_notification", "timeline", 90, None),
    ("GDPR", "article_35_dpia", "dpia_process", 80, None),
    ("GDPR", "article_35_dpia", "documentation", 85, None),
    ("HIPAA", "privacy_rule", "phi_protection", 90, None),
    ("HIPAA", "privacy_rule", "minimum_necessary", 85, None),
    ("HIPAA", "privacy_rule", "patient_rights", 85, None),
    ("HIPAA", "security_rule", "administrative_safeguards", 85, None),
    ("HIPAA", "security_rule", "physical_safeguards", 80, None),
    ("HIPAA", "security_rule", "technical_safeguards", 90, None),
    ("HIPAA", "breach_notification_rule", "breach_detection", 85, None),
    ("HIPAA", "breach_notification_rule", "notification_procedure", 85, None),
    ("HIPAA", "enforcement_rule", "compliance_program", 85, None),
    ("HIPAA", "enforcement_rule", "policies_procedures", 85, None),
]
VIOLATED_ACCESS_SCORE = 50
COMPLIANCE_DAYS, SECURITY_DAYS = 90, 30


def user_hash(user: Column) -> Column:
    return F.when(F.coalesce(user, F.lit("")) == "", F.lit("ANONYMOUS")).otherwise(F.substring(F.sha2(user, 256), 1, 16))


def clean_resource(path: Column) -> Column:
    """Absolute paths keep their last part; an empty path is UNKNOWN."""
    bare = F.regexp_replace(path, "/+$", "")
    return (F.when(F.coalesce(path, F.lit("")) == "", F.lit("UNKNOWN"))
            .when(path.startswith("/"), F.element_at(F.split(bare, "/"), -1)).otherwise(path))


def clean_details(details: Column) -> Column:
    """Redact absolute paths under keys that name a path."""
    return F.transform_values(details, lambda k, v: F.when(
        k.endswith("_path") | (k == "path"), clean_resource(v)).otherwise(v))


def clean_details_json(details: Column) -> Column:
    """The same for nested JSON text: path-valued keys at any depth keep the last path part."""
    return F.regexp_replace(details, r'("(?:[^"\\]*_path|path)"\s*:\s*")(?:/[^"/]*)*/([^"/]+)/*"', '$1$2"')


def has_pii(resource: Column) -> Column:
    return contains_any(F.lower(resource), PERSONAL_WORDS)


def has_phi(resource: Column) -> Column:
    return contains_any(F.lower(resource), HEALTH_WORDS)


def classify(resource: Column) -> Column:
    lowered = F.lower(resource)
    return (F.when(contains_any(lowered, RESTRICTED_WORDS), "RESTRICTED")
            .when(contains_any(lowered, CONFIDENTIAL_WORDS), "CONFIDENTIAL")
            .when(contains_any(lowered, INTERNAL_WORDS), "INTERNAL").otherwise("PUBLIC"))


def normalise(events: DataFrame) -> DataFrame:
    """Raw events (ts, event_type, user, action, resource, result, details) to the audit schema."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return events.select(
        F.substring(F.sha2(F.concat(stamp, F.coalesce("user", F.lit("")), "resource", "action"), 256), 1, 16).alias("event_id"),
        "event_type", F.col("ts").alias("timestamp_utc"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("timestamp_unix"),
        user_hash(F.col("user")).alias("user"), F.upper("action").alias("action"),
        clean_resource(F.col("resource")).alias("resource"), F.upper("result").alias("result"),
        clean_details(F.col("details")).alias("details"),
        F.struct(has_pii(F.col("resource")).alias("gdpr_pii_processed"), has_phi(F.col("resource")).alias("hipaa_phi_accessed"),
                 classify(F.col("resource")).alias("data_classification")).alias("compliance"))


def in_period(events: DataFrame, start: Column | None, end: Column | None) -> DataFrame:
    """Half-open: start included, end excluded."""
    if start is not None:
        events = events.filter(F.col("timestamp_utc") >= start)
    return events if end is None else events.filter(F.col("timestamp_utc") < end)


def default_period(report: str, as_of: Column) -> tuple[Column, Column]:
    if report == "log":
        return F.date_trunc("day", as_of), as_of
    days = SECURITY_DAYS if report == "security" else COMPLIANCE_DAYS
    return as_of - F.expr(f"INTERVAL {days} DAYS"), as_of


def search(events: DataFrame, event_type: str | None = None, user: str | None = None, start: Column | None = None,
           end: Column | None = None, limit: int | None = None) -> DataFrame:
    """All matches, or the first ``limit`` by time; ``user`` is the plain name and is hashed here."""
    found = in_period(events, start, end)
    if event_type is not None:
        found = found.filter(F.col("event_type") == event_type)
    if user is not None:
        found = found.filter(F.col("user") == user_hash(F.lit(user)))
    return found if limit is None else found.orderBy("timestamp_utc", "event_id").limit(limit)


def _count(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0))


def compliance_aggregate(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals of the compliance report, overall or per group.

    Distinct users come from a first grouping by user, so a group with a third of
    all events is already reduced to its users before the second shuffle.
    """
    by = by or []
    kind, action = F.col("event_type"), F.col("action")
    partial = events.groupBy(*by, "user").agg(
        F.count("*").alias("n"),
        _count(kind == "FILE_ACCESS").alias("file_access_count"), _count(kind == "MIGRATION_EVENT").alias("migration_events"),
        _count(kind == "SECURITY_VIOLATION").alias("security_violations"),
        _count(F.col("compliance.gdpr_pii_processed")).alias("gdpr_pii_events"),
        _count(F.col("compliance.hipaa_phi_accessed")).alias("hipaa_phi_events"),
        _count(action.isin("READ", "WRITE", "DELETE")).alias("data_access_events"),
        _count(F.col("result") == "FAILURE").alias("failed_operations"))
    sums = ["file_access_count", "migration_events", "security_violations", "gdpr_pii_events", "hipaa_phi_events",
            "data_access_events", "failed_operations"]
    return partial.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_events"), F.count("*").alias("unique_users"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums])


def top_values(events: DataFrame, column: str, k: int = 10) -> DataFrame:
    counts = events.groupBy(F.coalesce(F.col(column), F.lit("UNKNOWN")).alias("value")).agg(F.count("*").alias("events"))
    return counts.orderBy(F.desc("events"), "value").limit(k)


def control_scores(aggregate: DataFrame, framework: str, by: list[str] | None = None) -> DataFrame:
    """Scores per control and group; a framework's controls are a literal list, unrolled per row."""
    by = by or []

    def control(section: str, name: str, base: int, driver: str | None) -> Column:
        violations, personal = F.col("security_violations"), F.col("gdpr_pii_events")
        score = F.when(violations > 0, VIOLATED_ACCESS_SCORE).otherwise(base) if driver == "violations" else F.lit(base)
        compliant = violations == 0 if driver == "violations" else personal > 0 if driver == "pii_events" else F.lit(True)
        return F.struct(F.lit(section).alias("section"), F.lit(name).alias("control"), score.alias("score"), compliant.alias("compliant"))

    rows = F.explode(F.array(*[control(*c[1:]) for c in CONTROLS if c[0] == framework])).alias("c")
    return aggregate.select(*by, F.lit(framework).alias("framework"), rows).select(*by, "framework", "c.*")


def framework_score(controls: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    return (controls.groupBy(*by, "framework").agg(F.avg("score").alias("_mean"), F.count("*").alias("controls"))
            .select(*by, "framework", "controls", F.round("_mean", 1).alias("overall_score"),
                    F.when(F.col("_mean") >= 90, "A").when(F.col("_mean") >= 80, "B").otherwise("C").alias("grade"),
                    F.when(F.col("_mean") >= 80, "COMPLIANT").otherwise("NEEDS_IMPROVEMENT").alias("status")))


def improvements(controls: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    return controls.filter(F.col("score") < 90).select(*by, "framework", "section", "control", "score", F.concat(
        F.lit("Improve "), "section", F.lit(" - "), "control", F.lit(": Current score "),
        F.col("score").cast("string")).alias("recommendation"))


def security_audit(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    auth = F.lower("action").contains("auth")
    incident = F.col("event_type") == "SECURITY_VIOLATION"
    return events.groupBy(*(by or [])).agg(
        _count(auth).alias("total_attempts"), _count(auth & (F.col("result") == "SUCCESS")).alias("successful_logins"),
        _count(auth & (F.col("result") == "FAILURE")).alias("failed_logins"),
        _count(F.col("result") == "SUCCESS").alias("access_granted"), _count(F.col("result") == "DENIED").alias("access_denied"),
        _count(incident).alias("total_incidents"),
        _count(incident & (F.element_at("details", F.lit("severity")) == "CRITICAL")).alias("critical_incidents"),
        _count(incident).alias("resolved_incidents"))
