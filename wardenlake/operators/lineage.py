"""Data-flow mentions in code: sources, operations, personal-data flows, graph and issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardenlake.functions.text import Spec, let, line_window, located

# Connection calls in Python, group 1 is the connection string.
DATABASE_CALLS = [
    r"connect\([\"']([^\"']+)[\"']",
    r"create_engine\([\"']([^\"']+)[\"']",
    r"psycopg2\.connect\([\"']([^\"']+)[\"']",
    r"mysql\.connect\([\"']([^\"']+)[\"']",
    r"sqlite3\.connect\([\"']([^\"']+)[\"']",
]
# Endpoint calls in JavaScript, with the group that holds the endpoint.
ENDPOINT_CALLS = [
    (r"fetch\([\"']([^\"']+)[\"']", 1),
    (r"axios\.(get|post|put|delete)\([\"']([^\"']+)[\"']", 2),
    (r"\$\.ajax\([\"']([^\"']+)[\"']", 1),
    (r"request\([\"']([^\"']+)[\"']", 1),
]
CONFIG_KEYS = ["DATABASE_URL", "DB_HOST", "DB_NAME", "DB_USER", "API_KEY", "SECRET_KEY"]
# Operations by language.
PYTHON_OPERATIONS = [
    (r"(\w+)\.execute\(", "sql_execute"), (r"(\w+)\.select\(", "data_select"),
    (r"(\w+)\.insert\(", "data_insert"), (r"(\w+)\.update\(", "data_update"),
    (r"(\w+)\.delete\(", "data_delete"), (r"requests\.(get|post|put|delete)\(", "http_request"),
    (r"json\.loads\(", "json_parse"), (r"json\.dumps\(", "json_serialize"),
]
SCRIPT_OPERATIONS = [
    (r"\.then\(", "async_operation"), (r"localStorage\.(get|set)Item", "local_storage"),
    (r"sessionStorage\.(get|set)Item", "session_storage"), (r"JSON\.(parse|stringify)", "json_operation"),
    (r"\.map\(", "data_transformation"), (r"\.filter\(", "data_filtering"), (r"\.reduce\(", "data_aggregation"),
]
FLOW_WORDS = [
    (r"(?iu)(email|phone|ssn|credit_card|password)", "pii_field"),
    (r"(?iu)(user|customer|patient)", "entity_with_pii"),
    (r"(?iu)(encrypt|decrypt|hash)", "crypto_operation"),
    (r"(?iu)(mask|anonymize|redact)", "data_protection"),
]
SCRIPT_EXTENSIONS = [".js", ".jsx", ".ts", ".tsx"]
CONFIG_EXTENSIONS = [".json", ".yaml", ".yml", ".env"]

HIT = "array<struct<kind:string,label:string,value:string,line:int,start:int,context:string>>"


def _specs(kind: str, rules: list[tuple[str, str, int]]) -> list[Spec]:
    return [Spec(f"{kind}|{label}", pattern, group) for pattern, label, group in rules]


def _hits(text: Column, lines: Column, specs: list[Spec]) -> Column:
    """All matches; ``value`` is the capture group the rule names, or the match."""
    def shape(m: Column) -> Column:
        line = m["newlines_before"] + 1
        return F.struct(F.split_part(m["tag"], F.lit("|"), F.lit(1)).alias("kind"),
                        F.split_part(m["tag"], F.lit("|"), F.lit(2)).alias("label"), m["value"].alias("value"),
                        line.alias("line"), m["start"].alias("start"), line_window(lines, line).alias("context"))

    return F.transform(located(text, specs), shape)


def redact_connection(value: Column) -> Column:
    value = F.regexp_replace(value, "(?iu)password=[^;]+", "password=***")
    value = F.regexp_replace(value, "(?iu)pwd=[^;]+", "pwd=***")
    return F.regexp_replace(value, "//[^:]+:[^@]+@", "//***:***@")


def _config_hits(text: Column, lines: Column) -> Column:
    def one(key: str) -> Column:
        at = F.instr(text, key)
        before = F.substr(text, F.lit(1), at - 1)
        line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
        return F.when(at > 0, F.struct(
            F.lit("data_source").alias("kind"), F.lit("config_database").alias("label"), F.lit(key).alias("value"),
            line.alias("line"), (at - 1).alias("start"), line_window(lines, line).alias("context")))

    return F.filter(F.array(*[one(k) for k in CONFIG_KEYS]), lambda h: h.isNotNull())


def mentions(files: DataFrame) -> DataFrame:
    """One row per source, operation and personal-data mention.

    ``files`` has project, path, ext, content.  Each file is read once; the text is
    dropped before the rows are exploded.
    """
    text = F.col("content")

    def of_file(lines: Column) -> Column:
        python = _hits(text, lines, [
            *_specs("data_source", [(p, "database", 1) for p in DATABASE_CALLS]),
            *_specs("transformation", [(p, t, 0) for p, t in PYTHON_OPERATIONS]),
            *_specs("pii_flow", [(p, t, 0) for p, t in FLOW_WORDS])])
        script = _hits(text, lines, [
            *_specs("data_source", [(p, "api_endpoint", g) for p, g in ENDPOINT_CALLS]),
            *_specs("transformation", [(p, t, 0) for p, t in SCRIPT_OPERATIONS])])
        return (F.when(F.col("ext") == ".py", python)
                .when(F.col("ext").isin(SCRIPT_EXTENSIONS), script)
                .when(F.col("ext").isin(CONFIG_EXTENSIONS), _config_hits(text, lines).cast(HIT)))

    relevant = files.filter(F.col("ext").isin([".py", *SCRIPT_EXTENSIONS, *CONFIG_EXTENSIONS]))
    rows = relevant.select("project", "path", F.explode_outer(
        let(F.split(text, "\n", -1), of_file)).alias("hit")).filter(F.col("hit").isNotNull()).select("project", "path", "hit.*")
    secret = F.lower("value").contains("password") & (F.col("label") == "database")
    return (
        rows.withColumn("mentions_password", secret)
        .withColumn("value", F.when(F.col("label") == "database", redact_connection(F.col("value"))).otherwise(F.col("value")))
        .withColumn("node_id", F.substring(F.sha2(F.concat_ws(
            "|", "project", "path", "kind", "label", F.col("start").cast("string"), "value"), 256), 1, 16)))


def data_sources(found: DataFrame) -> DataFrame:
    """Each source once a line, also where two call rules match it."""
    return found.filter(F.col("kind") == "data_source").select("project", "path", "label", "value", "line").distinct()


def transformations(found: DataFrame) -> DataFrame:
    return found.filter(F.col("kind") == "transformation").select("project", "path", "label", "line", "context")


def pii_flows(found: DataFrame) -> DataFrame:
    return found.filter(F.col("kind") == "pii_flow").select("project", "path", "label", "value", "line", "context")


def lineage_nodes(found: DataFrame) -> DataFrame:
    return found.select("project", "path", "node_id", F.col("kind").alias("type"), "label", "line")


def lineage_edges(found: DataFrame) -> DataFrame:
    """Each mention points to the next one of the same file, by position."""
    order = Window.partitionBy("project", "path").orderBy("start", "kind", "label", "node_id")
    return (found.select("project", "path", "start", "kind", "label", "node_id", F.lead("node_id").over(order).alias("target"))
            .filter(F.col("target").isNotNull())
            .select("project", "path", F.col("node_id").alias("source"), "target", F.lit("data_flow").alias("type")))


def issues(found: DataFrame) -> DataFrame:
    """Unencrypted storage, credentials in a connection string, personal data in an endpoint."""
    def rule(condition: Column, severity: str, kind: str, advice: str) -> DataFrame:
        return found.filter(condition).select(
            "project", "path", "line", F.lit(severity).alias("severity"), F.lit(kind).alias("type"),
            F.lit(advice).alias("recommendation"))

    endpoint = F.lower("value")
    storage = F.lower(F.concat_ws(" ", "path", "label", "context"))
    return (
        rule((F.col("label") == "local_storage") & storage.contains("pii"), "HIGH", "UNENCRYPTED_PII_STORAGE",
             "Use encryption for PII data in client-side storage")
        .unionByName(rule(F.col("mentions_password"), "CRITICAL", "HARDCODED_CREDENTIALS",
                          "Move credentials to environment variables or secure vault"))
        .unionByName(rule((F.col("label") == "api_endpoint")
                          & (endpoint.contains("user") | endpoint.contains("customer") | endpoint.contains("patient")),
                          "MEDIUM", "PII_IN_API_ENDPOINT",
                          "Ensure proper authentication and authorization for PII endpoints")))


def lineage_summary(found: DataFrame) -> DataFrame:
    def number(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, 1).otherwise(0)), F.lit(0))

    def labels(kind: str) -> Column:
        return F.array_join(F.sort_array(F.collect_set(F.when(F.col("kind") == kind, F.col("label")))), ",")

    return found.groupBy("project").agg(
        number("data_source").alias("total_data_sources"), number("transformation").alias("total_transformations"),
        number("pii_flow").alias("total_pii_flows"), labels("data_source").alias("data_source_types"),
        labels("transformation").alias("transformation_types"), labels("pii_flow").alias("pii_flow_types"))
