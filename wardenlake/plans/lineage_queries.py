"""Data-flow mentions over derived code."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardenlake.operators import lineage as ln
from wardenlake.plans.derived import CODE_FILES
from wardenlake.plans.registry import derive, plain, query
from wardenlake.sources.tables import load

_CODE = plain(CODE_FILES)


def _arm(condition: str, kind: str, label: str, pattern: str, group: int = 0) -> str:
    quoted = pattern.replace("(?iu)", "(?i)").replace("'", "''")
    return (f"SELECT project, path, '{kind}' AS kind, '{label}' AS label, "
            f"unnest(regexp_extract_all(content, '{quoted}', {group})) AS value FROM ({_CODE}) WHERE {condition}")


_ARMS = [_arm("ext = '.py'", "data_source", "database", p, 1) for p in ln.DATABASE_CALLS]
_ARMS += [_arm("ext = '.py'", "transformation", t, p) for p, t in ln.PYTHON_OPERATIONS]
_ARMS += [_arm("ext = '.py'", "pii_flow", t, p) for p, t in ln.FLOW_WORDS]
_ARMS += [_arm("ext = '.jsx'", "data_source", "api_endpoint", p, g) for p, g in ln.ENDPOINT_CALLS]
_ARMS += [_arm("ext = '.jsx'", "transformation", t, p) for p, t in ln.SCRIPT_OPERATIONS]
MENTIONS = "\nUNION ALL\n".join(_ARMS)


def _mentions(spark, sf_dir):
    return ln.mentions(derive(spark, sf_dir, CODE_FILES, "part", deal=True).select("project", "path", "ext", "content"))


@query("lineage_mentions", f"SELECT project, path, kind, label, count(*) AS n FROM ({MENTIONS}) GROUP BY ALL")
def lineage_mentions(spark, sf_dir):
    return _mentions(spark, sf_dir).groupBy("project", "path", "kind", "label").agg(F.count("*").alias("n"))


@query("lineage_sources", f"""
SELECT project, path, label, CASE WHEN label = 'database' THEN regexp_replace(regexp_replace(value, '(?i)password=[^;]+', 'password=***', 'g'),
  '//[^:]+:[^@]+@', '//***:***@', 'g') ELSE value END AS value FROM ({MENTIONS}) WHERE kind = 'data_source'""")
def lineage_sources(spark, sf_dir):
    return ln.data_sources(_mentions(spark, sf_dir)).drop("line")


@query("lineage_line_context", f"""
SELECT path, label, CAST(nr AS INT) AS line,
  trim(array_to_string(lines[greatest(nr - 1, 1):nr + 1], chr(10)), chr(10) || ' ') AS context
FROM (SELECT path, 'sql_execute' AS label, unnest(list_filter(range(1, len(lines) + 1), lambda i: contains(lines[i], 'cur.execute('))) AS nr, lines
      FROM (SELECT path, string_split(content, chr(10)) AS lines FROM ({_CODE}) WHERE ext = '.py'))""")
def lineage_line_context(spark, sf_dir):
    return ln.transformations(_mentions(spark, sf_dir)).filter("label = 'sql_execute'").select("path", "label", "line", "context")


@query("lineage_edge_counts", f"""
SELECT project, path, count(*) - 1 AS edges FROM ({MENTIONS}) GROUP BY project, path HAVING count(*) > 1""")
def lineage_edge_counts(spark, sf_dir):
    return ln.lineage_edges(_mentions(spark, sf_dir)).groupBy("project", "path").agg(F.count("*").alias("edges"))


@query("lineage_nodes", f"SELECT project, kind AS type, label, count(*) AS nodes FROM ({MENTIONS}) GROUP BY ALL")
def lineage_nodes(spark, sf_dir):
    return ln.lineage_nodes(_mentions(spark, sf_dir)).groupBy("project", "type", "label").agg(F.count("node_id").alias("nodes"))


@query("lineage_issues", f"""
SELECT i.project, i.path, CAST(len(string_split(left(content, strpos(content, value)), chr(10))) AS INT) AS line, severity, type, recommendation FROM (
  SELECT project, path, value, 'CRITICAL' AS severity, 'HARDCODED_CREDENTIALS' AS type, 'Move credentials to environment variables or secure vault' AS recommendation
  FROM ({MENTIONS}) WHERE label = 'database' AND contains(lower(value), 'password')
  UNION ALL SELECT project, path, value, 'MEDIUM', 'PII_IN_API_ENDPOINT', 'Ensure proper authentication and authorization for PII endpoints'
  FROM ({MENTIONS}) WHERE label = 'api_endpoint' AND contains(value, 'user')
  UNION ALL SELECT project, path, 'localStorage.setItem("pii"', 'HIGH', 'UNENCRYPTED_PII_STORAGE', 'Use encryption for PII data in client-side storage'
  FROM ({_CODE}) WHERE contains(content, 'localStorage.setItem("pii"')) i JOIN ({_CODE}) c USING (project, path)""")
def lineage_issues(spark, sf_dir):
    return ln.issues(_mentions(spark, sf_dir))


@query("lineage_summary", f"""
SELECT project, CAST(count(*) FILTER (kind = 'data_source') AS BIGINT) AS total_data_sources,
  count(*) FILTER (kind = 'transformation') AS total_transformations, count(*) FILTER (kind = 'pii_flow') AS total_pii_flows,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (kind = 'data_source'), '') AS data_source_types,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (kind = 'transformation'), '') AS transformation_types,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (kind = 'pii_flow'), '') AS pii_flow_types
FROM ({MENTIONS}) GROUP BY project""")
def lineage_summary(spark, sf_dir):
    return ln.lineage_summary(_mentions(spark, sf_dir))


@query("lineage_config_keys", """
WITH c AS (SELECT o_orderkey, 'a=1' || chr(10) || repeat(chr(10), CAST(o_orderkey % 3 AS INT)) || 'DB_HOST=h' || chr(10) ||
  CASE WHEN o_orderkey % 2 = 0 THEN 'API_KEY=' || o_custkey ELSE '' END AS content FROM orders)
SELECT 'conf/' || o_orderkey || '.env' AS path, 'DB_HOST' AS value, CAST(2 + o_orderkey % 3 AS INT) AS line FROM c
UNION ALL SELECT 'conf/' || o_orderkey || '.env', 'API_KEY', CAST(3 + o_orderkey % 3 AS INT) FROM c WHERE contains(content, 'API_KEY')""")
def lineage_config_keys(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    files = orders.select(
        F.lit("p").alias("project"), F.concat(F.lit("conf/"), "o_orderkey", F.lit(".env")).alias("path"), F.lit(".env").alias("ext"),
        F.concat(F.lit("a=1\n"), F.repeat(F.lit("\n"), (F.col("o_orderkey") % 3).cast("int")), F.lit("DB_HOST=h\n"),
                 F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("API_KEY="), "o_custkey")).otherwise("")).alias("content"))
    return ln.data_sources(ln.mentions(files)).select("path", "value", "line")
