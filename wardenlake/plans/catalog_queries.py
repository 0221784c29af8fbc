"""Catalog, coverage and operation-log queries over parts, lineitems, labels and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardenlake.operators import catalog as ca
from wardenlake.operators import ledger as le
from wardenlake.plans.registry import derive, plain, query
from wardenlake.sources.tables import load

CATALOG = """
SELECT p_partkey AS pattern_id, p_name AS name, concat('pattern ', p_type) AS description,
       CASE p_size % 3 WHEN 0 THEN 'react-hooks' WHEN 1 THEN 'python3' ELSE 'vue3' END AS migration_type, p_brand AS author,
       lower(p_type) AS tag, p_size * 10 AS downloads, cast(p_size % 6 AS double) AS rating, p_partkey % 5 AS review_count FROM {part}
"""
_C = plain(CATALOG)


def _catalog(spark, sf_dir):
    return derive(spark, sf_dir, CATALOG, "part").withColumn("tags", F.array("tag", F.lit("all")))


@query("catalog_search", f"""
SELECT pattern_id, rating FROM ({_C}) WHERE rating >= 2 AND (contains(lower(name), 'bolt') OR contains(lower(description), 'bolt') OR contains(tag, 'bolt'))
  AND migration_type = 'python3' AND tag IN ('promo', 'small')""")
def catalog_search(spark, sf_dir):
    return ca.search_catalog(_catalog(spark, sf_dir), "Bolt", "python3", ["promo", "small"], 2.0).select("pattern_id", "rating")


@query("catalog_popular", f"SELECT pattern_id, CAST(downloads AS INT) AS downloads FROM ({_C}) ORDER BY downloads DESC, pattern_id LIMIT 10")
def catalog_popular(spark, sf_dir):
    return ca.popular(_catalog(spark, sf_dir)).select("pattern_id", "downloads")


@query("top_rated", f"SELECT pattern_id, rating FROM ({_C}) WHERE review_count >= 3 ORDER BY rating DESC, pattern_id LIMIT 10")
def top_rated(spark, sf_dir):
    return ca.top_rated(_catalog(spark, sf_dir)).select("pattern_id", "rating")


RATINGS = "SELECT l_partkey AS pattern_id, l_quantity / 9 AS rating FROM {lineitem}"


@query("catalog_ratings", f"""
SELECT c.pattern_id, round(CASE WHEN review_count + coalesce(n, 0) > 0 THEN (rating * review_count + coalesce(s, 0)) / (review_count + coalesce(n, 0)) ELSE rating END, 6) AS rating,
  CAST(review_count + coalesce(n, 0) AS BIGINT) AS review_count
FROM ({_C}) c LEFT JOIN (SELECT pattern_id, count(*) AS n, sum(rating) AS s FROM ({plain(RATINGS)}) WHERE rating BETWEEN 0 AND 5 GROUP BY 1) r USING (pattern_id)""")
def catalog_ratings(spark, sf_dir):
    folded = ca.fold_ratings(_catalog(spark, sf_dir), derive(spark, sf_dir, RATINGS, "lineitem"))
    return folded.select("pattern_id", F.round("rating", 6).alias("rating"), "review_count")


@query("catalog_statistics", f"""
SELECT coalesce(migration_type, 'ALL') AS migration_type, count(*) AS patterns, count(DISTINCT author) AS authors, CAST(sum(downloads) AS BIGINT) AS downloads,
  round(coalesce(avg(rating) FILTER (rating > 0), 0.0), 6) AS mean_rating FROM ({_C}) GROUP BY ROLLUP (migration_type)""")
def catalog_statistics(spark, sf_dir):
    return ca.catalog_statistics(_catalog(spark, sf_dir)).withColumn("mean_rating", F.round("mean_rating", 6))


COVERAGE = """
SELECT concat('src/', cast(l_partkey AS string), '/', cast(l_orderkey AS string), '-', cast(l_linenumber AS string), '.py') AS path, cast(l_suppkey % 10 AS int) AS module,
       l_quantity * 2 AS line_coverage, l_discount * 1000 AS branch_coverage, 100 - l_tax * 500 AS function_coverage, cast(l_quantity AS int) AS missing FROM {lineitem}
"""
_V = plain(COVERAGE)
_GRADE = "CASE WHEN l >= 90 THEN 'A' WHEN l >= 80 THEN 'B' WHEN l >= 70 THEN 'C' WHEN l >= 60 THEN 'D' ELSE 'F' END"


def _coverage(spark, sf_dir):
    return derive(spark, sf_dir, COVERAGE, "lineitem").withColumn("missing_lines", F.sequence(F.lit(1), F.col("missing")))


@query("coverage_grade", f"""
SELECT CAST(module AS INT) AS module, n AS total_files, round(l, 6) AS average_line_coverage, round(b, 6) AS average_branch_coverage, round(f, 6) AS average_function_coverage, {_GRADE} AS overall_grade
FROM (SELECT module, count(*) AS n, avg(line_coverage) AS l, avg(branch_coverage) AS b, avg(function_coverage) AS f FROM ({_V}) GROUP BY module)""")
def coverage_grade(spark, sf_dir):
    s = ca.coverage_summary(_coverage(spark, sf_dir), ["module"])
    return s.select("module", "total_files", *[F.round(c, 6).alias(c) for c in s.columns if c.startswith("average")], "overall_grade")


@query("coverage_grades_per_file", f"SELECT {_GRADE} AS grade, count(*) AS files FROM (SELECT line_coverage AS l FROM ({_V})) GROUP BY 1")
def coverage_grades_per_file(spark, sf_dir):
    return _coverage(spark, sf_dir).groupBy(ca.coverage_grade(F.col("line_coverage")).alias("grade")).agg(F.count("*").alias("files"))


@query("under_covered", f"SELECT path, line_coverage, array_to_string(range(1, missing + 1), ',') AS missing_lines FROM ({_V}) WHERE line_coverage < 80")
def under_covered(spark, sf_dir):
    return ca.under_covered(_coverage(spark, sf_dir)).select("path", "line_coverage", F.array_join(F.col("missing_lines").cast("array<string>"), ",").alias("missing_lines"))


# Templates: one per part; labels join to documents as coverage of a reviewed corpus.
TEMPLATES = """
SELECT p_partkey AS template_id, CASE p_size % 3 WHEN 0 THEN 'unit' WHEN 1 THEN 'integration' ELSE 'e2e' END AS test_type,
       CASE p_size % 2 WHEN 0 THEN 'python' ELSE 'javascript' END AS language, lower(p_type) AS tag FROM {part}
"""


def _templates(spark, sf_dir):
    return derive(spark, sf_dir, TEMPLATES, "part").withColumn("tags", F.array("tag"))


@query("template_filter", f"SELECT template_id FROM ({plain(TEMPLATES)}) WHERE test_type = 'unit' AND language = 'python' AND tag IN ('small', 'large')")
def template_filter(spark, sf_dir):
    return ca.filter_templates(_templates(spark, sf_dir), "unit", "python", ["small", "large"]).select("template_id")


@query("template_counts", f"SELECT test_type, language, count(*) AS templates FROM ({plain(TEMPLATES)}) GROUP BY ALL")
def template_counts(spark, sf_dir):
    return ca.template_counts(_templates(spark, sf_dir))


# Operations: most ids repeat, some with another revision.
OPERATIONS = """
SELECT concat('op-', cast(cast(floor(event_id / 3) AS bigint) AS string)) AS operation_id, 'apply' AS action, concat('ws-', cast(user_id % 7 AS string)) AS workspace_id, event_type AS migration_type,
       concat('rev-', cast(event_id % 2 AS string)) AS source_revision, ts AS created_at, concat('user-', cast(user_id AS string)) AS actor, concat('t', cast(event_id AS string)) AS trace_id,
       CASE WHEN event_id % 4 = 0 THEN concat('dry-', cast(event_id AS string)) END AS dry_run_id, event_id
FROM {events}
"""
_O = plain(OPERATIONS)


def _operations(spark, sf_dir):
    return derive(spark, sf_dir, OPERATIONS, "events")


@query("ops_dedup", f"""
SELECT operation_id, arg_min(event_id, created_at) AS event_id, count(*) AS attempts,
  count(DISTINCT action || '|' || workspace_id || '|' || migration_type || '|' || source_revision) > 1 AS conflict FROM ({_O}) GROUP BY operation_id""")
def ops_dedup(spark, sf_dir):
    return le.deduplicate(_operations(spark, sf_dir)).select("operation_id", "event_id", "attempts", "conflict")


@query("ops_status", f"""
SELECT 'op-' || o_orderkey AS operation_id, CASE WHEN o_orderkey <= (SELECT max(event_id) // 3 FROM events) THEN 'completed' ELSE 'not_found' END AS status FROM orders""")
def ops_status(spark, sf_dir):
    requested = load(spark, sf_dir, "orders").select(F.concat(F.lit("op-"), "o_orderkey").alias("operation_id"))
    return le.status(requested, _operations(spark, sf_dir))


# Dry runs and applies: the dry run of an apply may be absent, late or of another revision.
PREVIEWS = """
SELECT concat('dry-', cast(o_orderkey AS string)) AS operation_id, concat('ws-', cast(o_custkey % 50 AS string)) AS workspace_id,
       CASE WHEN o_orderkey % 7 = 0 THEN 'old' ELSE 'rev' END AS source_revision,
       CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate + INTERVAL '2' DAY ELSE o_orderdate END AS created_at FROM {orders} WHERE o_orderkey % 5 <> 0
"""
APPLIES = """
SELECT concat('app-', cast(o_orderkey AS string)) AS operation_id, concat('dry-', cast(o_orderkey AS string)) AS dry_run_id, concat('ws-', cast(o_custkey % 50 AS string)) AS workspace_id,
       'rev' AS source_revision, o_orderdate + INTERVAL '1' DAY AS created_at FROM {orders}
"""


@query("approval_violations", """
SELECT 'app-' || o_orderkey AS operation_id, 'dry-' || o_orderkey AS dry_run_id,
  CASE WHEN o_orderkey % 5 = 0 THEN 'missing_dry_run' WHEN o_orderkey % 7 = 0 THEN 'revision_changed' ELSE 'dry_run_too_late' END AS reason
FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 11 = 0""")
def approval_violations(spark, sf_dir):
    return le.approval_violations(derive(spark, sf_dir, APPLIES, "orders"), derive(spark, sf_dir, PREVIEWS, "orders"))


@query("workspace_usage", """
SELECT source AS workspace_id, count(*) AS file_count, CAST(sum(strlen(text)) AS BIGINT) AS size_bytes, count(*) > 60 OR sum(strlen(text)) > 100000 AS over_quota FROM documents GROUP BY source""")
def workspace_usage(spark, sf_dir):
    files = load(spark, sf_dir, "documents").select(F.col("source").alias("workspace_id"), F.octet_length("text").cast("bigint").alias("size_bytes"))
    return le.workspace_usage(files, 60, 100000)


@query("expired_workspaces", "SELECT o_orderkey AS workspace_id FROM orders WHERE o_orderdate + INTERVAL 30 DAY <= TIMESTAMP '1998-06-01 00:00:00'")
def expired_workspaces(spark, sf_dir):
    ws = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("workspace_id"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("expires_at"))
    return le.expired_workspaces(ws, F.lit("1998-06-01 00:00:00").cast("timestamp_ntz")).select("workspace_id")


@query("result_redaction", """
SELECT event_id, '{"a":"<workspace>/x","b":["<workspace>/' || user_id || '"]}' AS result FROM events""")
def result_redaction(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    body = F.concat(F.lit('{"a":"/srv/ws/1/x","b":["/srv/ws/1/'), "user_id", F.lit('"]}'))
    return events.select("event_id", le.redact_prefix(body, "/srv/ws/1", "<workspace>").alias("result"))


@query("fleet_audit_events", f"SELECT operation_id, action, actor, trace_id, false AS dry_run, dry_run_id IS NOT NULL AS approved FROM ({_O})")
def fleet_audit_events(spark, sf_dir):
    return le.audit_event(_operations(spark, sf_dir)).select("operation_id", "action", "actor", "trace_id", "dry_run", "approved")
