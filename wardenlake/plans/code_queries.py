"""Code metrics, rewriting and advice over derived code."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardenlake.operators import codemetrics as cm
from wardenlake.operators import rewrite as rw
from wardenlake.plans.derived import CODE_FILES
from wardenlake.plans.registry import derive, plain, query

_CODE = plain(CODE_FILES)
# What parsing must find, in closed form from the way the text is built.
_PARSED = f"""
SELECT project, path, k, n, dep, broken, content, CASE WHEN broken = 1 THEN 0 ELSE 1 + 2 * (n % 7) END AS complexity,
  CASE WHEN broken = 1 THEN 0 ELSE (n % 7) + (n % 7) * ((n % 7) - 1) // 2 + (n % 7) + (n % 7) * (n % 7) END AS cognitive,
  length(content) - length(replace(content, chr(10), '')) + 1 AS lines, strlen(content) AS bytes
FROM (SELECT *, cast(floor(k / 2) AS bigint) AS dep FROM ({_CODE}) WHERE js = 0)"""


def _files(spark, sf_dir):
    return derive(spark, sf_dir, CODE_FILES, "part", deal=True).select("project", "path", "ext", "content")


def _structures(spark, sf_dir):
    return cm.structure(_files(spark, sf_dir))


@query("code_structure", f"""
SELECT path, broken = 0 AS parsed, CAST(lines AS INT) AS line_count, CAST(bytes AS BIGINT) AS size_bytes, CAST(complexity AS INT) AS complexity,
  CAST(cognitive AS INT) AS cognitive, CASE WHEN broken = 0 THEN 'Module ' || k || '.' END AS docstring,
  CASE WHEN broken = 0 THEN 'f' || k || '(a,user)' END AS signature, CASE WHEN broken = 0 THEN 'K' || k END AS class_name
FROM ({_PARSED})""")
def code_structure(spark, sf_dir):
    f = F.get("functions", 0)
    return _structures(spark, sf_dir).select(
        "path", "parsed", "line_count", "size_bytes", "complexity", "cognitive", "docstring",
        F.when(f.isNotNull(), F.concat(f["name"], F.lit("("), F.array_join(f["args"], ","), F.lit(")"))).alias("signature"),
        F.get("classes", 0)["name"].alias("class_name"))


@query("code_corpus_aggregate", f"""
SELECT project, files_analyzed, errors, total_lines, total_size, total_complexity, files_analyzed AS total_functions,
  files_analyzed AS total_classes, 2 * files_analyzed AS total_imports,
  round(total_complexity / files_analyzed, 6) AS avg_complexity_per_file, round(total_lines / files_analyzed, 6) AS avg_lines_per_file,
  round(least(100.0, greatest(0.0, 171 - 5.2 * pow(total_lines, 0.23) - 0.23 * total_complexity - 16.2 * sqrt(files_analyzed))), 6) AS maintainability_index,
  round(CASE WHEN total_complexity > 1000 THEN (total_complexity - 1000) * 0.1 WHEN total_complexity > 500 THEN (total_complexity - 500) * 0.05 ELSE 0.0 END
    + CASE WHEN total_lines > 50000 THEN (total_lines - 50000) / 1000 * 2 ELSE 0.0 END
    + CASE WHEN files_analyzed > 100 THEN (files_analyzed - 100) * 0.5 ELSE 0.0 END, 1)::DOUBLE AS technical_debt_hours
FROM (SELECT project, count(*) FILTER (broken = 0) AS files_analyzed, count(*) FILTER (broken = 1) AS errors,
  CAST(sum(lines) FILTER (broken = 0) AS BIGINT) AS total_lines, CAST(sum(bytes) FILTER (broken = 0) AS BIGINT) AS total_size,
  CAST(sum(complexity) AS BIGINT) AS total_complexity FROM ({_PARSED}) GROUP BY project)""")
def code_corpus_aggregate(spark, sf_dir):
    agg = cm.corpus_aggregate(_structures(spark, sf_dir), ["project"])
    rounded = ["avg_complexity_per_file", "avg_lines_per_file", "maintainability_index"]
    return agg.select("project", "files_analyzed", "errors", "total_lines", "total_size", "total_complexity", "total_functions", "total_classes",
                      "total_imports", *[F.round(c, 6).alias(c) for c in rounded], "technical_debt_hours")


@query("code_file_metrics", f"""
SELECT path, CAST(lines AS INT) AS line_count, CAST(1 AS INT) AS functions_count, CAST(1 AS INT) AS classes_count, CAST(complexity AS INT) AS cyclomatic,
  CAST(cognitive AS INT) AS cognitive, CASE WHEN complexity <= 10 THEN 'LOW' WHEN complexity <= 20 THEN 'MEDIUM' ELSE 'HIGH' END AS level,
  round(171 - 5.2 * pow(lines, 0.23) - 0.23 * complexity - 16.2, 6) AS index_raw,
  round(least(100.0, greatest(0.0, 171 - 5.2 * pow(lines, 0.23) - 0.23 * complexity - 16.2)), 6) AS maintainability_index
FROM ({_PARSED}) WHERE broken = 0""")
def code_file_metrics(spark, sf_dir):
    m = cm.file_metrics(_structures(spark, sf_dir))
    return m.drop("project").withColumns({c: F.round(c, 6) for c in ("index_raw", "maintainability_index")})


@query("code_dependencies", f"SELECT path, 'm' || dep || ',os' AS modules FROM ({_PARSED}) WHERE broken = 0")
def code_dependencies(spark, sf_dir):
    return cm.dependency_list(_structures(spark, sf_dir)).select("path", F.array_join("modules", ",").alias("modules"))


@query("code_complexity_distribution", f"""
SELECT project, count(*) FILTER (complexity <= 5) AS simple, count(*) FILTER (complexity > 5 AND complexity <= 10) AS moderate,
  count(*) FILTER (complexity > 10 AND complexity <= 20) AS complex, count(*) FILTER (complexity > 20) AS very_complex
FROM ({_PARSED}) WHERE broken = 0 GROUP BY project""")
def code_complexity_distribution(spark, sf_dir):
    return cm.complexity_distribution(_structures(spark, sf_dir))


@query("code_most_complex", f"SELECT path, CAST(complexity AS INT) AS complexity FROM ({_PARSED}) WHERE broken = 0 ORDER BY complexity DESC, path LIMIT 5")
def code_most_complex(spark, sf_dir):
    return cm.most_complex(_structures(spark, sf_dir)).select("path", "complexity")


@query("code_dependents", f"""
SELECT 'm' || dep AS module, count(*) AS dependents FROM ({_PARSED}) WHERE broken = 0 GROUP BY 1
UNION ALL SELECT 'os', count(*) FROM ({_PARSED}) WHERE broken = 0""")
def code_dependents(spark, sf_dir):
    return (cm.imports_of(_structures(spark, sf_dir)).select("module", "path").distinct()
            .groupBy("module").agg(F.count("*").alias("dependents")))


@query("script_structure", f"""
SELECT path, CAST(length(content) - length(replace(content, chr(10), '')) AS INT) AS line_count, 'C' || k AS components,
  array_to_string(regexp_extract_all(content, '(?:export\\s+)?(?:const|let|var)\\s+(\\w+)\\s*=\\s*(?:\\([^)]*\\)\\s*=>|function)', 1), ',') AS functions
FROM ({_CODE}) WHERE js = 1""")
def script_structure(spark, sf_dir):
    return cm.script_structure(_files(spark, sf_dir)).select(
        "path", "line_count", F.array_join("components", ",").alias("components"), F.array_join("functions", ",").alias("functions"))


@query("code_issue_rules", f"""
SELECT path, 'class_component' AS type, 'INFO' AS severity, '' AS detail FROM ({_CODE}) WHERE js = 1
UNION ALL SELECT path, 'lifecycle_method', 'INFO', 'componentDidMount' FROM ({_CODE}) WHERE js = 1
UNION ALL SELECT path, 'set_state', 'INFO', '' FROM ({_CODE}) WHERE js = 1
UNION ALL SELECT path, 'integer_division', 'WARNING', '' FROM ({_CODE}) WHERE js = 0 AND regexp_matches(content, '/\\s*\\d+')""")
def code_issue_rules(spark, sf_dir):
    return cm.issue_rules(_files(spark, sf_dir)).drop("project")


@query("code_advice", f"""
SELECT path, 'breaking_change' AS kind, 'syntax_error' AS step, CAST(1 AS INT) AS times FROM ({_PARSED}) WHERE broken = 1
UNION ALL SELECT path, 'step', 'use_f_string', CAST(1 AS INT) FROM ({_PARSED}) WHERE broken = 0 AND n % 9 = 2
UNION ALL SELECT path, 'step', 'replace_xrange', CAST(1 AS INT) FROM ({_PARSED}) WHERE broken = 0 AND n % 9 = 2
UNION ALL SELECT path, 'step', 'class_to_function', CAST(1 AS INT) FROM ({_CODE}) WHERE js = 1
UNION ALL SELECT path, 'breaking_change', 'state', CAST(1 AS INT) FROM ({_CODE}) WHERE js = 1 AND contains(content, 'this.state')
UNION ALL SELECT path, 'breaking_change', 'lifecycle', CAST(1 AS INT) FROM ({_CODE}) WHERE js = 1""")
def code_advice(spark, sf_dir):
    files = _files(spark, sf_dir)
    return cm.advice_steps(files, cm.structure(files)).drop("project")


_REWRITTEN = """'import React, { useState, useEffect } from ''react'';' || chr(10) || chr(10) || 'const C' || k || ' = (props) => {' || chr(10) ||
  CASE WHEN contains(content, 'this.state') THEN chr(10) || '  // TODO: Migrate state manually or use advanced ast-migrator' || chr(10) ||
    '  // const [state, setState] = useState(initialState);' ELSE '' END || chr(10) || chr(10) ||
  '  if (x) { this.setState({a: 1}); }' || chr(10) || '    return <p>{props.name}</p>;' || chr(10) || '};' || chr(10) || chr(10) || 'export default C' || k || ';' || chr(10)"""


@query("rewrite_components", f"SELECT path, {_REWRITTEN} AS new_content, true AS changed FROM ({_CODE}) WHERE js = 1")
def rewrite_components(spark, sf_dir):
    return rw.rewrite(_files(spark, sf_dir), "react-hooks").select("path", "new_content", "changed")


@query("rewrite_summary", f"""
SELECT project, count(*) AS total_candidates, count(*) AS changed_files, CAST(0 AS BIGINT) AS failed_files FROM ({_CODE}) WHERE js = 1 GROUP BY project""")
def rewrite_summary(spark, sf_dir):
    return rw.change_summary(rw.rewrite(_files(spark, sf_dir), "react-hooks"))


@query("rewrite_no_op", f"SELECT project, path FROM ({_CODE}) WHERE false")
def rewrite_no_op(spark, sf_dir):
    return rw.remaining_after_apply(_files(spark, sf_dir), "react-hooks")


@query("rewrite_next_version", f"""
SELECT path, CAST(length(CASE WHEN js = 1 THEN {_REWRITTEN} ELSE content END) AS INT) AS chars FROM ({_CODE})""")
def rewrite_next_version(spark, sf_dir):
    files = _files(spark, sf_dir)
    return rw.apply_rewrite(files, rw.rewrite(files, "react-hooks")).select("path", F.length("content").alias("chars"))


@query("rewrite_candidates", f"SELECT project, count(*) AS candidates FROM ({_CODE}) WHERE ext IN ('.jsx', '.tsx', '.js', '.ts') GROUP BY project")
def rewrite_candidates(spark, sf_dir):
    return rw.candidates(_files(spark, sf_dir), "react-hooks").groupBy("project").agg(F.count("*").alias("candidates"))


@query("rewrite_diffs")
def rewrite_diffs(spark, sf_dir):
    return rw.rewrite(_files(spark, sf_dir), "react-hooks").select("path", F.length("diff").alias("diff_chars"), "error")


@query("test_symbols", f"""
SELECT project, 'unit' AS test_type, count(*) AS tests, count(DISTINCT path) AS files FROM (
  SELECT project, path FROM ({_PARSED}) WHERE broken = 0 UNION ALL SELECT project, path FROM ({_PARSED}) WHERE broken = 0) GROUP BY project
UNION ALL SELECT project, 'component', count(*), count(*) FROM ({_CODE}) WHERE js = 1 GROUP BY project""")
def test_symbols(spark, sf_dir):
    from wardenlake.operators.catalog import symbol_inventory, symbol_statistics

    files = _files(spark, sf_dir)
    return symbol_statistics(symbol_inventory(cm.structure(files), cm.script_structure(files)))
