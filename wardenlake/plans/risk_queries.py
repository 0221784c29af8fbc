"""Confidence and risk per project over derived code and requirement files."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardenlake.operators import codemetrics as cm
from wardenlake.operators import risk
from wardenlake.plans.code_queries import _CODE, _PARSED
from wardenlake.plans.derived import CODE_FILES
from wardenlake.plans.registry import derive, plain, query

# One requirements file per project; line counts follow the parts of the brand.
REQUIREMENTS = """
SELECT p_brand AS project, 'requirements.txt' AS path, '.txt' AS ext, a, b, c,
       concat('# pinned', chr(10), repeat(concat('pkg==1.0', chr(10)), a), repeat(concat('lib>=2', chr(10)), b), repeat(concat('raw', chr(10)), c)) AS content
FROM (SELECT p_brand, cast(count(*) % 4 AS int) AS a, cast(min(p_partkey) % 3 AS int) AS b, cast(max(p_partkey) % 3 AS int) AS c
      FROM {part} GROUP BY p_brand) r
"""
_REQ = plain(REQUIREMENTS)
TYPE = "react-hooks"


def _inputs(spark, sf_dir):
    files = derive(spark, sf_dir, CODE_FILES, "part", deal=True).select("project", "path", "ext", "content").unionByName(
        derive(spark, sf_dir, REQUIREMENTS, "part").select("project", "path", "ext", "content"))
    return files, cm.structure(files)


def _occurrences(words) -> str:
    return " + ".join(f"(length(content) - length(replace(content, '{w}', ''))) // {len(w)}" for w in words)


_FACTORS = f"""
SELECT c.project, c.test_coverage, x.complexity, r.dependencies, x.code_quality, coalesce(b.breaking_changes, CAST(50 AS INT)) AS breaking_changes, CAST(50 AS INT) AS team_experience FROM
(SELECT project, CAST(CASE WHEN tests = 0 THEN 30 WHEN tests / n >= 0.5 THEN 85 WHEN tests / n >= 0.25 THEN 70 WHEN tests / n >= 0.1 THEN 55 ELSE 40 END AS INT) AS test_coverage
   FROM (SELECT project, count(*) AS n, count(*) FILTER (path LIKE 'tests/test_m%') AS tests FROM ({_CODE}) GROUP BY project)) c
JOIN (SELECT project, CAST(CASE WHEN m IS NULL THEN 50 WHEN m < 5 THEN 90 WHEN m < 10 THEN 70 WHEN m < 20 THEN 50 ELSE 30 END AS INT) AS complexity,
        CAST(greatest(30, least(90, 90 - 25 * e)) AS INT) AS code_quality
      FROM (SELECT project, avg(complexity) FILTER (broken = 0) AS m, count(*) FILTER (broken = 1) AS e FROM ({_PARSED}) GROUP BY project)) x ON x.project = c.project
JOIN (SELECT project, CAST(CASE WHEN a + b + c = 0 THEN 60 ELSE greatest(35, least(95, floor(45 + (a + b) / (a + b + c) * 35 + least(15, floor(a / (a + b + c) * 15))))) END AS INT) AS dependencies
      FROM ({_REQ})) r ON r.project = c.project
LEFT JOIN (SELECT project, CAST(CASE WHEN m < 2 THEN 90 WHEN m < 5 THEN 70 WHEN m < 10 THEN 50 ELSE 30 END AS INT) AS breaking_changes
      FROM (SELECT project, avg({_occurrences(risk.BREAKING[TYPE])}) AS m FROM ({_CODE}) WHERE js = 1 GROUP BY project)) b ON b.project = c.project"""


@query("risk_factors", _FACTORS)
def risk_factors(spark, sf_dir):
    return risk.factor_table(*_inputs(spark, sf_dir), TYPE).drop("file_count")


_SCORED = f"""
SELECT *, round(test_coverage * 0.25 + complexity * 0.20 + dependencies * 0.15 + code_quality * 0.15 + breaking_changes * 0.15 + team_experience * 0.10, 6) AS overall,
  round(1.0 + CASE WHEN complexity < 50 THEN 0.3 ELSE 0 END + CASE WHEN breaking_changes < 50 THEN 0.2 ELSE 0 END + CASE WHEN dependencies < 50 THEN 0.1 ELSE 0 END, 6) AS final
FROM ({_FACTORS})"""


@query("risk_confidence", f"""
SELECT project, CAST(floor(overall) AS INT) AS overall_score,
  CASE WHEN overall >= 80 THEN 'LOW' WHEN overall >= 60 THEN 'MEDIUM' WHEN overall >= 40 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level,
  CASE WHEN final < 0.8 THEN 'SIMPLE' WHEN final < 1.2 THEN 'MODERATE' WHEN final < 1.6 THEN 'COMPLEX' ELSE 'VERY_COMPLEX' END AS migration_complexity,
  file_count, round(CAST(file_count * 0.5::DOUBLE * (1 + (100 - overall) / 50) * 1.3::DOUBLE AS DOUBLE), 1) AS estimated_hours,
  round(round(CAST(file_count * 0.5::DOUBLE * (1 + (100 - overall) / 50) * 1.3::DOUBLE AS DOUBLE), 1) * 100, 1) AS estimated_cost
FROM ({_SCORED}) JOIN (SELECT project, count(*) FILTER (js = 1) AS file_count FROM ({_CODE}) GROUP BY project) USING (project)""")
def risk_confidence(spark, sf_dir):
    return risk.confidence(*_inputs(spark, sf_dir), TYPE)


_MESSAGES = " UNION ALL ".join(
    [f"SELECT project, '{kind}' AS kind, '{factor}' AS factor, '{text}' AS message FROM f WHERE {factor} < {upper} AND {factor} >= {lower}"
     for factor, upper, lower, kind, text in risk.THRESHOLD_RULES]
    + [f"SELECT project, 'recommendation', NULL, '{text}' FROM f" for text in risk.RECOMMENDATIONS])


@query("risk_messages", f"WITH f AS ({_FACTORS}) {_MESSAGES}")
def risk_messages(spark, sf_dir):
    return risk.messages(risk.factor_table(*_inputs(spark, sf_dir), TYPE))


@query("risk_breaking_counts", f"SELECT path, CAST({_occurrences(risk.BREAKING[TYPE])} AS INT) AS occurrences FROM ({_CODE}) WHERE js = 1")
def risk_breaking_counts(spark, sf_dir):
    return risk.breaking_counts(_inputs(spark, sf_dir)[0], TYPE).drop("project")


@query("risk_unpinned", f"SELECT project, unnest(list_transform(range(c), lambda i: 'raw')) AS line FROM ({_REQ})")
def risk_unpinned(spark, sf_dir):
    return risk.unpinned_requirements(_inputs(spark, sf_dir)[0])


@query("risk_high_risk_files", f"SELECT project, path FROM ({_CODE}) WHERE js = 1")
def risk_high_risk_files(spark, sf_dir):
    return risk.high_risk_files(_inputs(spark, sf_dir)[0], TYPE)


def _files_of(condition: str) -> str:
    return (f"SELECT project, array_to_string(list_sort(list(path ORDER BY path)[:5]), ',') AS file_paths FROM ({_CODE}) WHERE {condition} GROUP BY project")


_REGISTER = f"""
SELECT project, 'Breaking Changes Required' AS title, 'TECHNICAL' AS category, 'HIGH' AS level, 90 AS probability, 80 AS impact, file_paths FROM ({_files_of("js = 1")})
UNION ALL SELECT project, 'Hardcoded Secrets Detected', 'SECURITY', 'CRITICAL', 95, 90, file_paths
  FROM ({_files_of(f"regexp_matches(content, '(?i)(password|api_key|secret|token)\\s*=\\s*[" + '"' + "''][^" + '"' + "'']+[" + '"' + "'']')")})
UNION ALL SELECT project, 'Unsafe Code Execution', 'SECURITY', 'HIGH', 70, 85, file_paths FROM ({_files_of("js = 0 AND regexp_matches(content, 'eval|exec|compile|__import__')")})
UNION ALL SELECT project, 'Moderate Code Complexity', 'TECHNICAL', 'MEDIUM', 60, 50, '' FROM (SELECT project, avg(complexity) AS m FROM ({_PARSED}) WHERE broken = 0 GROUP BY project) WHERE m > 10 AND m <= 20
UNION ALL SELECT project, 'High Code Complexity', 'TECHNICAL', 'HIGH', 80, 70, '' FROM (SELECT project, avg(complexity) AS m FROM ({_PARSED}) WHERE broken = 0 GROUP BY project) WHERE m > 20
UNION ALL SELECT project, 'Unpinned Dependencies', 'TECHNICAL', 'MEDIUM', 60, 65, 'requirements.txt' FROM ({_REQ}) WHERE c > 0
UNION ALL SELECT project, 'Team Learning Curve', 'OPERATIONAL', 'MEDIUM', 70, 60, '' FROM ({_REQ})
UNION ALL SELECT project, 'Potential Downtime', 'BUSINESS', 'HIGH', 60, 80, '' FROM ({_REQ})
UNION ALL SELECT project, 'User Experience Impact', 'BUSINESS', 'MEDIUM', 50, 70, '' FROM ({_REQ})"""


_SECRET = "regexp_matches(content, '(?i)(password|api_key|secret|token)\\s*=\\s*[" + '"' + "''][^" + '"' + "'']+[" + '"' + "'']')"


@query("risk_register_files", f"""
SELECT project, path, 'breaking' AS rule FROM ({_CODE}) WHERE js = 1
UNION ALL SELECT project, path, 'secrets' FROM ({_CODE}) WHERE {_SECRET}
UNION ALL SELECT project, path, 'unsafe' FROM ({_CODE}) WHERE js = 0 AND regexp_matches(content, 'eval|exec|compile|__import__')""")
def risk_register_files(spark, sf_dir):
    return risk.risk_files(_inputs(spark, sf_dir)[0], TYPE)


_MITIGATIONS = ", ".join(f"('{values[0]}', '{values[5]}')" for values in risk.REGISTER.values())


@query("risk_register", f"""
SELECT *, CAST(row_number() OVER (PARTITION BY project ORDER BY probability * impact DESC, title) AS INT) AS rank
FROM ({_REGISTER}) JOIN (VALUES {_MITIGATIONS}) m(title, mitigation) USING (title)""")
def risk_register(spark, sf_dir):
    ranked = risk.ranked_risks(risk.risk_register(*_inputs(spark, sf_dir), TYPE))
    return ranked.withColumn("file_paths", F.array_join("file_paths", ","))


@query("risk_rollup", f"""
SELECT coalesce(category, 'ALL') AS category, coalesce(level, 'ALL') AS level, count(*) AS risks, round(avg(probability * impact / 100), 4) AS mean_score
FROM ({_REGISTER}) GROUP BY ROLLUP (category, level)""")
def risk_rollup(spark, sf_dir):
    return risk.risk_rollup(risk.risk_register(*_inputs(spark, sf_dir), TYPE))
