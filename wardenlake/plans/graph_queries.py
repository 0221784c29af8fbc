"""Graph, waves and schedule over links, code imports and derived plans."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from wardenlake.operators import codemetrics as cm
from wardenlake.operators import graph as gr
from wardenlake.plans.code_queries import _CODE, _PARSED
from wardenlake.plans.derived import CODE_FILES
from wardenlake.plans.registry import derive, plain, query
from wardenlake.sources.tables import load, spread

_HREF = "'href=\"([^\"#?]+)'"
_HOST = "regexp_extract(url, '^https?://([^/:?#]+)', 1)"
_LINKS = f"SELECT DISTINCT lang AS project, url AS src, dst FROM (SELECT regexp_extract(html, '<html lang=\"(\\w+)\"', 1) AS lang, url, unnest(regexp_extract_all(html, {_HREF}, 1)) AS dst FROM pages)"


def _links(spark, sf_dir):
    pages = spread(load(spark, sf_dir, "pages"))
    return pages.select(F.regexp_extract("html", r'<html lang="(\w+)"', 1).alias("project"), F.col("url").alias("src"),
                        F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"#?]+)'), F.lit(1))).alias("dst")).distinct()


def _link_nodes(spark, sf_dir):
    pages = load(spark, sf_dir, "pages").select(F.regexp_extract("html", r'<html lang="(\w+)"', 1).alias("project"), F.col("url").alias("path")).distinct()
    return gr.graph_nodes(pages, _links(spark, sf_dir))


@query("graph_stats", f"""
WITH e AS ({_LINKS}), f AS (SELECT DISTINCT regexp_extract(html, '<html lang="(\\w+)"', 1) AS project, url AS id FROM pages),
n AS (SELECT project, id FROM f UNION SELECT project, dst FROM e)
SELECT n.project, total_nodes, file_nodes, total_edges, total_nodes - file_nodes AS external_nodes, round(2 * total_edges / total_nodes, 6) AS average_degree,
  round(total_edges / (total_nodes * (total_nodes - 1)), 8) AS density
FROM (SELECT project, count(*) AS total_nodes FROM n GROUP BY 1) n JOIN (SELECT project, count(*) AS file_nodes FROM f GROUP BY 1) f USING (project)
JOIN (SELECT project, count(*) AS total_edges FROM e GROUP BY 1) e USING (project)""")
def graph_stats(spark, sf_dir):
    s = gr.graph_statistics(_link_nodes(spark, sf_dir), _links(spark, sf_dir))
    return s.withColumn("average_degree", F.round("average_degree", 6)).withColumn("density", F.round("density", 8))


@query("graph_degree", f"""
SELECT project, id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (
  SELECT project, src AS id, 1 AS o, 0 AS i FROM ({_LINKS}) UNION ALL SELECT project, dst, 0, 1 FROM ({_LINKS})) GROUP BY project, id""")
def graph_degree(spark, sf_dir):
    return gr.degrees(_links(spark, sf_dir))


def _code(spark, sf_dir):
    files = derive(spark, sf_dir, CODE_FILES, "part", deal=True).select("project", "path", "ext", "content")
    return files, cm.structure(files)


_EDGES = f"""
SELECT project, path AS src, unnest(['m' || dep, 'os']) AS dst FROM ({_PARSED}) WHERE broken = 0
UNION ALL SELECT project, path, unnest(['react', 'lib' || CAST(floor(k / 2) AS BIGINT)]) FROM ({_CODE}) WHERE js = 1"""


@query("graph_import_edges", _EDGES)
def graph_import_edges(spark, sf_dir):
    return gr.import_edges(*_code(spark, sf_dir))


@query("graph_resolved_edges", f"""
SELECT e.src, coalesce(f.path, e.dst) AS dst, f.path IS NOT NULL AS internal, false AS ambiguous FROM ({_EDGES}) e
LEFT JOIN (SELECT path, regexp_extract(path, '([^/]+)\\.[^.]*$', 1) AS module FROM ({_CODE})) f ON f.module = e.dst""")
def graph_resolved_edges(spark, sf_dir):
    files, structures = _code(spark, sf_dir)
    return gr.resolve_modules(gr.import_edges(files, structures), files, across_projects=True).drop("project")


@query("graph_nodes", f"""
SELECT project, path AS id, 'file' AS type, CAST(lines AS INT) AS size, CAST(complexity AS INT) AS complexity FROM ({_PARSED})
UNION ALL SELECT project, path, 'file', NULL, NULL FROM ({_CODE}) WHERE js = 1
UNION ALL SELECT DISTINCT project, dst, 'external', NULL::INT, NULL::INT FROM ({_EDGES})""")
def graph_nodes(spark, sf_dir):
    files, structures = _code(spark, sf_dir)
    return gr.graph_nodes(files, gr.import_edges(files, structures), structures).select("project", "id", "type", "size", "complexity")


@query("graph_dependents", f"""
SELECT e.src AS path, f.path AS changed_path FROM ({_EDGES}) e JOIN (SELECT project, path, regexp_extract(path, '([^/]+)\\.[^.]*$', 1) AS module FROM ({_CODE})) f
  ON f.module = e.dst AND f.project = e.project""")
def graph_dependents(spark, sf_dir):
    files, structures = _code(spark, sf_dir)
    return gr.dependents(gr.import_edges(files, structures), files).drop("project")


# Two dependency graphs: a part needs the parts at half and a third of its number; a
# supplier needs the one at half its number, and some of those pairs need each other.
DEPENDENCIES = """
SELECT DISTINCT project, src, dst FROM (
  SELECT 'parts' AS project, cast(p_partkey AS string) AS src, cast(cast(floor(p_partkey / 2) AS bigint) AS string) AS dst FROM {part} WHERE p_partkey > 0
  UNION ALL SELECT 'parts', cast(p_partkey AS string), cast(cast(floor(p_partkey / 3) AS bigint) AS string) FROM {part} WHERE p_partkey > 0
  UNION ALL SELECT 'suppliers', cast(s_suppkey AS string), cast(cast(floor(s_suppkey / 2) AS bigint) AS string) FROM {supplier} WHERE s_suppkey > 0
  UNION ALL SELECT 'suppliers', cast(cast(floor(s_suppkey / 2) AS bigint) AS string), cast(s_suppkey AS string) FROM {supplier} WHERE s_nationkey = 3 AND s_suppkey > 0
) d
"""
NODES = """
SELECT 'parts' AS project, cast(p_partkey AS string) AS id FROM {part} UNION ALL SELECT 'suppliers', cast(s_suppkey AS string) FROM {supplier}
"""
_D = plain(DEPENDENCIES)
_WAVES = f"""
WITH RECURSIVE e AS (SELECT * FROM ({_D})), n AS (SELECT * FROM ({plain(NODES)})),
reach AS (SELECT src, dst FROM e WHERE project = 'suppliers' UNION SELECT r.src, e.dst FROM reach r JOIN e ON e.project = 'suppliers' AND e.src = r.dst),
looped AS (SELECT DISTINCT src AS id FROM reach WHERE src = dst),
bad AS (SELECT id FROM looped UNION SELECT r.src FROM reach r JOIN looped l ON l.id = r.dst),
good AS (SELECT * FROM n WHERE NOT (project = 'suppliers' AND id IN (SELECT id FROM bad))),
depth AS (SELECT project, id, 0 AS d FROM good g WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.project = g.project AND e.src = g.id)
  UNION SELECT e.project, e.src, depth.d + 1 FROM depth JOIN e ON e.project = depth.project AND e.dst = depth.id JOIN good g ON g.project = e.project AND g.id = e.src),
lv AS (SELECT project, id, max(d) AS wave FROM depth GROUP BY ALL)"""


def _waves(spark, sf_dir):
    return gr.waves(derive(spark, sf_dir, NODES, "part", "supplier"), derive(spark, sf_dir, DEPENDENCIES, "part", "supplier"))


@query("waves", _WAVES + """
SELECT project, id, CAST(wave AS INT) AS wave, false AS cyclic FROM lv
UNION ALL SELECT 'suppliers', id, CAST(row_number() OVER (ORDER BY md5(id)) + coalesce((SELECT max(wave) FROM lv WHERE project = 'suppliers'), -1) AS INT), true FROM bad""")
def waves(spark, sf_dir):
    return _waves(spark, sf_dir)


@query("dependency_cycles", _WAVES + """,
both_ways AS (SELECT r.src AS id, min(r.dst) AS cycle FROM reach r JOIN reach b ON b.src = r.dst AND b.dst = r.src GROUP BY r.src)
SELECT 'suppliers' AS project, id, cycle FROM bad LEFT JOIN both_ways USING (id)""")
def dependency_cycles(spark, sf_dir):
    return gr.cycle_members(derive(spark, sf_dir, NODES, "part", "supplier"), derive(spark, sf_dir, DEPENDENCIES, "part", "supplier"))


@query("plan_estimate", _WAVES + """,
s AS (SELECT n.project, n.c AS nodes, m.c AS edges, n.project = 'suppliers' AND (SELECT count(*) FROM bad) > 0 AS cyc FROM (SELECT project, count(*) AS c FROM n GROUP BY 1) n
  JOIN (SELECT project, count(*) AS c FROM e GROUP BY 1) m USING (project))
SELECT project, CAST(nodes * 0.5 * CASE WHEN cyc THEN 1.5 ELSE 1 END AS DOUBLE) AS estimated_duration,
  CASE WHEN cyc OR edges / (nodes * (nodes - 1)) > 0.3 THEN 'HIGH' WHEN 2 * edges / nodes > 5 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM s""")
def plan_estimate(spark, sf_dir):
    nodes = derive(spark, sf_dir, NODES, "part", "supplier").withColumn("type", F.lit("file"))
    edges = derive(spark, sf_dir, DEPENDENCIES, "part", "supplier")
    return gr.plan_estimate(gr.graph_statistics(nodes, edges, _waves(spark, sf_dir)))


# A plan with faults: parts in the wave of their size, some twice, some unknown, some waves unused.
PLAN = """
SELECT 'parts' AS project, path, wave FROM (
  SELECT cast(p_partkey AS string) AS path, cast(p_size % 40 + CASE WHEN p_size % 40 > 20 THEN 3 ELSE 0 END AS int) AS wave FROM {part}
  UNION ALL SELECT cast(p_partkey AS string), cast(60 AS int) FROM {part} WHERE p_size = 7
  UNION ALL SELECT concat('ghost', cast(p_partkey AS string)), cast(1 AS int) FROM {part} WHERE p_size = 9) x
"""
_PLAN = plain(PLAN)
_VIOLATIONS = f"""
SELECT project, 'error' AS kind, 'duplicate_file' AS rule, path AS subject FROM ({_PLAN}) GROUP BY project, path HAVING count(*) > 1
UNION ALL SELECT DISTINCT project, 'warning', 'missing_file', path FROM ({_PLAN}) WHERE path NOT IN (SELECT CAST(p_partkey AS VARCHAR) FROM part)
UNION ALL SELECT 'parts', 'warning', 'empty_wave', CAST(w AS VARCHAR) FROM range(0, 61) t(w) WHERE w BETWEEN (SELECT min(wave) FROM ({_PLAN})) AND (SELECT max(wave) FROM ({_PLAN}))
  AND w NOT IN (SELECT wave FROM ({_PLAN}))
UNION ALL SELECT 'parts', 'warning', 'late_dependency', e.src || ' -> ' || e.dst FROM ({_D}) e JOIN ({_PLAN}) a ON a.path = e.src JOIN ({_PLAN}) b ON b.path = e.dst
  WHERE e.project = 'parts' AND a.wave < b.wave"""


def _violations(spark, sf_dir):
    files = load(spark, sf_dir, "part").select(F.lit("parts").alias("project"), F.col("p_partkey").cast("string").alias("path"))
    return gr.plan_violations(derive(spark, sf_dir, PLAN, "part"), files, derive(spark, sf_dir, DEPENDENCIES, "part", "supplier"))


@query("plan_violations", _VIOLATIONS)
def plan_violations(spark, sf_dir):
    return _violations(spark, sf_dir)


@query("plan_verdict", f"""
SELECT 'parts' AS project, (SELECT count(*) FROM ({_PLAN})) AS total_files, (SELECT count(DISTINCT wave) FROM ({_PLAN})) AS total_waves,
  count(*) FILTER (kind = 'error') AS errors, count(*) FILTER (kind = 'warning') AS warnings, count(*) FILTER (kind = 'error') = 0 AS valid FROM ({_VIOLATIONS})""")
def plan_verdict(spark, sf_dir):
    return gr.plan_verdict(_violations(spark, sf_dir), derive(spark, sf_dir, PLAN, "part"))


@query("plan_overrides", f"""
WITH p AS (SELECT 'parts' AS project, CAST(p_partkey AS VARCHAR) AS path, CAST(p_size % 10 AS INT) AS wave, p_size FROM part)
SELECT project, path, CASE WHEN p_size = 5 THEN CAST(99 AS INT) ELSE wave END AS wave FROM p WHERE p_size <> 6
UNION ALL SELECT 'parts', 'new' || p_partkey, CAST(0 AS INT) FROM part WHERE p_size = 8""")
def plan_overrides(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    name = F.col("p_partkey").cast("string")
    project = F.lit("parts").alias("project")
    plan = part.select(project, name.alias("path"), (F.col("p_size") % 10).cast("int").alias("wave"))
    changes = part.filter("p_size = 5").select(project, name.alias("path"), F.lit(99).alias("wave")).unionByName(
        part.filter("p_size = 8").select(project, F.concat(F.lit("new"), name).alias("path"), F.lit(0).alias("wave")))
    return gr.apply_overrides(plan, changes, part.filter("p_size = 6").select(project, name.alias("path")))


@query("plan_reordered", """
SELECT CAST(CASE p_size % 10 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE p_size % 10 END AS INT) AS wave, count(*) AS files FROM part GROUP BY 1""")
def plan_reordered(spark, sf_dir):
    plan = load(spark, sf_dir, "part").select(F.lit("parts").alias("project"), F.col("p_partkey").cast("string").alias("path"), (F.col("p_size") % 10).cast("int").alias("wave"))
    order = plan.filter("wave IN (1, 2)").select("project", "wave", (3 - F.col("wave")).alias("new_wave")).distinct()
    return gr.reorder_waves(plan, order).groupBy("wave").agg(F.count("*").alias("files"))


@query("wave_details", f"""
SELECT project, CAST(n % 10 AS INT) AS wave, count(*) AS file_count, CAST(sum(lines) AS BIGINT) AS total_lines, round(sum(lines) / 1000, 6) AS estimated_hours,
  round(sum(lines) / count(*), 6) AS average_lines_per_file FROM (
  SELECT project, n, lines FROM ({_PARSED}) UNION ALL SELECT project, n, length(content) - length(replace(content, chr(10), '')) FROM ({_CODE}) WHERE js = 1) GROUP BY ALL""")
def wave_details(spark, sf_dir):
    code = derive(spark, sf_dir, CODE_FILES, "part", deal=True)
    plan = code.select("project", "path", (F.col("n") % 10).cast("int").alias("wave"))
    files = cm.structure(code).select("project", "path", "line_count").unionByName(cm.script_structure(code).select("project", "path", "line_count"))
    d = gr.wave_details(plan, files)
    return d.withColumn("estimated_hours", F.round("estimated_hours", 6)).withColumn("average_lines_per_file", F.round("average_lines_per_file", 6))


# A plan per customer segment and nation, one wave per order month, one file per order.
SCHEDULE = """
SELECT concat(c_mktsegment, '-', cast(c_nationkey AS string)) AS project, cast(o_orderkey AS string) AS path,
       cast((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS int) AS wave
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""
START = datetime(2024, 3, 6, 10, 30)
_TIMES = f"""
WITH RECURSIVE w AS (SELECT project, wave, count(*) AS files, row_number() OVER (PARTITION BY project ORDER BY wave) - 1 AS pos FROM ({plain(SCHEDULE)}) GROUP BY project, wave),
t AS (SELECT project, pos, wave, files, CAST(15 + files * 5 AS BIGINT) AS e FROM w WHERE pos = 0
  UNION ALL SELECT w.project, w.pos, w.wave, w.files, t.e + least(10, (80 - t.e % 80) % 80) + w.files * 6 FROM t JOIN w ON w.project = t.project AND w.pos = t.pos + 1),
d AS (SELECT *, DATE '2024-03-06' + CAST((e - 1) // 80 + 2 * (((e - 1) // 80 + 2) // 5) AS INT) + INTERVAL 9 HOUR + INTERVAL 6 MINUTE * ((e - 1) % 80 + 1) AS finish FROM t),
s AS (SELECT project, pos, wave, files, finish, CASE WHEN pos = 0 THEN TIMESTAMP '2024-03-06 10:30:00' ELSE lag(finish) OVER (PARTITION BY project ORDER BY pos) + INTERVAL 1 HOUR END AS begin FROM d)"""


def _schedule(spark, sf_dir):
    return gr.timeline(derive(spark, sf_dir, SCHEDULE, "orders", "customer"), START)


def _stamp(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm").alias(name)


@query("timeline", _TIMES + """
SELECT project, wave, files AS file_count, CAST(files * CASE WHEN pos = 0 THEN 5 ELSE 6 END / 10 AS DOUBLE) AS duration_hours,
  strftime(begin, '%Y-%m-%d %H:%M') AS start, strftime(finish, '%Y-%m-%d %H:%M') AS "end" FROM s""")
def timeline(spark, sf_dir):
    return _schedule(spark, sf_dir).select("project", "wave", "file_count", "duration_hours", _stamp("start"), _stamp("end"))


@query("milestones", _TIMES + """
SELECT project, 'Migration Start' AS title, strftime(begin, '%Y-%m-%d %H:%M') AS "date", 'start' AS type, 'Start react-hooks migration' AS description FROM s WHERE pos = 0
UNION ALL SELECT project, 'Wave ' || (pos + 1) || ' Complete', strftime(finish, '%Y-%m-%d %H:%M'), 'milestone', 'Completed ' || files || ' files' FROM s
UNION ALL SELECT project, 'Migration Complete', strftime(max(finish), '%Y-%m-%d %H:%M'), 'end', 'react-hooks migration completed' FROM s GROUP BY project""")
def milestones(spark, sf_dir):
    return gr.milestones(_schedule(spark, sf_dir), "react-hooks").select("project", "title", _stamp("date"), "type", "description")


@query("gantt", _TIMES + """
SELECT project, 'wave-' || pos AS id, CASE WHEN pos > 0 THEN 'wave-' || (pos - 1) END AS dependency, files AS file_count, strftime(begin, '%Y-%m-%d %H:%M') AS start, strftime(finish, '%Y-%m-%d %H:%M') AS "end",
  CAST(files * CASE WHEN pos = 0 THEN 5 ELSE 6 END / 10 AS DOUBLE) AS duration FROM s""")
def gantt(spark, sf_dir):
    return gr.gantt(_schedule(spark, sf_dir)).select("project", "id", "dependency", "file_count", _stamp("start"), _stamp("end"), "duration")


@query("wave_progress", _TIMES + "SELECT project, wave, CAST(least(100.0, greatest(0.0, wave * 3.0 - 50)) AS DOUBLE) AS progress FROM s")
def wave_progress(spark, sf_dir):
    schedule = _schedule(spark, sf_dir)
    progress = schedule.select("project", "wave", (F.col("wave") * 3.0 - 50).cast("double").alias("percentage"))
    return gr.set_progress(schedule, progress).select("project", "wave", "progress")
