"""Waves, plan checks and the schedule against plain loops."""

from __future__ import annotations

import hashlib
import random
from datetime import datetime, timedelta

import pytest

from wardenlake.operators import graph as gr


def frames(spark, graph):
    nodes = [(p, n) for p, (ns, _) in graph.items() for n in ns]
    edges = [(p, a, b) for p, (_, es) in graph.items() for a, b in es]
    return spark.createDataFrame(nodes, "project string, id string"), spark.createDataFrame(edges, "project string, src string, dst string")


def peel(nodes, edges):
    needs = {n: {b for a, b in edges if a == n and b in nodes} for n in nodes}
    wave, out = 0, {}
    while True:
        ready = [n for n in nodes if n not in out and all(d in out and out[d] < wave for d in needs[n])]
        if not ready:
            break
        out |= {n: wave for n in ready}
        wave += 1
    for i, n in enumerate(sorted(set(nodes) - set(out), key=lambda n: hashlib.md5(n.encode()).hexdigest())):
        out[n] = max([w for w in out.values() if w < wave] + [wave - 1]) + 1 + i if i == 0 else wave + i
    return out


def test_waves(spark):
    graph = {
        "chain": ("abcd", [("a", "b"), ("b", "c"), ("c", "d")]),
        "diamond": ("abcdz", [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")]),
        "cycle": ("abcd", [("a", "b"), ("b", "a"), ("c", "a"), ("a", "d")]),
        "outside": ("ab", [("a", "b"), ("a", "ext")]),
        "self": ("a", [("a", "a")]),
    }
    got = {(r["project"], r["id"]): (r["wave"], r["cyclic"]) for r in gr.waves(*frames(spark, graph)).collect()}
    for project, (nodes, edges) in graph.items():
        assert {n: got[(project, n)][0] for n in nodes} == peel(nodes, edges), project
    assert {k[1] for k, v in got.items() if v[1] and k[0] == "cycle"} == set("abc")


def test_random_waves(spark):
    rng = random.Random(4)
    graph = {}
    for p in range(6):
        nodes = [f"n{i:02d}" for i in range(25)]
        graph[f"p{p}"] = (nodes, list({(rng.choice(nodes), rng.choice(nodes)) for _ in range(rng.randint(5, 35))}))
    got = {(r["project"], r["id"]): r["wave"] for r in gr.waves(*frames(spark, graph)).collect()}
    for project, (nodes, edges) in graph.items():
        assert {n: got[(project, n)] for n in nodes} == peel(nodes, edges)


def reached(nodes, edges):
    out = {n: {b for a, b in edges if a == n and b in nodes} for n in nodes}
    for k in nodes:
        for n in nodes:
            if k in out[n]:
                out[n] |= out[k]
    return out


def test_cycle_members(spark):
    rng = random.Random(9)
    graph = {"none": ("abc", [("a", "b"), ("b", "c")]), "self": ("ab", [("a", "a"), ("b", "a")]), "empty": ("a", [])}
    ring = [f"r{i:03d}" for i in range(60)]
    graph["rings"] = (["x", "y", *ring], [*zip(ring, ring[1:] + ring[:1]), ("r003", "x"), ("x", "y"), ("y", "x"), ("y", "outside")])
    for p in range(5):
        nodes = [f"n{i:02d}" for i in range(30)]
        graph[f"p{p}"] = (nodes, [(rng.choice(nodes), rng.choice(nodes)) for _ in range(20 + 8 * p)])
    want = {}
    for project, (nodes, edges) in graph.items():
        reach = reached(nodes, edges)
        looped = {n for n in nodes if n in reach[n]}
        for n in nodes:
            if n in looped:
                want[project, n] = min(m for m in reach[n] if n in reach[m])
            elif reach[n] & looped:
                want[project, n] = None
    rows = gr.cycle_members(*frames(spark, graph)).collect()
    assert len(rows) == len(want) and {(r["project"], r["id"]): r["cycle"] for r in rows} == want


def test_a_long_chain_takes_few_jobs(spark):
    names = [f"c{i:04d}" for i in range(1000)]
    nodes, edges = frames(spark, {"chain": (names, list(zip(names, names[1:])))})
    spark.sparkContext.setJobGroup("long chain", "waves")
    got = {r["id"]: r["wave"] for r in gr.waves(nodes, edges).collect()}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("long chain")
    spark.sparkContext.setJobGroup("", "")
    assert got == {n: 999 - i for i, n in enumerate(names)}
    assert 0 < len(jobs) < 100


def test_dotted_modules(spark):
    files = spark.createDataFrame([("p", f) for f in ("src/a/b.py", "a/c/__init__.py", "c.js", "lib/x/util.py", "lib/util.py", "other/util.py", "/q.py")], "project string, path string")
    edges = spark.createDataFrame([("p", "main.py", m) for m in ("a.b", "b", "a.c", "c", "a/c", "x.util", "util", "q", "os.path", "z.a.b", "lib")], "project string, src string, dst string")
    got = {(r["dst"], r["internal"], r["ambiguous"]) for r in gr.resolve_modules(edges, files).collect()}
    assert got == {("src/a/b.py", True, False), ("a/c/__init__.py", True, False), ("c.js", True, True), ("lib/x/util.py", True, False), ("lib/util.py", True, True),
                   ("/q.py", True, False), ("os.path", False, False), ("z.a.b", False, False), ("lib", False, False)}


def test_statistics(spark):
    nodes, edges = frames(spark, {"p": ("abc", [("a", "b"), ("b", "c"), ("c", "a")])})
    typed = nodes.selectExpr("*", "'file' AS type")
    row = gr.graph_statistics(typed, edges, gr.waves(nodes, edges)).first()
    assert (row["total_nodes"], row["total_edges"], row["circular_dependencies"], row["average_degree"], row["density"]) == (3, 3, True, 2.0, 0.5)
    assert gr.plan_estimate(gr.graph_statistics(typed, edges, gr.waves(nodes, edges))).first()["risk_level"] == "HIGH"


def add_hours(current, hours, work_days_only):
    left = hours
    while left > 1e-9:
        if work_days_only and current.weekday() >= 5 or current >= current.replace(hour=17, minute=0):
            current = (current + timedelta(days=1)).replace(hour=9, minute=0)
            continue
        current = max(current, current.replace(hour=9, minute=0))
        today = (current.replace(hour=17, minute=0) - current).total_seconds() / 3600
        step = min(left, today)
        current += timedelta(hours=step)
        left -= step
    return current


def loop_schedule(counts, start, work_days_only):
    current, out = start, []
    for i, files in enumerate(counts):
        hours = files * 0.5 * (1.2 if i else 1)
        end = add_hours(current, hours, work_days_only)
        end = (end + timedelta(seconds=30)).replace(second=0, microsecond=0)
        out.append((current, end))
        current = end + timedelta(hours=1)
    return out


@pytest.mark.parametrize("start", [datetime(2024, 3, 6, 10, 30), datetime(2024, 3, 9, 11, 0), datetime(2024, 3, 8, 16, 54), datetime(2024, 3, 4, 7, 0)])
@pytest.mark.parametrize("work_days_only", [True, False])
def test_timeline(spark, start, work_days_only):
    rng = random.Random(start.day)
    plans = {"short": [1], "some": [rng.randint(1, 40) for _ in range(30)], "long": [rng.randint(1, 6) for _ in range(1300)]}
    rows = [(p, f"{w}-{i}", w * 2) for p, counts in plans.items() for w, n in enumerate(counts) for i in range(n)]
    plan = spark.createDataFrame(rows, "project string, path string, wave int")
    got: dict = {}
    for r in gr.timeline(plan, start, work_days_only).orderBy("project", "wave").collect():
        got.setdefault(r["project"], []).append((r["start"], r["end"]))
    for p, counts in plans.items():
        assert got[p] == loop_schedule(counts, start, work_days_only), p


def test_a_timeline_of_many_waves(spark, monkeypatch):
    """100,000 waves of one project: 196 segments in 49 blocks, against the loop."""
    monkeypatch.setattr(gr, "BLOCK", 4)
    start = datetime(2024, 3, 6, 10, 30)
    plan = spark.range(100_000).selectExpr("'p' AS project", "concat('f', id) AS path", "cast(id AS int) AS wave")
    got = gr.timeline(plan, start).select("wave", "start", "end").orderBy("wave").collect()
    assert [(r["start"], r["end"]) for r in got] == loop_schedule([1] * 100_000, start, True)


def test_milestones_and_gantt(spark):
    plan = spark.createDataFrame([("p", "a", 0), ("p", "b", 0), ("p", "c", 1)], "project string, path string, wave int")
    schedule = gr.timeline(plan, datetime(2024, 3, 6, 9, 0))
    assert sorted(r["title"] for r in gr.milestones(schedule, "x").collect()) == ["Migration Complete", "Migration Start", "Wave 1 Complete", "Wave 2 Complete"]
    assert {r["id"]: r["dependency"] for r in gr.gantt(schedule).collect()} == {"wave-0": None, "wave-1": "wave-0"}
    progress = spark.createDataFrame([("p", 0, 140.0), ("p", 1, -3.0)], "project string, wave int, percentage double")
    assert sorted(r["progress"] for r in gr.set_progress(schedule, progress).collect()) == [0.0, 100.0]


def test_plan_checks(spark):
    plan = spark.createDataFrame([("p", "a", 0), ("p", "b", 3), ("p", "a", 3), ("p", "ghost", 0)], "project string, path string, wave int")
    files = spark.createDataFrame([("p", "a"), ("p", "b")], "project string, path string")
    edges = spark.createDataFrame([("p", "a", "b")], "project string, src string, dst string")
    rows = sorted((r["rule"], r["subject"]) for r in gr.plan_violations(plan, files, edges).collect())
    assert rows == [("duplicate_file", "a"), ("empty_wave", "1"), ("empty_wave", "2"), ("late_dependency", "a -> b"), ("missing_file", "ghost")]
    verdict = gr.plan_verdict(gr.plan_violations(plan, files, edges), plan).first()
    assert (verdict["valid"], verdict["errors"], verdict["warnings"], verdict["total_files"], verdict["total_waves"]) == (False, 1, 4, 4, 2)
