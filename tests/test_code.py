"""Parsing, lineage, risk and rewriting on small projects."""

from __future__ import annotations

import ast

from pyspark.sql import functions as F

from wardenlake.operators import codemetrics as cm
from wardenlake.operators import lineage as ln
from wardenlake.operators import rewrite as rw
from wardenlake.operators import risk

SCHEMA = "project string, path string, ext string, content string"


def table(spark, **texts):
    return spark.createDataFrame([("p", path, "." + path.rsplit(".", 1)[-1], text) for path, text in texts.items()], SCHEMA)


PY = '''"""Doc."""
import os, json as j
from a.b import c
class A(Base):
    def m(self, x):
        if x and x > 1 or x < 0:
            return [i for i in x if i]
        for q in x:
            while q:
                q -= 1
    async def n(self):
        async with x:
            pass
def top():
    try:
        pass
    except ValueError:
        pass
'''


def test_structure(spark):
    row = cm.structure(table(spark, **{"m.py": PY, "bad.py": "def (:\n", "nul.py": "a\x00b"})).filter("path = 'm.py'").first()
    assert row["parsed"] and row["docstring"] == "Doc." and row["line_count"] == PY.count("\n") + 1
    assert {f["name"]: f["complexity"] for f in row["functions"]} == {"m": 1 + 1 + 2 + 1 + 1 + 1, "n": 2, "top": 2}
    assert [(i["module"], i["line"]) for i in row["imports"]] == [("os", 2), ("json", 2), ("a.b", 3)]
    assert row["classes"][0]["methods"] == ["m", "n"]
    bad = {r["path"]: (r["parsed"], r["error"] is not None) for r in cm.structure(table(spark, **{"bad.py": "def (:\n", "nul.py": "a\x00b"})).collect()}
    assert bad == {"bad.py": (False, True), "nul.py": (False, True)}


def test_cognitive_follows_the_walk(spark):
    text = "if a:\n    pass\nif b and c:\n    for x in y:\n        pass\n"
    kinds = [type(n).__name__ for n in ast.walk(ast.parse(text)) if isinstance(n, (ast.If, ast.For, ast.BoolOp))]
    assert kinds == ["If", "If", "BoolOp", "For"]
    assert cm.structure(table(spark, **{"m.py": text})).first()["cognitive"] == 1 + 2 + (1 + 2) + (1 + 2)


def test_maintainability_and_debt(spark):
    frame = spark.createDataFrame([(0, 0, 0), (100, 10, 4), (60000, 1200, 150), (600, 600, 0)], "lines int, c int, f int")
    out = frame.select(cm.maintainability(F.col("lines"), F.col("c"), F.col("f")).alias("mi"), cm.technical_debt(F.col("c"), F.col("lines"), F.col("f")).alias("debt")).collect()
    assert out[0]["mi"] == 100.0 and out[3]["mi"] == 100.0 and out[2]["mi"] == 0.0
    assert abs(out[1]["mi"] - min(100, 171 - 5.2 * 100 ** 0.23 - 2.3 - 16.2 * 2)) < 1e-9
    assert [r["debt"] for r in out] == [0.0, 0.0, round(20 + 20 + 25, 1), 5.0]


def test_corpus_aggregate_and_levels(spark):
    s = cm.structure(table(spark, **{"m.py": PY, "bad.py": "def (:\n"}))
    row = cm.corpus_aggregate(s, ["project"]).first()
    assert (row["files_analyzed"], row["errors"], row["total_functions"], row["total_classes"], row["total_complexity"]) == (1, 1, 3, 1, 11)
    assert cm.file_metrics(s).first()["level"] == "MEDIUM"
    assert cm.dependency_list(s).first()["modules"] == ["a.b", "json", "os"]


def test_issue_rules_and_advice(spark):
    files = table(spark, **{"a.jsx": "class A extends React.Component { componentDidMount() {} render() { return this.state.x; } }", "b.py": "print 'x'\n", "c.py": "y = x / 2\n"})
    rules = sorted((r["path"], r["type"]) for r in cm.issue_rules(files).collect())
    assert rules == [("a.jsx", "class_component"), ("a.jsx", "lifecycle_method"), ("b.py", "python2_print"), ("c.py", "integer_division")]
    advice = sorted((r["path"], r["step"]) for r in cm.advice_steps(files, cm.structure(files)).collect())
    assert advice == [("a.jsx", "class_to_function"), ("a.jsx", "lifecycle"), ("a.jsx", "state"), ("b.py", "syntax_error")]


def test_rewrite_legacy_button(spark):
    text = "import React from 'react';\n\nclass LegacyButton extends React.Component {\n  render() {\n    return <button>{this.props.label}</button>;\n  }\n}\n"
    files = table(spark, **{"LegacyButton.jsx": text, "plain.js": "const a = 1;\n", "open.js": "class X extends Component { render() { return {"})
    out = {r["path"]: r for r in rw.rewrite(files, "react-hooks").collect()}
    button = out["LegacyButton.jsx"]
    assert button["changed"] and "const LegacyButton = (props)" in button["new_content"] and "{props.label}" in button["new_content"]
    assert button["diff"].startswith("--- LegacyButton.jsx") and not out["plain.js"]["changed"] and not out["open.js"]["changed"]
    summary = rw.change_summary(rw.rewrite(files, "react-hooks")).first()
    assert (summary["total_candidates"], summary["changed_files"], summary["failed_files"]) == (3, 1, 0)
    assert rw.remaining_after_apply(files, "react-hooks").count() == 0


def boom(text):
    raise ValueError("no")


def test_rewriter_errors_stay_with_their_file(spark):
    rw.register_rewriter("boom", [".js"], boom)
    row = rw.rewrite(table(spark, **{"a.js": "x"}), "boom").first()
    assert (row["changed"], row["error"]) == (False, "no")


def test_lineage(spark):
    py = "db = connect('postgres://u:" + "p@h/d;password=x')\ncur.execute(q)\nemail = user\n"
    js = "fetch('/api/patient/1').then(f)\nlocalStorage.setItem('PII', x)\n"
    files = table(spark, **{"a.py": py, "b.js": js, "c.env": "A=1\nDB_HOST=h\nDB_HOST=i\n"})
    found = ln.mentions(files)
    sources = sorted((r["path"], r["label"], r["value"], r["line"]) for r in ln.data_sources(found).collect())
    assert sources == [("a.py", "database", "postgres://***:***@h/d;password=***", 1), ("b.js", "api_endpoint", "/api/patient/1", 1), ("c.env", "config_database", "DB_HOST", 2)]
    issues = sorted((r["path"], r["type"], r["line"]) for r in ln.issues(found).collect())
    assert issues == [("a.py", "HARDCODED_CREDENTIALS", 1), ("b.js", "PII_IN_API_ENDPOINT", 1), ("b.js", "UNENCRYPTED_PII_STORAGE", 2)]
    nodes = found.filter("path = 'a.py'").count()
    assert ln.lineage_edges(found).filter("path = 'a.py'").count() == nodes - 1
    assert ln.transformations(found).filter("label = 'sql_execute'").first()["context"].count("\n") == 2


def test_risk_scores(spark):
    files = table(spark, **{"src/a.js": "this.state this.props " * 6, "src/b.test.js": "x", "requirements.txt": "# c\na==1\nb>=2\nraw\n"})
    factors = risk.factor_table(files, cm.structure(files), "react-hooks").first().asDict()
    ratio = 1 / 2
    assert ratio >= 0.5 and factors["test_coverage"] == 85
    assert factors["complexity"] == 50 and factors["code_quality"] == 70
    assert factors["dependencies"] == int(45 + 2 / 3 * 35 + int(1 / 3 * 15))
    assert factors["breaking_changes"] == 50  # twelve occurrences over two files
    out = risk.confidence(files, cm.structure(files), "react-hooks").first()
    overall = 85 * .25 + 50 * .2 + factors["dependencies"] * .15 + 70 * .15 + 50 * .15 + 50 * .1
    assert out["overall_score"] == int(overall) and out["file_count"] == 2
    assert out["estimated_hours"] == round(2 * 0.5 * (1 + (100 - overall) / 50) * 1.3, 1)


def test_risk_register(spark):
    files = table(spark, **{"a.py": "pass" + "word = 'x'\nexec(y)\n", "b.js": "this.state\nmail a@b.com", "requirements.txt": "raw\n"})
    rows = {r["title"]: (r["level"], r["file_paths"]) for r in risk.risk_register(files, cm.structure(files), "react-hooks").collect()}
    assert rows["Hardcoded Secrets Detected"] == ("CRITICAL", ["a.py"]) and rows["Unsafe Code Execution"] == ("HIGH", ["a.py"])
    assert rows["Breaking Changes Required"] == ("HIGH", ["b.js"]) and rows["PII Data Detected"] == ("HIGH", ["b.js"])
    assert rows["Unpinned Dependencies"] == ("MEDIUM", ["requirements.txt"]) and len(rows) == 8


def test_weights_must_sum_to_one(spark):
    import pytest

    with pytest.raises(ValueError):
        risk.weighted_score(spark.createDataFrame([(1,)], "complexity int"), {"complexity": 1.4})


def test_one_file_of_parts_is_dealt_over_tasks(spark, tmp_path):
    """A table in one row group is one task; texts are parsed in as many as a shuffle has, without any setting."""
    from wardenlake.plans import code_queries, graph_queries, risk_queries
    from wardenlake.sources.tables import DEAL

    spark.createDataFrame([(i, i % 50, "b") for i in range(200)], "p_partkey long, p_size int, p_brand string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    setting = spark.conf.get(DEAL)
    spark.conf.unset(DEAL)
    try:
        for files in (code_queries._files(spark, str(tmp_path)), graph_queries._code(spark, str(tmp_path))[0], risk_queries._inputs(spark, str(tmp_path))[0].filter("ext = '.py'")):
            held = files.groupBy(F.spark_partition_id()).count().count()
            assert held >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.set(DEAL, setting)


def test_nested_functions_count_what_is_below_them(spark):
    text = "def a(x):\n    if x and x or x:\n        def b():\n            for i in x:\n                def c():\n                    return [j for j in i if j]\n    with x:\n        pass\n"
    tree = ast.parse(text)
    want = {f.name: 1 + sum(isinstance(n, cm._BRANCHES) for n in ast.walk(f)) + sum(len(n.values) - 1 for n in ast.walk(f) if isinstance(n, ast.BoolOp))
            for f in ast.walk(tree) if isinstance(f, ast.FunctionDef)}
    row = cm.structure(table(spark, **{"m.py": text})).first()
    assert {f["name"]: f["complexity"] for f in row["functions"]} == want and row["complexity"] == sum(want.values())


def test_file_metrics_keep_the_index_before_its_bounds(spark):
    """Two small files are both at the upper bound, and still differ."""
    rows = {r["path"]: r for r in cm.file_metrics(cm.structure(table(spark, **{"a.py": "def f():\n    pass\n", "b.py": PY}))).collect()}
    assert {r["maintainability_index"] for r in rows.values()} == {100.0}
    assert abs(rows["a.py"]["index_raw"] - (171 - 5.2 * 3 ** 0.23 - 0.23 - 16.2)) < 1e-9 and rows["b.py"]["index_raw"] < rows["a.py"]["index_raw"]
