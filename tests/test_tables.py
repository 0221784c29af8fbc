"""Audit, sources, snapshots, ledger, finance and retrieval on small fixtures."""

from __future__ import annotations

import hashlib
import json
import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wardenlake.operators import audit, catalog, finance, ledger, retrieval, snapshots
from wardenlake.sources import auditlog, corpus, export, paths
from wardenlake.sources.tables import read_state, write_state
from wardenlake.streaming import jobs

T0 = datetime(2025, 1, 1, 10)


# --- audit ---------------------------------------------------------------------------------
def five_events(spark, folder):
    kinds = ["FILE_ACCESS", "FILE_ACCESS", "MIGRATION_EVENT", "MIGRATION_EVENT", "SECURITY_VIOLATION"]
    lines = [json.dumps({"event_id": f"e{i}", "event_type": k, "timestamp_utc": (T0 + timedelta(hours=i)).isoformat() + "+00:00", "user": f"u{i % 2}",
                         "action": "READ", "resource": "r", "result": "SUCCESS"}) for i, k in enumerate(kinds)]
    folder.mkdir()
    (folder / "audit.jsonl").write_text("\n".join(lines[:2] + ["", "{not json", "   "] + lines[2:]) + "\n")
    return auditlog.read_audit(spark, str(folder))


def test_audit_log(spark, tmp_path):
    events = five_events(spark, tmp_path / "log")
    assert events.count() == 5
    total = audit.compliance_aggregate(events).first()
    assert (total["total_events"], total["unique_users"], total["security_violations"], total["gdpr_pii_events"]) == (5, 2, 1, 0)
    scores = {r["control"]: r["score"] for r in audit.control_scores(audit.compliance_aggregate(events), "SOC2").collect()}
    assert scores["access_control"] == 50 and len(scores) == 11
    at = [F.lit((T0 + timedelta(hours=h)).isoformat(sep=" ")).cast("timestamp") for h in (1, 3)]
    assert [r["event_id"] for r in audit.search(events, start=at[0], end=at[1]).collect()] == ["e1", "e2"]
    assert audit.search(events, event_type="FILE_ACCESS", limit=1).count() == 1


def test_empty_log(spark, tmp_path):
    total = audit.compliance_aggregate(auditlog.read_audit_or_empty(spark, str(tmp_path / "none"))).first()
    assert (total["total_events"], total["unique_users"], total["failed_operations"]) == (0, 0, 0)


def test_audit_roundtrip_and_stream(spark, tmp_path):
    events = five_events(spark, tmp_path / "log")
    auditlog.append_audit(events, str(tmp_path / "copy"))
    assert auditlog.read_audit(spark, str(tmp_path / "copy")).orderBy("event_id").collect() == events.orderBy("event_id").collect()
    broken = events.limit(1).withColumn("event_id", F.lit(None).cast("string"))
    line = json.loads(auditlog.to_lines(broken).first()["value"])
    assert (line["user"], line["resource"], line["error"]) == ("ANONYMIZED", "REDACTED", "JSON_SERIALIZATION_FAILED")
    streamed = jobs.run_available(auditlog.stream_audit(spark, str(tmp_path / "log")), str(tmp_path / "out"))
    assert streamed.count() == 5


def test_normalise(spark):
    raw = spark.createDataFrame([(T0, "FILE_ACCESS", "ann", "read", "/srv/user/x.json", "success", {"file_path": "/a/b.c", "note": "/a/b"}),
                                 (T0, "FILE_ACCESS", "", "write", "", "failure", {}), (T0, "X", "b", "read", "my_token", "denied", {})],
                                "ts timestamp_ntz, event_type string, user string, action string, resource string, result string, details map<string,string>")
    rows = audit.normalise(raw).collect()
    assert rows[0]["user"] == hashlib.sha256(b"ann").hexdigest()[:16] and rows[0]["resource"] == "x.json" and rows[0]["action"] == "READ"
    assert rows[0]["details"] == {"file_path": "b.c", "note": "/a/b"} and rows[0]["compliance"]["gdpr_pii_processed"]
    assert (rows[1]["user"], rows[1]["resource"], rows[1]["compliance"]["data_classification"]) == ("ANONYMOUS", "UNKNOWN", "PUBLIC")
    assert rows[2]["compliance"]["data_classification"] == "RESTRICTED"
    assert audit.search(audit.normalise(raw), user="ann").count() == 1


def test_detail_json(spark):
    row = spark.createDataFrame([('{"a":{"x_path":"/p/q/r.py"},"path":"/z","keep":"/p/q"}',)], "d string").select(audit.clean_details_json(F.col("d")).alias("d")).first()
    assert json.loads(row["d"]) == {"a": {"x_path": "r.py"}, "path": "z", "keep": "/p/q"}


# --- sources -------------------------------------------------------------------------------
def test_corpus(spark, tmp_path):
    for name, data in {"src/a.py": b"x = 1\n", "src/b.PY": b"caf\xc3\xa9 \xff!", "src/bin.py": b"a\x00b", "src/late.py": b"a" * 5000 + b"\x00",
                       "node_modules/c.py": b"y", "src/d.txt": b"z", "src/big.py": b"b" * 30000}.items():
        target = tmp_path / name
        target.parent.mkdir(exist_ok=True)
        target.write_bytes(data)
    files = {r["path"]: r for r in corpus.read_corpus(spark, str(tmp_path), "p", [".py"], max_file_kb=20).collect()}
    assert set(files) == {"src/a.py", "src/b.PY"}
    assert "src/big.py" in {r["path"] for r in corpus.read_corpus(spark, str(tmp_path), "p", [".py"]).collect()}
    assert files["src/b.PY"]["content"] == b"caf\xc3\xa9 \xff!".decode("utf-8", errors="ignore")


def test_scan_set_and_paths(spark):
    names = [".env", ".hidden.py", "__init__.py", "a/.git/x.py", "ok.py", "prod.env", "a.exe", "venv/a.py"]
    frame = spark.createDataFrame([(n,) for n in names], "path string")
    assert [r["path"] for r in frame.filter(corpus.scan_set(F.col("path"))).collect()] == [".env", "ok.py", "prod.env"]
    cases = {"../x.py": {"contains_parent"}, "a;b.py": {"contains_semicolon"}, "": {"length"}, "a" * 4095: set(), "a" * 4096: {"length"}, "x.EXE": {"extension_not_allowed", "suspicious_extension"},
             "con.txt": {"reserved_name"}, "a.txt ": {"edge_characters", "extension_not_allowed"}, "ok/fine.py": set(), "ünï.md": set(), "a\x00.py": {"contains_nul"}}
    rows = spark.createDataFrame([(c,) for c in cases], "path string").select("path", paths.violations(F.col("path")).alias("v")).collect()
    assert {r["path"]: set(r["v"]) for r in rows} == cases


def test_state_and_export(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a"), (2, "b")], "v int, day string")
    write_state(frame, str(tmp_path / "s"), ["day"])
    write_state(frame, str(tmp_path / "s"), ["day"])
    assert read_state(spark, str(tmp_path / "s")).count() == 4
    export.export_graph(frame, frame, frame, str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g" / "waves")).count() == 2
    with pytest.raises(ValueError):
        export.export_report(frame, str(tmp_path / "r"), "pdf")


# --- snapshots and ledger --------------------------------------------------------------------
def files(spark, rows):
    return spark.createDataFrame([(p, c, T0 + timedelta(days=d)) for p, c, d in rows], "path string, content string, modified timestamp_ntz")


def test_snapshots(spark):
    old = files(spark, [("same", "1", 0), ("changed", "2\n3", 0), ("gone", "4", 0)])
    new = files(spark, [("same", "1", 0), ("changed", "2", 5), ("fresh", "6", 5)])
    a, b = snapshots.file_manifest(old, "a", modified="modified"), snapshots.file_manifest(new, "b", modified="modified")
    assert {r["path"]: r["change"] for r in snapshots.compare(a, b).collect()} == {"same": "unchanged", "changed": "modified", "gone": "removed", "fresh": "added"}
    assert {r["path"]: r["action"] for r in snapshots.rollback_preview(a, b).collect()} == {"changed": "restore", "gone": "create", "fresh": "delete"}
    assert [r["path"] for r in snapshots.conflicts(a, b).collect()] == ["changed"]
    assert snapshots.content_diff(old, new).filter("path = 'changed'").first().asDict() == {"path": "changed", "line_difference": -1, "size_difference": -2}
    one = snapshots.restore(old, new, spark.createDataFrame([("fresh",), ("gone",)], "path string"))
    assert {r["path"]: r["content"] for r in one.collect()} == {"same": "1", "changed": "2", "gone": "4"}
    assert snapshots.integrity(a, snapshots.file_manifest(snapshots.restore(old, new), "r")).count() == 0
    third = snapshots.file_manifest(files(spark, [("same", "9", 6)]), "c", modified="modified")
    deltas = snapshots.incremental(a, b).withColumn("version", F.lit(1)).unionByName(snapshots.incremental(b, third).withColumn("version", F.lit(2)))
    assert {r["path"]: r["checksum"] for r in snapshots.materialise(a, deltas).collect()} == {r["path"]: r["checksum"] for r in third.collect()}


def test_tree_of_a_checkpoint(spark, tmp_path):
    """Only ranges that differ are read: files of an equal range may even be broken."""
    old = [(f"f{i}", f"text {i}", 0) for i in range(400)]
    new = [(p, c + "!" if p in ("f7", "f300") else c, d) for p, c, d in old if p != "f9"] + [("added", "x", 0)]
    for name, rows in (("a", old), ("b", new)):
        snapshots.write_checkpoint(snapshots.file_manifest(files(spark, rows), name, modified="modified"), str(tmp_path / name), 1)
    trees = [spark.read.parquet(str(tmp_path / name / "tree")) for name in "ab"]
    changed = {r["range"] for r in snapshots.changed_ranges(*trees, 1).collect()}
    assert changed == {hashlib.sha256(p.encode()).hexdigest()[:1] for p in ("f7", "f9", "f300", "added")}
    for folder in (tmp_path / "a" / "rows").glob("range=*"):
        if folder.name[6:] not in changed:
            for file in folder.glob("*.parquet"):
                (folder / f".{file.name}.crc").unlink(missing_ok=True)
                file.write_bytes(b"broken")
    got = {r["path"]: r["change"] for r in snapshots.compare_checkpoints(spark, str(tmp_path / "a"), str(tmp_path / "b"), 1).collect()}
    assert got == {"f7": "modified", "f300": "modified", "f9": "removed", "added": "added"}
    assert snapshots.compare_checkpoints(spark, str(tmp_path / "b"), str(tmp_path / "b"), 1).count() == 0


def test_fingerprint(spark):
    a = snapshots.file_manifest(files(spark, [(f"p{i}", str(i), 0) for i in range(200)]), "a")
    first = snapshots.revision_fingerprint(a).first()
    assert snapshots.revision_fingerprint(a.orderBy(F.desc("path")).repartition(7)).first() == first and first["rows"] == 200
    swapped = a.withColumn("checksum", F.when(F.col("path") == "p1", "x").otherwise(F.col("checksum")))
    assert snapshots.revision_fingerprint(swapped).first()["fingerprint"] != first["fingerprint"]


def test_retention(spark):
    rows = [("w", f"c{i}", T0 - timedelta(days=10 * i)) for i in range(6)]
    frame = spark.createDataFrame(rows, "workspace string, checkpoint_id string, created_at timestamp_ntz")
    gone = snapshots.expired_checkpoints(frame, 2, 25, F.lit(T0).cast("timestamp_ntz"))
    assert sorted(r["checkpoint_id"] for r in gone.collect()) == ["c3", "c4", "c5"]
    backups = frame.withColumnRenamed("workspace", "path").withColumnRenamed("checkpoint_id", "backup_id")
    assert sorted(r["backup_id"] for r in snapshots.expired_backups(backups, 4, 25, F.lit(T0).cast("timestamp_ntz")).collect()) == ["c3", "c4", "c5"]
    assert sorted(r["backup_id"] for r in snapshots.expired_backups(backups, 2, 25, F.lit(T0).cast("timestamp_ntz")).collect()) == ["c2", "c3", "c4", "c5"]


def test_ledger(spark):
    ops = spark.createDataFrame([("o1", "apply", "w", "t", "r1", T0, "first"), ("o1", "apply", "w", "t", "r1", T0 + timedelta(1), "replay"), ("o2", "apply", "w", "t", "r1", T0, "a"),
                                 ("o2", "apply", "w", "t", "r2", T0 + timedelta(1), "b")],
                                "operation_id string, action string, workspace_id string, migration_type string, source_revision string, created_at timestamp_ntz, result string")
    assert {r["operation_id"]: (r["result"], r["attempts"], r["conflict"]) for r in ledger.deduplicate(ops).collect()} == {"o1": ("first", 2, False), "o2": ("a", 2, True)}
    previews = spark.createDataFrame([("d1", "w", "r1", T0), ("d2", "w", "r1", T0), ("d3", "w", "r1", T0 + timedelta(9))], "operation_id string, workspace_id string, source_revision string, created_at timestamp_ntz")
    applies = spark.createDataFrame([(f"a{i}", d, "w", r, T0 + timedelta(1)) for i, (d, r) in enumerate([("d1", "r1"), ("d2", "r2"), ("d3", "r1"), ("none", "r1")])],
                                    "operation_id string, dry_run_id string, workspace_id string, source_revision string, created_at timestamp_ntz")
    assert {r["operation_id"]: r["reason"] for r in ledger.approval_violations(applies, previews).collect()} == {"a1": "revision_changed", "a2": "dry_run_too_late", "a3": "missing_dry_run"}


# --- finance -----------------------------------------------------------------------------------
def test_cost(spark):
    rows = [("p", "react-hooks", 10, 50.0, 4, "HIGH"), ("q", "none", 1, 0.0, 1, "ODD")]
    got = {r["project"]: r for r in finance.cost_breakdown(spark.createDataFrame(rows, "project string, migration_type string, file_count int, complexity_score double, team_size int, risk_level string")).collect()}
    hours = 10 * 3.0 * 1.3
    base = hours * 100 + hours * 30 + 900 + 4 * 900
    assert got["p"]["total_cost"] == pytest.approx(base + hours * 100 * 0.2 + base * 0.2)
    base = 200 + 60 + 710 + 900
    assert got["q"]["total_cost"] == pytest.approx(base + 20 + base * 0.15)


def test_roi(spark):
    rows = [("p", "a", 1000.0, 100.0, 0.0), ("p", "zero", 0.0, 10.0, 0.0), ("p", "none", 500.0, 0.0, 0.0), ("p", "tie", 1000.0, 100.0, 0.0)]
    metrics = finance.roi_metrics(spark.createDataFrame(rows, "project string, name string, investment double, monthly_savings double, monthly_revenue_increase double"))
    got = {r["name"]: r for r in finance.scenario_ranking(metrics).collect()}
    npv = -1000 + sum(100 / (1 + 0.1 / 12) ** m for m in range(1, 25))
    assert got["a"]["npv"] == pytest.approx(npv) and got["a"]["roi_percentage"] == pytest.approx(140)
    assert math.isinf(got["none"]["payback_months"]) and got["zero"]["roi_percentage"] == 0
    assert got["a"]["rank_score"] == pytest.approx(0.4 * 1.4 + 0.3 * (1 - 10 / 24) + 0.3 * npv / 1000, abs=1e-8)
    assert sorted(got, key=lambda n: got[n]["rank"])[-1] == "none" and got["a"]["rank"] + 1 == got["tie"]["rank"]


def test_budget(spark):
    plans = spark.createDataFrame([("p", 12000.0, T0), ("q", 12000.0, T0)], "plan_id string, total_budget double, created timestamp_ntz")
    items = finance.allocate_budget(plans)
    one = 12000 * 0.85 / 6
    spent = [("p", "Development", one * 1.25), ("p", "Testing", one * 1.1), ("q", "Training", one)]
    posted = finance.post_expenses(items, spark.createDataFrame(spent, "plan_id string, category string, amount double"), ["plan_id", "category"])
    got = {(r["plan_id"], r["category"]): r["status"] for r in posted.collect()}
    assert [got["p", c] for c in ("Development", "Testing", "Training")] == ["OVER_BUDGET", "WARNING", "PLANNED"] and got["q", "Training"] == "ON_TRACK"
    summary = finance.budget_summary(posted, F.lit("2025-01-31").cast("date"))
    rows = {r["plan_id"]: r for r in summary.collect()}
    assert rows["p"]["status"] == "AT_RISK" and rows["q"]["status"] == "HEALTHY" and rows["q"]["daily_burn_rate"] == pytest.approx(one / 30)
    months = finance.forecast(summary, F.lit("2025-01-31").cast("date"), 6).filter("plan_id = 'q'").orderBy("month").collect()
    assert months[5]["cumulative_spend"] == pytest.approx(one * 7) and months[0]["advice"] == "SUFFICIENT"
    assert finance.compare_budgets(summary).first()["plan_id"] == "p"


# --- retrieval -----------------------------------------------------------------------------------
def test_chunks_and_keywords(spark):
    text = "a" * 49 + "\n\n" + "b" * 50 + "\n# " + "Head " + "c" * 60 + "\n\n\n" + "  " + "d" * 55 + "  "
    docs = spark.createDataFrame([(1, "s", "documentation", text)], "doc_id bigint, source string, doc_type string, text string")
    assert [r["char_count"] for r in retrieval.chunk(docs).orderBy("section_index").collect()] == [49, 50, 65, 55]
    rows = retrieval.chunk(docs, at_least=50).orderBy("section_index").collect()
    assert [(r["section_index"], r["char_count"]) for r in rows] == [(1, 50), (2, 65), (3, 55)]
    assert rows[0]["chunk_id"] == "chunk_" + hashlib.md5(("s_1_" + "b" * 50).encode()).hexdigest()[:12]
    words = spark.createDataFrame([("The Quick, quick fox-trot 123 4th été it's " + " ".join(f"word{i:02d}" for i in range(30)),)], "t string")
    got = words.select(retrieval.keywords(F.col("t")).alias("k")).first()["k"]
    assert got == sorted({"quick", "fox", "trot", "4th", "été", *[f"word{i:02d}" for i in range(30)]})


def test_search_and_scores(spark):
    filler = " lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod"
    docs = spark.createDataFrame([(1, "a", "documentation", "alpha beta gamma" + filler), (2, "b", "code_example", "alpha beta delta" + filler * 4), (3, "c", "general", "nothing here at all" + filler)],
                                 "doc_id bigint, source string, doc_type string, text string")
    chunks = retrieval.chunk(docs)
    index = retrieval.postings(chunks)
    queries = spark.createDataFrame([(7, "alpha beta gamma")], "query_id int, text string")
    by_source = {r["chunk_id"]: r["source"] for r in chunks.collect()}
    hits = retrieval.keyword_search(queries, index).orderBy("rank").collect()
    assert [(by_source[h["chunk_id"]], h["hits"]) for h in hits] == [("a", 3), ("b", 2)]
    scored = retrieval.scored_retrieval(queries, chunks, index).orderBy("rank").collect()
    assert [(by_source[s["chunk_id"]], s["score"]) for s in scored] == [("a", 10 + 6 + 3), ("b", 4 + 2 + 1)]
    wanted = retrieval.scored_retrieval(queries.withColumn("intent", F.lit("code_help")), chunks, index)
    assert [by_source[s["chunk_id"]] for s in wanted.collect()] == ["b"]
    updated = retrieval.update_index(index, chunks.filter("source = 'a'").withColumn("content", F.lit("zeta")), chunks.filter("source = 'b'").select("chunk_id"))
    assert "zeta" in {r["keyword"] for r in updated.collect()} and updated.filter("keyword = 'alpha'").count() == 0


def test_context_window_across_blocks(spark):
    rows = [("hot", t * 3, "user", str(t)) for t in range(50)] + [("cold", 1, "user", "x")]
    frame = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    got = {(r["conv_id"], r["turn"]): [m["text"] for m in r["window"]] for r in retrieval.context_window(frame, size=10, block=16).collect()}
    assert len(got) == 51 and all(got["hot", t * 3] == [str(i) for i in range(max(0, t - 9), t + 1)] for t in range(50))


def test_intents(spark):
    texts = {"An ERROR here": "troubleshoot", "Should I go": "recommend", "why so": "explain", "convert it": "code_help", "timeline?": "planning", "is it safe": "security", "hi": "general",
             "explain the error": "troubleshoot"}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", retrieval.classify_intent(F.col("t")).alias("i")).collect()
    assert {r["t"]: r["i"] for r in rows} == texts


def test_catalog(spark):
    frame = spark.createDataFrame([(1, "a", "d", "x", "au", ["t1"], 5, 4.0, 2), (2, "b", "d", "x", "au", ["T2"], 9, 4.0, 3), (3, "c", "d", "y", "bu", [], 1, 5.0, 9)],
                                  "pattern_id int, name string, description string, migration_type string, author string, tags array<string>, downloads int, rating double, review_count int")
    assert [r["pattern_id"] for r in catalog.top_rated(frame).collect()] == [3, 2]
    assert [r["pattern_id"] for r in catalog.popular(frame, 2).collect()] == [2, 1]
    assert [r["pattern_id"] for r in catalog.search_catalog(frame, "t2").collect()] == [2]
    ratings = spark.createDataFrame([(1, 1.0), (1, 9.0)], "pattern_id int, rating double")
    assert catalog.fold_ratings(frame, ratings).filter("pattern_id = 1").first()["rating"] == 3.0
    grades = spark.createDataFrame([(v,) for v in (90.0, 80.0, 70.0, 60.0, 59.9)], "v double").select(catalog.coverage_grade(F.col("v")).alias("g")).collect()
    assert [g["g"] for g in grades] == list("ABCDF")


def test_pages_are_written_by_several_tasks(spark, tmp_path):
    """One file of pages, dealt over tasks without any setting; rows of one page stay in one file."""
    import glob

    from wardenlake.plans.source_queries import corpus_scan
    from wardenlake.session import ensure_checkpoint_dir
    from wardenlake.sources.tables import DEAL

    spark.createDataFrame([(i, f"<p>{i}</p>") for i in [*range(40), 3]], "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    folders = f"{ensure_checkpoint_dir(spark).removeprefix('file:')}/corpus-*"
    setting, before = spark.conf.get(DEAL), set(glob.glob(folders))
    spark.conf.unset(DEAL)
    try:
        sizes = {r["page_id"]: r["size_bytes"] for r in corpus_scan(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set(DEAL, setting)
    assert sizes == {i: (2 if i == 3 else 1) * (len(f"<p>{i}</p>") + 1) for i in range(40)}
    (base,) = set(glob.glob(folders)) - before
    assert len({name.rsplit("/", 1)[1][:10] for name in glob.glob(f"{base}/*/part-*")}) > 1


def test_pages_are_files_of_few_folders_read_in_groups(spark, tmp_path, monkeypatch):
    """Folders hold many pages, scans take some folders; odd rows: no id, ids that repeat or are negative, null, empty, binary and non-ASCII texts."""
    import os

    from wardenlake.plans import source_queries

    odd = [(None, "a"), (None, "b"), (-7, "é ü"), (100, None), (101, ""), (102, "x\x00y"), (103, "one"), (103, None), (103, "two"), (104, "same"), (104, "same")]
    rows = [*((i, f"<p>{i}</p>") for i in range(60)), *odd]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(corpus, "FOLDER_FILES", 6)
    monkeypatch.setattr(corpus, "SCAN_FILES", 20)
    scans, scan = [], corpus.read_corpus

    def seen(spark, root, *args, **more):
        scans.append((root, more["folders"]))
        return scan(spark, root, *args, **more)

    monkeypatch.setattr(corpus, "read_corpus", seen)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    found = [(r["page_id"], r["size_bytes"], r["ext"], r["content_md5"]) for r in source_queries.corpus_scan(spark, str(tmp_path)).collect()]
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before
    md5 = lambda text: (len(text.encode()), ".txt", hashlib.md5(text.encode()).hexdigest())
    want = [(i, *md5(t + "\n")) for i, t in [*rows[:60], (None, "a"), (None, "b"), (-7, "é ü"), (100, ""), (101, ""), (104, "same\nsame")]]
    assert len(found) == len({r[0] for r in found}) + 1 and sorted((r for r in found if r[0] != 103), key=str) == sorted(want, key=str)
    assert [r[1] for r in found if r[0] == 103] == [len("one\n\ntwo\n")]
    root = scans[0][0].removeprefix("file:")
    files = {f: len([x for x in os.listdir(f"{root}/{f}") if not x.endswith(".crc")]) for f in os.listdir(root)}
    assert max(files.values()) == 6 and sum(files.values()) == 68  # a folder a page before
    assert sorted(f for _, folders in scans for f in folders) == sorted(files) and len(scans) > 3
    assert all(sum(files[f] for f in folders) <= 20 for _, folders in scans)


def test_written_files_of_lost_attempts_and_other_stores(spark, tmp_path):
    """Folders that no task reported aren't read; a store without pyarrow access is written by Spark; no rows make no files."""
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(9)], "k long, t string")
    written = corpus.write_files(rows, f"file:{tmp_path}/a", "k", "t")
    assert sum(n for _, n in written) == 9
    (tmp_path / "a/00000-lost").mkdir()
    (tmp_path / "a/00000-lost/part-00000-00000-k=3.txt").write_text("t")
    (group,) = corpus.scan_groups(written)
    read = corpus.read_corpus(spark, f"file:{tmp_path}/a", "p", [".txt"], folders=group)
    assert sorted(r["content"] for r in read.collect()) == [f"t{i}\n" for i in range(9)]
    (tmp_path / "b").mkdir()
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.files.link./b", f"file://{tmp_path}/b")
    assert corpus.write_files(rows, "viewfs://files/b/c", "k", "t") is None
    (group,) = corpus.scan_groups(None)
    read = corpus.read_corpus(spark, "viewfs://files/b/c", "p", [".txt"], folders=group)
    assert sorted(r["content"] for r in read.collect()) == [f"t{i}\n" for i in range(9)]
    assert corpus.write_files(rows.limit(0), f"file:{tmp_path}/d", "k", "t") == [] and corpus.scan_groups([]) == [[]]
    assert corpus.read_corpus(spark, f"file:{tmp_path}/d", "p", [".txt"], folders=[]).count() == 0
