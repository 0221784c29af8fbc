"""Pattern scan against Python's own matcher and small fixtures."""

from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from wardenlake.functions import sensitive_patterns as sp
from wardenlake.functions.text import Spec, located, passes_luhn, prefix_sums
from wardenlake.operators import scan


def files(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, content string")


def types_of(spark, text, **options):
    return sorted(r["type"] for r in scan.findings(files(spark, text), "id", **options).collect())


def luhn(value):
    digits = [int(c) for c in re.sub(r"\D", "", value)]
    if not 13 <= len(digits) <= 19:
        return False
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def python_findings(text):
    out = []
    for p in sp.PATTERNS:
        for m in re.finditer(p.regex, text, re.M | re.I):
            if p.validator and not luhn(m.group()):
                continue
            line = text.count("\n", 0, m.start()) + 1
            shown = text.split("\n")[line - 1].replace(m.group(), "[REDACTED]")
            out.append((p.type, line, m.start() - text.rfind("\n", 0, m.start()), shown.strip()))
    return sorted(out)


def random_text(rng):
    pieces = ["a@b.co", "x.y_z@mail.example.org", "555-123-4567", "+1 (555) 123-4567", "123-45-6789", "4242 4242 4242 4242", "4111-1111-1111-1112",
              "10.0.0.1", "01/15/1980", "12 Long Oak Street", "AB1234567", "MRN: 12ab", "ICD-10: J45.9", "patient id: 77", "CPT 99213",
              "tok" + "en = '" + "a1" * 9 + "'", "ey" + "Jab.cd-e.f_g", "-----BEGIN " + "PRIVATE KEY-----", "é", "日本", "word", "\n", "\n\n", " ", "\t", "!", "9"]
    return "".join(rng.choice(pieces) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randint(0, 60)))


def test_findings_match_python(spark):
    rng = random.Random(11)
    texts = [random_text(rng) for _ in range(150)]
    got: dict[int, list] = {i: [] for i in range(len(texts))}
    for r in scan.findings(files(spark, *texts), "id").collect():
        got[r["id"]].append((r["type"], r["line"], r["column"], r["context"]))
    for i, text in enumerate(texts):
        assert sorted(got[i]) == python_findings(text), text
    core = scan.findings_core(files(spark, *texts), "id").groupBy("type").count().collect()
    assert sum(r["count"] for r in core) == sum(len(v) for v in got.values())


def test_many_matches_keep_their_positions(spark):
    text = "\n".join(f"line {i} u{i}@example.com and v{i}@example.org" for i in range(1500))
    rows = scan.findings(files(spark, text), "id", types=["email"]).orderBy("line", "column").collect()
    assert [(r["type"], r["line"], r["column"], r["context"]) for r in rows] == python_findings(text)


def test_prefix_sums(spark):
    for n in (0, 1, 255, 256, 257, 2000):
        values = [(i * 7) % 13 for i in range(n)]
        row = spark.createDataFrame([(values,)], "v array<int>").select(prefix_sums(F.col("v")).alias("s")).first()
        assert row["s"] == [sum(values[: i + 1]) for i in range(n)]


def test_located_group_values(spark):
    row = files(spark, "ab1 cd22\nef333").select(located(F.col("content"), [Spec("t", r"([a-z]+)\d+", 1)]).alias("m")).first()
    assert [(m["value"], m["start"], m["newlines_before"]) for m in row["m"]] == [("ab", 0, 0), ("cd", 4, 0), ("ef", 9, 1)]


def test_luhn_random(spark):
    rng = random.Random(5)
    values = ["".join(rng.choice("0123456789- ") for _ in range(rng.randint(0, 26))) for _ in range(400)] + ["4242424242424242"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", passes_luhn(F.col("v")).alias("ok")).collect()
    assert all(r["ok"] == luhn(r["v"]) for r in rows)


def test_rare_patterns_hit_and_miss(spark):
    positive = {
        "ssn": "123-45-" + "6789", "date_of_birth": "01/15/1980", "passport": "AB" + "1234567", "driver_license": "D" + "12345678",
        "medical_record": "MRN" + "123456", "diagnosis_code": "ICD10: J45.909", "patient_id": "patient_id: P9", "medical_procedure": "CPT: 99213",
        "aws_access_key": "AK" + "IA" + "ABCDEFGHIJKLMNOP", "jwt": "ey" + "Jhb.eyb.sig", "private_key": "-----BEGIN RSA " + "PRIVATE KEY-----",
    }
    negative = {
        "ssn": "123-456-789", "date_of_birth": "13/45/1980", "passport": "A123456", "driver_license": "D12345", "medical_record": "mr n",
        "diagnosis_code": "ICD11", "patient_id": "patient-id: 7", "medical_procedure": "CPT: 9921", "aws_access_key": "AKIA" + "ABC", "jwt": "eyj.a", "private_key": "BEGIN KEY",
    }
    kinds = list(positive)
    hits = scan.findings_core(files(spark, *[f"x {positive[k]} y" for k in kinds], *[f"x {negative[k]} y" for k in kinds]), "id").collect()
    found = {(r["id"], r["type"]) for r in hits}
    for i, kind in enumerate(kinds):
        assert (i, kind) in found and (i + len(kinds), kind) not in found, kind


def test_user_profile_fixture(spark):
    text = ("email = 'jo" + "@example.com'\nphone = '555-123-" + "4567'\nssn = '123-45-" + "6789'\ncard = '4242-4242-4242-" + "4242'\naddr = '12 Oak Street'\n")
    rows = scan.findings(files(spark, text), "id").collect()
    facts = {(r["type"], r["severity"], r["confidence"], r["regulation"]) for r in rows}
    assert ("email", "MEDIUM", "HIGH", "GDPR") in facts and ("credit_card", "CRITICAL", "HIGH", "PCI-DSS") in facts
    assert ("health_insurance", "HIGH", "MEDIUM", "HIPAA") in facts
    assert all(r["match"].startswith("[REDACTED:") for r in rows)
    assert types_of(spark, "def f():\n    return 1\n") == [] and types_of(spark, "") == []


def test_raw_mode_and_case_option(spark):
    raw = scan.findings(files(spark, "a@b.co"), "id", expose_raw=True).first()
    assert raw["match"] == "a@b.co"
    assert types_of(spark, "ab1234567", types=["passport"]) == ["passport"]
    assert types_of(spark, "ab1234567", types=["passport"], case_sensitive=True) == []


def test_address_is_linear(spark):
    start = time.time()
    assert types_of(spark, "12 " + "a" * 40 + " " + "b" * 20000, types=["address"]) == []
    assert time.time() - start < 20


def test_summary_and_top(spark):
    found = scan.findings(files(spark, "a@b.co 10.0.0.1", "4242424242424242", "none"), "id")
    totals = scan.scan_totals(files(spark, "a@b.co 10.0.0.1", "4242424242424242", "none"), found, "id").first()
    assert (totals["files_scanned"], totals["files_with_findings"]) == (3, 2)
    summary = {(r["dimension"], r["value"]): (r["findings"], r["risk_score"]) for r in scan.scan_summary(found).collect()}
    assert summary[("all", "all")][1] == sum(sp.SEVERITY_WEIGHT[r["severity"]] for r in found.collect())
    assert scan.top_findings(found, ["id", "line", "column"]).filter("severity = 'CRITICAL'").count() == 1


def test_incremental(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, checksum string")
    before = spark.createDataFrame([("a", "1"), ("b", "9")], "path string, checksum string")
    assert sorted(r["path"] for r in scan.incremental_scan(now, "path", "checksum", before).collect()) == ["b", "c"]


def test_maintained_findings_equal_a_full_scan(spark):
    """After adds, changes and deletes; untouched files aren't scanned again."""
    was = [(1, "a@x.example.org"), (2, "b@x.example.org and c@x.example.org"), (3, "nothing"), (4, "d@x.example.org")]
    now = [(1, "a@x.example.org"), (2, "b@x.example.org only"), (3, "now e@x.example.org"), (5, "new f@x.example.org 10.1.2.3")]
    schema = "path long, content string"
    before, after = (spark.createDataFrame(r, schema).withColumn("checksum", F.md5("content")) for r in (was, now))
    found = scan.findings_core(before, "path")
    kept, taken, added = scan.maintain_findings(found, after, "path", "checksum", before.select("path", "checksum"))
    full = scan.findings_core(after, "path")
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, full.collect()))
    assert {r["path"] for r in added.collect()} == {2, 3, 5} and {r["path"] for r in taken.collect()} == {2, 4}
    cells = scan.maintain_cells(scan.summary_cells(found), taken, added)
    assert sorted(map(tuple, cells.collect())) == sorted(map(tuple, scan.summary_cells(full).collect()))
    nothing = scan.maintain_findings(found, before, "path", "checksum", before.select("path", "checksum"))
    assert nothing[1].count() == nothing[2].count() == 0 and nothing[0].count() == found.count()
