import re

import numpy as np

from tests.llm.helpers import ODD, SCHEMA, table
from wardenlake.llm import license_scan as L
from wardenlake.llm.license_rules import BASE, BASE_CONFIDENCE, BASE_PRIORITY, Rule, rules

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RULES = [Rule(label, BASE_PRIORITY, BASE_CONFIDENCE, (), words) for label, words in BASE] + rules()
SOME = [
    "Released under the MIT License.", "MIT license mit LICENSE, mit-license", "Licensed under the Apache License, Version 2.0 (the License)",
    "This work is licensed under the GNU General Public License, version 3 or any later version.", "Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: GPL-3.0-or-later",
    "SPDX-License-Identifier: MIT\nSPDX-License-Identifier: BSD-3-Clause", "mit Lizenz und apache", "Creative Commons Attribution-NonCommercial 4.0 International License",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including the rights to use, copy, modify, merge, publish, distribute, sublicense",
    "GNU Affero General Public License v3", "see https://www.gnu.org/licenses/gpl-3.0.html", "general public\tlicense general public license", "commit license", "mit licenses",
    "Mozilla Public License 2.0; Eclipse Public License - v 2.0; Unlicense; zlib licence", "All rights reserved. Proprietary and confidential.", "mit licénse MİT license", "public domain: released into the public domain",
    "mit license " * 3000,
]


def brute(text):
    found = [w.group() for w in WORD.finditer("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    line = " " + " ".join(found) + " "
    spans = []
    for k, r in enumerate(RULES):
        for m in re.finditer(f"(?<= )(?:{r.expression})(?= )", line):
            spans.append((line[: m.start()].count(" ") - 1, line[: m.end()].count(" "), r, k))
    base = sorted(s[0] for s in spans if s[3] < len(BASE))
    if len(spans) < 1000:
        left = [x for x in spans if not any(y[0] <= x[0] and y[1] >= x[1] and y[2].priority >= x[2].priority and (y[0] < x[0] or y[1] > x[1] or y[2].priority > x[2].priority or y[3] < x[3]) for y in spans)]
    else:
        left = spans
    named = {x[2].label for x in spans if x[3] < len(BASE)}
    return (len(found), len(base), base[0] if base else None, base[-1] if base else None, ",".join(sorted(named)),
            ",".join(sorted(named | {x[2].label for x in left})), max((x[2].confidence for x in left), default=0.0)), [(x[0], x[1], x[2].label) for x in left]


def test_against_python(spark):
    rng = np.random.default_rng(3)
    texts = ODD + SOME + [" filler ".join(SOME[i] for i in rng.integers(0, len(SOME) - 1, 4)) for _ in range(60)]
    docs = table(spark, texts, extra=True)
    scanned = L.scan(docs)
    got = {r["doc_id"]: tuple(r)[1:] for r in L.summary(scanned).collect()}
    want = {i: brute(t) for i, t in enumerate(texts)}
    assert got == {i: w[0] for i, w in want.items()}
    for r in scanned.collect():
        if len(texts[r["doc_id"]] or "") < 5000:
            assert sorted((d["start"], d["end"], d["label"]) for d in r["detections"]) == sorted(want[r["doc_id"]][1])


def test_labels_of_known_lines(spark):
    got = {r["doc_id"]: (r["labels"], r["base_labels"]) for r in L.summary(L.scan(table(spark, SOME[:6]))).collect()}
    assert got == {0: ("mit", "mit"), 1: ("mit", "mit"), 2: ("apache,apache-2.0", "apache"), 3: ("gpl,gpl-3.0-or-later", "gpl"), 4: ("cc-by-nc-4.0", ""), 5: ("gpl-3.0-or-later", "")}


def test_suppression_keeps_overlaps_and_order(spark):
    own = [Rule("long", 1, 0.5, ("a",), "a b c d"), Rule("inside", 1, 0.9, ("a",), "b c"), Rule("above", 2, 0.7, ("a",), "c d"), Rule("across", 1, 0.6, ("a",), "d e"), Rule("twin", 1, 0.9, ("a",), "a b c d"), Rule("never", 3, 1.0, ("z", "a"), "a")]
    row = L.scan(table(spark, ["x a b c d e " * 400]), extra=own, base=()).first()
    assert {d["label"] for d in row["detections"]} == {"long", "above", "across"} and len(row["detections"]) == 1200


def test_repeated_rows_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, SOME[0], None, None, 0), (1, SOME[0], "en", "s", 0), (1, SOME[0], "en", "s", 0)], SCHEMA)
    got = sorted((r["doc_id"] or 0, r["n_base"], r["labels"]) for r in L.summary(L.scan(docs)).collect())
    assert got == [(0, 1, "mit"), (1, 1, "mit"), (1, 1, "mit")]
    assert L.summary(L.scan(docs.limit(0))).count() == 0


def test_no_python_in_the_plan(spark):
    plan = L.summary(L.scan(table(spark, SOME[:2]))).select("labels")._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan and "Exchange" not in plan


def test_there_are_hundreds_of_rules():
    assert len(rules()) >= 300 and len({r.expression for r in rules()}) == len(rules())
