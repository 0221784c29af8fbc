from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import ODD, SCHEMA
from wardenlake.llm import filter_audit as A


def test_swaps_lead_through_all_orders():
    for n in range(1, 6):
        order, seen = list(range(n)), {tuple(range(n))}
        for at in A.plain_changes(n):
            order[at], order[at + 1] = order[at + 1], order[at]
            seen.add(tuple(order))
        assert seen == set(permutations(range(n))) and len(list(A.plain_changes(n))) == len(seen) - 1


def simulate(rows, letters, extra):
    """Every order applied to (failed letters, *extra flags) document by document."""
    out, shapley = {}, dict.fromkeys(letters, 0)
    for order in permutations(letters):
        left = list(rows)
        for k, f in enumerate(order):
            gone = [r for r in left if f in r[0]]
            left = [r for r in left if f not in r[0]]
            shapley[f] += len(gone)
            out["".join(order), k + 1] = [len(left), len(gone), sum(f in r[0] for r in rows) - len(gone), sum(r[0] == {f} for r in rows), *(sum(r[1 + x] for r in gone) for x in range(extra))]
    return {k: (*v, shapley[k[0][k[1] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("filters", [1, 3, 5])
def test_diagrams_against_every_order(filters):
    rng = np.random.default_rng(filters)
    letters = "ABCDE"[:filters]
    rows = [({f for f in letters if rng.random() < 0.3}, bool(rng.random() < 0.5)) for _ in range(300)]
    counts = {}
    for failed, flag in rows:
        m = sum(1 << letters.index(f) for f in failed)
        a, b = counts.get(m, (0, 0))
        counts[m] = (a + 1, b + flag)
    got = {("".join(letters[f] for f in order), step): (kept, removed[0], redundant, alone, removed[1], shapley) for order, step, kept, removed, redundant, alone, shapley in A.audit_counts(counts, filters, 2)}
    assert got == simulate(rows, letters, 1)


def test_a_diagram_shares_nodes():
    diagram = A.Diagram({0: (7,)}, 5, 1)
    assert len(diagram.weight) == 2 + 9  # two leaves; the all-pass node of each level and an empty one beside all but the root
    for level in A.plain_changes(5):
        diagram.swap(level)
    assert len(diagram.weight) == 11 and diagram.path()[-1][1] == (7,)


def conditions(text, smaller):
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = set()
    if len(words) < 100:
        out.add("A")
    if 100 * len(set(words)) < 80 * len(words):
        out.add("B")
    if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text):
        out.add("C")
    if any(c in "#$%&*|" for c in text):
        out.add("D")
    if smaller:
        out.add("E")
    return out


def test_text_filters_and_audit(spark):
    rng = np.random.default_rng(8)
    texts = list(ODD) + ["SHOUT A LOT", "50% off", "x y " * 60, "€ Ünï 👍 ABC", " ".join(f"w{i}" for i in range(120))] * 2 + ["".join(rng.choice(list("ab A#")) for _ in range(int(n))) for n in rng.integers(0, 40, 60)]
    rows = [(i, t, [None, "", "en", "de"][i % 4], "s", 1) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 1), (None, "one", "fr", "s", 1), (None, "one", "fr", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "part", "digest", "A", "good", "mask", "is_first"):
        docs = docs.withColumn(name, F.lit("clash"))
    labels = [(i, int(rng.integers(0, 2)), int(rng.integers(0, 2))) for i in range(0, 70, 2)] + [(0, 1, 1), (0, None, 0), (None, 1, 1), (2, 0, 0)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    want = {}
    for i, t, lang, *_ in rows:
        good, toxic = (any(x[k] == 1 for x in labels if x[0] == i and i is not None) for k in (1, 2))
        want.setdefault(lang or "", []).append((conditions(t or "", i is not None and least[t or ""] < i), good, toxic))
    got = {}
    for r in A.audit(A.text_filters(docs, known), {f: f for f in "ABCDE"}, lost={"good_lost": "good", "toxic_lost": "toxic"}).collect():
        got.setdefault(r["part"], {})[r["filter_order"], r["step"]] = tuple(r)[3:]
    assert got.keys() == want.keys() == {"", "en", "de", "fr"}
    for part, rows_ in want.items():
        assert got[part] == simulate(rows_, "ABCDE", 2)


def test_empty_table_and_too_many_filters(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    flagged = A.text_filters(docs, labels)
    assert A.audit(flagged, {"A": "A"}).count() == 0
    with pytest.raises(ValueError):
        A.audit(flagged, {str(k): "A" for k in range(8)})
