import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.helpers import ODD, table
from wardenlake.llm import language_id as L
from wardenlake.llm.common import arrow_bytes

ENGLISH = ["the cat sat on the mat and then it slept", "there is nothing that they want from the others", "this thing is what the other one had"] * 5
GERMAN = ["die katze und der hund schlafen auf dem boden", "nichts ist so schwer wie ein guter anfang", "ich weiss nicht was soll es bedeuten"] * 5


def small_model():
    trees = []
    for texts in (ENGLISH, GERMAN):
        data, offsets = arrow_bytes(pa.array(texts))
        seen, times = np.unique(L.grams(data, offsets, 0, len(data)), return_counts=True)
        trees.append((L.ContextTree(seen, times), seen))
    return L.LanguageModel(["en", "de"], [t for t, _ in trees]).lay_out(np.concatenate([s for _, s in trees]))


def test_code_lengths_are_a_code():
    """After any context the probabilities of all 256 bytes sum to one."""
    model = small_model()
    for context in (b"the ", b" und", b"zzzz", b"\x00\xff\x00\xff", b"qthe", b"xxe "):
        base = np.uint64(int.from_bytes(context, "big") << 8)
        for tree in model.trees:
            assert abs(np.exp2(-tree.bits(base | np.arange(256, dtype=np.uint64))).sum() - 1) < 1e-9


def naive_bits(texts, text):
    """Prediction by partial matching with exclusion, from dictionaries."""
    counts = {}
    for t in texts:
        raw = b"\n" * L.ORDER + t.encode()
        for i in range(L.ORDER, len(raw)):
            for k in range(L.ORDER + 1):
                counts.setdefault(raw[i - k : i], {}).setdefault(raw[i], 0)
                counts[raw[i - k : i]][raw[i]] += 1
    raw, total = b"\n" * L.ORDER + text.encode(), 0.0
    for i in range(L.ORDER, len(raw)):
        out = set()
        for k in range(L.ORDER, -1, -1):
            seen = {s: n for s, n in counts.get(raw[i - k : i], {}).items() if s not in out}
            if not seen:
                continue
            whole = sum(seen.values()) + len(seen)
            if raw[i] in seen:
                total -= np.log2(seen[raw[i]] / whole)
                break
            total -= np.log2(len(seen) / whole)
            out |= set(seen)
        else:
            total += np.log2(256 - len(out))
    return total


def test_bits_match_plain_version(monkeypatch):
    model = small_model()
    texts = ["the dog", "und nicht", "", "qqq!", "Ünï", "a", "the cat sat on the mat and then it slept again"]
    want = [[naive_bits(own, t) for own in (ENGLISH, GERMAN)] for t in texts]
    for block in (1 << 19, 3):
        monkeypatch.setattr(L, "BLOCK", block)
        got = model.code_lengths(*arrow_bytes(pa.array(texts))) / L.UNIT
        assert np.abs(got - want).max() < 0.01


def test_identify(spark):
    texts = [*ENGLISH, *GERMAN]
    langs = ["en"] * len(ENGLISH) + ["de"] * len(GERMAN)
    model = L.train(table(spark, texts, langs), F.lit(True))
    assert model.languages == ["de", "en"]
    asked = table(spark, ["the other cat had nothing", "der hund ist nicht auf dem boden", *ODD], extra=True)
    rows = {r["doc_id"]: r for r in L.identify(asked, model).collect()}
    assert rows[0]["lang_pred"] == "en" and rows[1]["lang_pred"] == "de" and rows[0]["source"] == "s"
    assert [rows[i]["lang_pred"] for i in range(2, 6)] == ["und"] * 4 and rows[2]["score"] == 0.0 and rows[2]["bits"] is None
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert rows[10]["bits"] == rows[11]["bits"]  # repeated rows


def test_no_training_rows(spark):
    model = L.train(table(spark, ["abc", None], [None, "en"]), F.lit(True))
    assert [r["lang_pred"] for r in L.identify(table(spark, ["abc"]), model).collect()] == ["und"]
    assert L.identify(table(spark, []), model).count() == 0


def test_held_out_accuracy(spark):
    from wardenlake.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null")
    out = QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01").where("held_out and lang_pred <> 'und'").join(docs, "doc_id")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
