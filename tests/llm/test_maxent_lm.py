import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import ODD, table, words
from wardenlake.llm import maxent_lm as M

TEXTS = [f"the cat number {i} sat on the mat {i % 7}" for i in range(120)] + [f"ein hund {i} lief in den wald {i % 5}" for i in range(120)]


def brute_base(train, texts):
    counts = Counter(w for t in train for w in [*words(t), None])
    total, vocabulary = sum(counts.values()), len(counts)
    out = []
    for t in texts:
        own = [*words(t), None]
        out.append((len(own), sum(w in counts for w in own), total, sum(math.log10((counts[w] + 1) / (total + vocabulary + 1)) for w in own)))
    return out


@pytest.mark.parametrize("known", [1 << 19, 40])
def test_counts_and_base(spark, monkeypatch, known):
    """The same result whether words meet their counts in the task or in the join."""
    monkeypatch.setattr(M, "KNOWN_WORDS", known)
    texts = [*TEXTS, *ODD]
    model = M.train(table(spark, texts), F.col("doc_id") % 3 != 0)
    asked = table(spark, [*texts, "never seen words"], extra=True)
    rows = {r["doc_id"]: r for r in M.score(asked, model).collect()}
    want = brute_base([t for i, t in enumerate(texts) if i % 3], [*texts, "never seen words"])
    for i, (n, seen, total, base) in enumerate(want):
        r = rows[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, seen, total) and abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
        assert np.isfinite(r["score"]) and r["score"] < 0
    assert rows[len(texts) - 1]["score"] == rows[len(texts) - 2]["score"]
    held = [i for i in range(len(TEXTS)) if i % 3 == 0]
    assert sum(rows[i]["score"] for i in held) > sum(rows[i]["base_score"] for i in held)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 50, M.HEAD)
    model = M.MaxEnt.start(counts, 77)
    model.class_rows += rng.normal(size=model.class_rows.shape).astype(np.float32)
    model.member_rows += rng.normal(size=model.member_rows.shape).astype(np.float32)
    before = np.array([5, -1], np.int64)
    total = 0.0
    for token in range(-1, M.HEAD):
        tokens = M.Tokens(np.array([1, 2, 3], np.uint64), np.array([0, 3]), np.append(before, token))
        total += np.exp(model.log_probabilities(tokens)[2])
    assert abs(total - 1) < 1e-4


def test_learning_lowers_the_loss():
    rng = np.random.default_rng(1)
    head = np.where(rng.random(60_000) < 0.1, -1, 0)
    for i in range(1, len(head)):
        head[i] = (head[i - 1] * 7 + 3) % 50 if head[i] == 0 else -1
    tokens = M.Tokens(rng.integers(1, 1 << 62, len(head), dtype=np.uint64), np.array([0, len(head)]), head)
    trainer = M.Trainer(M.MaxEnt.start(np.bincount(head[head >= 0], minlength=M.HEAD), int((head < 0).sum())))
    before = trainer.model.log_probabilities(tokens).sum()
    trainer.learn(tokens)
    assert trainer.model.log_probabilities(tokens).sum() > 0.6 * before
    assert sum(len(n) for n, _, _ in trainer.changes()) > 0


def test_nothing_to_learn_from(spark):
    model = M.train(table(spark, ["a b"]), F.lit(False))
    row = M.score(table(spark, ["a b"]), model).first()
    assert row["n_tokens"] == 3 and row["n_known"] == 0 and row["base_score"] == 0.0 and np.isfinite(row["score"])
    assert M.score(table(spark, []), model).count() == 0


def plain_score(model, counts, text):
    """log10 of the probability of a text, token by token, from the trained weights."""
    head = {h: i for i, h in enumerate(model.known[: M.HEAD].tolist())}
    w, before, total = model.weights, [M._START, M._START], 0.0
    for h in M.token_hashes(pa.array([text or ""]))[0].tolist():
        one, two = before[-1], before[-2]
        rows = [one, M._CONTEXTS + two, 2 * M._CONTEXTS + ((one * 1_000_003 + two) * 2_654_435_761 >> 11) % M.PAIR_ROWS]
        scores = [float(w.class_bias[c]) + sum(float(w.class_rows[r][c]) for r in rows) for c in range(M.CLASSES + 1)]
        own = head.get(h)
        of = M.CLASSES if own is None else own // M.MEMBERS
        total += scores[of] - math.log(sum(map(math.exp, scores)))
        if own is None:
            total += math.log((counts.get(h, 0) + 1) / model.tail_total)
        else:
            places = [((r * 2_246_822_519 + of * 3_266_489_917) >> 7) % M.MEMBER_ROWS for r in rows]
            scores = [float(w.member_bias[of][m]) + sum(float(w.member_rows[r][m]) for r in places) for m in range(M.MEMBERS)]
            total += scores[own % M.MEMBERS] - math.log(sum(map(math.exp, scores)))
        before.append(M.HEAD + (h >> 20 & (M.TAIL_ROWS - 1)) if own is None else own)
    return total / math.log(10)


@pytest.mark.parametrize("known", [1 << 19, 1050])
def test_score_against_a_plain_version(spark, monkeypatch, known):
    """Head and tail words, words that only the join knows and unseen ones."""
    monkeypatch.setattr(M, "KNOWN_WORDS", known)
    texts = [*TEXTS, *(f"the cat saw thing{i} and thing{i // 2} on the mat" for i in range(1500))]
    model = M.train(table(spark, texts), F.col("doc_id") % 5 != 0)
    counts = {r["hash"] % (1 << 64): r["c"] for r in model.counts.collect()}
    asked = [*texts[:5], *texts[-8:], "the cat saw nothing1 known", "", None, "thing3 thing4 thing5 the cat"]
    got = {r["doc_id"]: r["score"] for r in M.score(table(spark, asked), model).collect()}
    for i, text in enumerate(asked):
        want = plain_score(model, counts, text)
        assert abs(got[i] - want) < 1e-3 * max(1, abs(want))
