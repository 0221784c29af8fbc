import numpy as np
import pytest

from tests.llm.helpers import ODD, table, words
from wardenlake.llm import hyperminhash as H
from wardenlake.llm.components import components


def brute(texts, size, percent):
    """Components of all pairs of exact shingle sets, by row number."""
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(i, len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


def check(spark, texts, size, percent, **kw):
    got = H.near_duplicates(table(spark, texts, **kw), size=size, percent=percent).drop("mark", "first").collect()
    assert sorted(tuple(r) for r in got) == brute(texts, size, percent)


def mutated(rng, base, changes):
    out = list(base)
    for at in rng.choice(len(out), changes, replace=False):
        out[at] = f"new{rng.integers(1 << 30)}"
    return " ".join(out)


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_against_all_pairs(spark, size, percent):
    rng = np.random.default_rng(size)
    texts = list(ODD)
    for n in (5, 9, 14, 30, 60, 200, 700):
        base = [f"w{rng.integers(5000)}" for _ in range(n)]
        texts += [mutated(rng, base, int(c)) for c in rng.integers(0, max(2, n // 25), 8)]
    texts += [t.upper() for t in texts[-3:]]
    check(spark, texts, size, percent, extra=True)


def test_large_group_in_blocks(spark, monkeypatch):
    """A group whose members mostly reach each other over others, cut into several parts."""
    monkeypatch.setattr(H, "BLOCK_MEMBERS", 10)
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(120)]
    check(spark, [mutated(rng, base, int(c)) for c in rng.integers(1, 7, 90)], 3, 85)


def test_repeated_rows_null_keys_and_empty_table(spark):
    same = table(spark, ["a b c d e"] * 2).union(table(spark, ["a b c d e"])).unionByName(spark.createDataFrame([(None, "a b c d e", "en", "s", 9)], table(spark, []).schema))
    rows = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"], r["kept"]) for r in H.near_duplicates(same, size=3, percent=85).collect())
    assert [r[:2] + (r[3],) for r in rows] == [(False, 0, True), (False, 0, True), (False, 1, False), (True, 0, False)]
    assert H.near_duplicates(table(spark, [])).count() == 0


def test_a_key_with_several_texts(spark):
    """Each text of the key keeps its own links, whichever of its rows comes first."""
    rng = np.random.default_rng(5)
    bases = [[f"w{rng.integers(5000)}" for _ in range(100)] for _ in range(6)]
    rows = [(3, " ".join(b)) for b in bases] + [(10 + i, mutated(rng, b, 1)) for i, b in enumerate(bases)] + [(1, mutated(rng, bases[0], 1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in H.near_duplicates(docs, size=3, percent=85).collect())
    assert got == sorted([(1, 1, True), (3, 1, False)] + [(3, 3, True)] * 5 + [(10, 1, False)] + [(10 + i, 3, False) for i in range(1, 6)])


def test_bands_rarely_miss_and_estimates_hold():
    rng = np.random.default_rng(2)
    for n in (7, 20, 60, 200, 900):
        differ = int(0.15 * n / 0.925)
        one, two = [], []
        for _ in range(300):
            x = rng.integers(0, 1 << 63, n + differ, dtype=np.uint64) * np.uint64(2)
            one.append(x[: n + differ // 2])
            two.append(np.concatenate([x[:n], x[n + differ // 2 :]]))
        rows = [H.registers(s) for s in (one, two)]
        sizes = [np.array([len(x) for x in s]) for s in (one, two)]
        keys = [[set() for _ in one] for _ in range(2)]
        for side in range(2):
            for at, key in zip(*H.band_keys(rows[side], sizes[side], 85)):
                keys[side][at].add(int(key))
        assert all(a & b for a, b in zip(*keys))
        assert H.plausible(*rows, *sizes, 85).all()
        guess, _ = H.estimate(*rows, *sizes)
        assert abs(guess.mean() - n / (n + differ)) < 0.02


def test_collisions_of_strangers():
    """Registers that agree by chance, against sets without a common element."""
    rng = np.random.default_rng(4)
    for small, large in ((20_000, 20_000), (10_000, 40_000)):
        same = 0
        for _ in range(60):
            x = rng.integers(0, 1 << 63, small + large, dtype=np.uint64) * np.uint64(2)
            a, b = H.registers([x[:small], x[small:]])
            same += int((a == b).sum())
        want = 60 * float(H.collisions(np.array([large]), np.array([small]))[0])
        assert abs(same - want) < 4 * np.sqrt(want) + 1
    assert H.collisions(1000.0, 1000.0) == pytest.approx(H.collisions(50.0, 50.0))


def test_strangers_of_a_hub_meet_its_far_members(spark, monkeypatch):
    """Chains of copies away from one text: links between members whom the hub doesn't link with."""
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(200)]
    texts, row = [" ".join(base)], list(base)
    for step in range(12):
        for at in range(step * 9, step * 9 + 9):
            row[at] = f"s{step}x{at}"
        texts.append(" ".join(row))
    texts += [mutated(rng, base, 1) for _ in range(30)] + [" ".join(base[:100] + [f"q{i}x{j}" for j in range(100)]) for i in range(5)]
    monkeypatch.setattr(H, "BLOCK_MEMBERS", 7)
    check(spark, texts, 3, 85)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (3, 1), (2, 1), (None, 4), (10, 8)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 10: 8} | {100 + i: 100 for i in range(31)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
