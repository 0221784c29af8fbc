import numpy as np
import pytest
from pyspark.sql import functions as F

from wardenlake.llm import vector_links as L
from wardenlake.llm import vector_search as S
from wardenlake.llm.pruned_graph import prune

SCHEMA = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")
ODD = [(9001, None, 1), (9002, [], 1), (9003, [0.0] * 8, 1), (9004, [NAN] + [1.0] * 7, 1), (9005, [INF] + [1.0] * 7, 1), (9006, [None] + [1.0] * 7, 1), (9007, [1.0] * 8, None), (9008, [1.0] * 5, 1)]


def vectors(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash")).withColumn("rank", F.lit(0)).withColumn("id", F.lit("clash")).withColumn("v", F.lit("clash"))


def some(n, seed, labels=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 8)).astype(np.float32)
    near = rng.random(n) < 0.4
    for i in np.flatnonzero(near)[1:]:
        base[i] = base[rng.integers(0, i)] + rng.normal(size=8) * 0.1
    return [(i, v.tolist(), int(rng.integers(0, labels))) for i, v in enumerate(base)]


def brute_links(rows, threshold):
    good = [(i, np.array(v, np.float32).astype(float), l) for i, v, l in rows if v and l is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = {i: set() for i, *_ in rows}
    for a, (i, v, l) in enumerate(good):
        for j, w, m in good[:a]:
            if l == m and len(v) == len(w) and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= threshold:
                links[i].add(j)
                links[j].add(i)
    root = {}
    for i in sorted(links):
        if i not in root:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in root:
                    root[x] = i
                    todo += links[x]
    return {i: (len(links[i]), root[i], root[i] == i) for i in links}


@pytest.mark.parametrize("part_rows,cluster_rows", [(2000, 2000), (60, 150)])
def test_links_against_all_pairs(spark, monkeypatch, part_rows, cluster_rows):
    monkeypatch.setattr(L, "PART_ROWS", part_rows)
    monkeypatch.setattr(L, "CLUSTER_ROWS", cluster_rows)
    rows = some(400, 1) + ODD + [(5000 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0], 2) for i in range(30)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in L.near_duplicates(vectors(spark, rows), threshold=0.93).collect()}
    want = brute_links(rows, 0.93)
    assert got.keys() == want.keys()
    assert sum(g[0] for g in got.values()) >= 0.99 * sum(w[0] for w in want.values())
    assert all(got[i][0] <= want[i][0] for i in got)
    assert np.mean([got[i][1:] == want[i][1:] for i in got]) > 0.99
    assert all(got[i] == (0, i, True) for i, *_ in ODD)


def test_links_of_repeated_rows_and_empty_tables(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (None, [1.0, 0.0], 1)]
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in L.near_duplicates(vectors(spark, rows)).collect())
    assert got == [(0, 0, 0, False), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]
    assert L.near_duplicates(vectors(spark, [])).count() == 0


def test_graph_search_finds_a_dense_ball():
    """Range search in the united graph, before any audit: a dense ball, pairs and chains."""
    rng = np.random.default_rng(3)
    ball = np.ones(16) + rng.normal(size=(700, 16)) * 0.05
    alone = rng.normal(size=(900, 16))
    twins = alone[:300] + rng.normal(size=(300, 16)) * 0.05
    v = np.concatenate([ball, alone, twins])[rng.permutation(1900)]
    want = {tuple(p) for p in L.pairs_within(v, 0.93).T}
    got = {tuple(p) for p in L.graph_pairs(v, np.arange(len(v)), None, 0.93).T}
    assert got <= want and len(got) >= 0.99 * len(want)
    left, right = np.arange(0, 1900, 2), np.arange(1, 1900, 2)
    across = {tuple(sorted(p)) for p in L.graph_pairs(v, left, right, 0.93).T}
    wanted = {p for p in want if (p[0] + p[1]) % 2}
    assert across <= wanted and len(across) >= 0.99 * len(wanted)


def test_the_audit_falls_back_to_the_block_product(monkeypatch):
    """Where the graph finds nothing, the audited members show it and the cell is compared whole."""
    rng = np.random.default_rng(4)
    v = np.repeat(rng.normal(size=(150, 8)), 2, axis=0) + rng.normal(size=(300, 8)) * 0.01
    whole = L.pairs_within(v, 0.93)
    blocks, audited, missed = L.audited_pairs(v, np.arange(300), np.arange(300), None, 0.93)
    assert missed == 0 and audited > 0
    monkeypatch.setattr(L, "graph_pairs", lambda *_: np.empty((2, 0), np.int64))
    blocks, audited, missed = L.audited_pairs(v, np.arange(300), np.arange(300), None, 0.93)
    assert missed == audited > 0
    assert sorted(map(tuple, np.concatenate([np.stack(b) for b in blocks], axis=1).T)) == sorted(map(tuple, whole.T))


def test_audited_recall_and_many_labels(spark, monkeypatch):
    monkeypatch.setattr(L, "PART_ROWS", 700)
    monkeypatch.setattr(L, "CLUSTER_ROWS", 700)
    rows = some(1500, 21, labels=400)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in L.near_duplicates(vectors(spark, rows), threshold=0.93).collect()}
    assert got == brute_links(rows, 0.93)
    classes = vectors(spark, some(3000, 22, labels=1)).selectExpr("vec_id AS id", "label", "1L AS times", "cast(embedding AS array<double>) AS v")
    row = L.audit(L.cell_links(classes, 0.93)).first()
    assert row["cells"] > 1 and row["audited"] > 0 and row["missed"] <= 0.1 * row["audited"]


def brute_nearest(rows, k):
    good = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q in good:
        if q % 20 == 0:
            scored = sorted((-float(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


@pytest.mark.parametrize("shard_rows", [6000, 250])
def test_search_recall_and_scores(spark, shard_rows):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=8) * rng.uniform(0.5, 2)).tolist(), 1) for i in range(900)] + ODD + [(10_000 + i, [3.0] * 8, 1) for i in range(40)]
    got = {}
    for r in S.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, shard_rows=shard_rows).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute_nearest(rows, 20)
    assert got.keys() == want.keys()
    hits = []
    for q, found in got.items():
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        hits.append(len({f[1] for f in found} & {w[0] for w in want[q]}) / 20)
    assert np.mean(hits) > 0.95
    assert [f[1] for f in got[10_000]] == [w[0] for w in want[10_000]]  # ties to the smaller id


def test_search_in_small_and_empty_tables(spark):
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (1, [0.5, 0.5], 1), (2, [-1.0, 0.0], 1), (None, [9.0, 9.0], 1)]
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in S.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0).collect()]
    assert sorted(got) == [(0, 1, 1, 1.5), (0, 2, 2, -1.0)]
    assert S.nearest(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0


def test_pruning_keeps_diverse_neighbours():
    points = np.array([[0, 0], [1, 0], [1.1, 0], [0, 1.5], [-3, 0]], np.float32)
    assert prune(np.array([0]), np.array([[4, 2, 3, 1, 1]], np.int32), points, 4, 1.0)[0].tolist() == [1, 3, 4, -1]


def test_no_link_is_lost_between_many_pivots(spark, monkeypatch):
    """Partners at a cosine just above the threshold, in 64 dimensions, with a pivot for each 20 of them."""
    monkeypatch.setattr(L, "PART_ROWS", 40)
    monkeypatch.setattr(L, "CLUSTER_ROWS", 20)
    rng = np.random.default_rng(11)
    one = rng.normal(size=(300, 64))
    one /= np.sqrt((one**2).sum(axis=1))[:, None]
    off = rng.normal(size=(300, 64))
    off -= (off * one).sum(axis=1)[:, None] * one
    two = 0.931 * one + np.sqrt(1 - 0.931**2) * off / np.sqrt((off**2).sum(axis=1))[:, None]
    rows = [(i, v.tolist(), int(i % 300 < 250)) for i, v in enumerate(np.concatenate([one, two]))]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in L.near_duplicates(vectors(spark, rows), threshold=0.93).collect()}
    assert got == brute_links(rows, 0.93)


def test_clustered_vectors_visit_few_pivots():
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(20, 16))
    home, guests = L.homes_and_guests([centres[i % 20] + rng.normal(size=16) * 0.05 for i in range(200)] + [np.ones(3)], np.full(201, 20), list(centres), 0.93)
    assert home[:200].tolist() == [i % 20 for i in range(200)] and home[200] == 0 and len(guests[200]) == 0
    assert sum(map(len, guests)) < 0.2 * 200 * 20


def test_a_cell_misses_nothing():
    """Many loose chains of links in one cell; and two sides of a cell."""
    rng = np.random.default_rng(13)
    v = rng.normal(size=(1500, 12))
    for i in range(1, 1500):
        if i % 5:
            v[i] = v[i - 1] + rng.normal(size=12) * 0.25
    unit = v / np.sqrt((v**2).sum(axis=1))[:, None]
    want = np.stack(np.nonzero(np.triu(unit @ unit.T >= 0.93, 1)))
    assert sorted(map(tuple, L.pairs_within(v, 0.93).T)) == sorted(map(tuple, want.T))
    left, right = np.arange(0, 1500, 2), np.arange(1, 1500, 2)
    got = [tuple(sorted(p)) for i, j in L.blocks_within(v, left, right, 0.93) for p in zip(i, j)]
    assert sorted(got) == sorted(tuple(p) for p in want.T if (p[0] + p[1]) % 2)
