"""Ranked search against counting every pair, with words that most chunks hold."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from wardenlake.operators import retrieval as rt


def corpus(seed, n=300):
    rng = random.Random(seed)
    rare = [f"rare{i:03d}" for i in range(200)]
    texts = []
    for i in range(n):
        words = ["common", "usual"] + [f"often{j}" for j in range(6) if rng.random() < 0.6] + rng.sample(rare, rng.randint(0, 6))
        rng.shuffle(words)
        texts.append((f"chunk_{i:05d}", ["documentation", "code_example", "general"][i % 3], " ".join(words) + " pad" * (60 * (i % 2))))
    asked = [(q, " ".join(rng.sample(rare, rng.randint(0, 5)) + rng.sample(["common", "usual", *[f"often{j}" for j in range(6)]], rng.randint(0, 5)))) for q in range(40)]
    return texts, [*asked, (100, "common"), (101, "nowhere else"), (102, ""), (103, texts[7][2][:40]), (104, "common usual often0 often1 often2 often3 often4 often5")]


def words(text):
    return {w for w in text.lower().split() if len(w) > 2 and w not in rt.STOP_WORDS}


@pytest.mark.parametrize("seed", [1, 2])
def test_keyword_search(spark, seed):
    texts, asked = corpus(seed)
    chunks = spark.createDataFrame(texts, "chunk_id string, chunk_type string, content string")
    queries = spark.createDataFrame(asked, "query_id long, text string")
    index = rt.postings(chunks)
    for kind, forward in ((None, None), ("general", rt.forward_index(chunks))):
        want = set()
        for q, text in asked:
            found = sorted((-len(words(text) & words(t)), c) for c, d, t in texts if words(text) & words(t) and (kind is None or d == kind))
            want |= {(q, c, -n, r + 1) for r, (n, c) in enumerate(found[:10])}
        got = {(r["query_id"], r["chunk_id"], r["hits"], r["rank"]) for r in rt.keyword_search(queries, index, kind, forward=forward).collect()}
        assert got == want


@pytest.mark.parametrize("recent", [False, True])
def test_scored_retrieval(spark, recent):
    texts, asked = corpus(3)
    chunks = spark.createDataFrame(texts, "chunk_id string, chunk_type string, content string").withColumn("char_count", F.length("content"))
    chunks = chunks.withColumn("recency", F.crc32(F.col("chunk_id").cast("binary")) % 9)
    fresh = {r["chunk_id"]: r["recency"] for r in chunks.collect()} if recent else {}
    queries = spark.createDataFrame(asked, "query_id long, text string")
    want = set()
    for q, text in asked:
        found = []
        for c, d, t in texts:
            if n := len(words(text) & words(t)):
                found.append((-(2 * n + {"documentation": 3, "code_example": 2}.get(d, 0) + (200 <= len(t) <= 1000) + 10 * (text.lower() in t.lower()) + fresh.get(c, 0)), c))
        want |= {(q, c, -s, r + 1) for r, (s, c) in enumerate(sorted(found)[:5])}
    got = {(r["query_id"], r["chunk_id"], r["score"], r["rank"]) for r in rt.scored_retrieval(queries, chunks, rt.postings(chunks), recency="recency" if recent else None).collect()}
    assert got == want


def test_common_words_are_not_matched(spark):
    """A word in every chunk brings no candidates beside the first ones where rarer words decide."""
    texts = [(f"chunk_{i:05d}", "general", "common usual " + ("topic special subject" if i % 40 == 0 else "filler")) for i in range(2000)]
    chunks = spark.createDataFrame(texts, "chunk_id string, chunk_type string, content string")
    index = rt.postings(chunks)
    terms = rt._by_rarity(rt.query_terms(spark.createDataFrame([(1, "common usual topic special subject")], "query_id long, text string")), index)
    first = rt._top(rt._with_hits(rt._champions(terms, index, 10), terms, rt._grouped(index)), 10, "hits")
    assert [r["hits"] for r in first.collect()] == [5] * 10
    needed = terms.filter(F.col("_place") <= 1).select("query_id", "keyword", F.lit("chunk_00360").alias("_before"))
    assert rt._matching(needed, index, 8).count() == 9  # ties with smaller ids only


def test_patterns_of_a_table(spark):
    """Literals of every length, in texts with odd characters, repeated rows and missing values, against a plain search."""
    rng = random.Random(5)
    alphabet = "abé ß\n漢x"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 400))) for _ in range(120)]
    rows = [*enumerate(texts), (3, texts[3]), (3, texts[4]), (500, None), (501, "")]
    literals = [t[a : a + n] for t in texts[:60] for n in (1, 2, 3, 5, 9, 14, 40) for a in [rng.randint(0, 50)]] + ["never there", "zz", "q", "a long literal that no text has"]
    listed = [*enumerate(literals), (0, literals[0]), (9000, ""), (9001, None)]
    files = spark.createDataFrame(rows, "id long, content string")
    patterns = spark.createDataFrame(listed, "pattern_id long, literal string")
    want = sorted((k, p) for k, t in rows if t for p, w in {(p, w) for p, w in listed if w} if w in t)
    assert sorted((r["id"], r["pattern_id"]) for r in rt.match_patterns(files, "id", patterns).collect()) == want
    assert rt.match_patterns(files, "id", patterns.limit(0)).count() == 0 and rt.match_patterns(files.limit(0), "id", patterns).count() == 0


def test_stored_index(spark, tmp_path):
    """Folders without a changed keyword keep their files; rows are those of a new index."""
    texts, _ = corpus(4, 60)
    chunks = spark.createDataFrame(texts, "chunk_id string, chunk_type string, content string")
    path = str(tmp_path / "index")
    rt.store_index(rt.postings(chunks), path, 16)
    files = lambda: {p.parent.name: sorted(f.name for f in p.parent.glob("*.parquet")) for p in (tmp_path / "index").glob("part=*/*.parquet")}
    first = files()
    old = chunks.filter("chunk_id IN ('chunk_00003', 'chunk_00004')")
    new = old.filter("chunk_id = 'chunk_00003'").withColumn("content", F.concat("content", F.lit(" brandnewword")))
    touched = rt.update_stored_index(spark, path, old, new, 16)
    want = rt.postings(chunks.join(old, "chunk_id", "left_anti").unionByName(new))
    rows = lambda frame: sorted(tuple(r) for r in frame.select("chunk_id", "chunk_type", "keyword").collect())
    assert rows(rt.read_index(spark, path)) == rows(want)
    second = files()
    assert 0 < len(touched) < 16 and {p for p in first if first[p] != second.get(p)} <= {f"part={n}" for n in touched}
    asked = spark.createDataFrame([("brandnewword",), ("common",), ("nowhere",)], "keyword string")
    assert rows(rt.stored_postings(spark, path, asked, 16)) == rows(want.join(asked, "keyword", "left_semi"))
    assert rt.update_stored_index(spark, path, new, new, 16) == [] and files() == second


def test_knowledge_queries_read_their_own_patterns(spark, tmp_path):
    """The table of literals and the knowledge patterns are different inputs."""
    from wardenlake.plans import retrieval_queries as rq

    spark.createDataFrame([(1, "Big Bolt", "STEEL", 3), (2, "nut", "small bolt", 4), (3, "washer", "TIN", 5)],
                          "p_partkey long, p_name string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(7, "s7", 0, -1.0), (8, "s8", 1, 5.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    advice = sorted(tuple(r) for r in rq.knowledge_recommendations(spark, str(tmp_path)).collect())
    assert advice == [(1, "Big Bolt", "HIGH", "pattern"), (7, "s7", "HIGH", "best_practice")]
    assert rq.knowledge_statistics(spark, str(tmp_path)).first().asDict() == {
        "total_patterns": 3, "migration_types_covered": 3, "total_practices": 2, "categories_covered": 2}
    assert sorted(r["pattern_id"] for r in rq.pattern_search(spark, str(tmp_path)).collect()) == [1, 2]


def test_literals_with_a_long_common_beginning_wait_apart(spark):
    """Each text meets few literals besides those it holds, however much the literals have in common."""
    import pyarrow as pa

    beginning = 'componentDidMount() { fetch("/api/user/'
    literals = [f"{beginning}{10000 + i}" for i in range(300)]
    sizes = {int(rt.GRAM_SIZES[rt.GRAM_SIZES <= len(w)].max()) for w in literals}
    assert len(sizes) == 1
    row, gram = rt._grams(pa.array(literals), sizes)
    held = {}
    for r, g in zip(row.tolist(), gram.tolist()):
        held.setdefault(g, set()).add(r)
    least = {}
    for g, rows in held.items():
        for r in rows:
            least[r] = min(least.get(r, 999), len(rows))
    assert set(least.values()) == {1}
    files = spark.createDataFrame([(i, f"x {w}") for i, w in enumerate(literals)], "id long, content string")
    patterns = spark.createDataFrame(list(enumerate(literals)), "pattern_id long, literal string")
    assert sorted(tuple(r) for r in rt.match_patterns(files, "id", patterns).collect()) == [(i, i) for i in range(300)]


def test_typed_queries_match_chunks_of_their_type(spark):
    """A query for one type has the bound, the keywords and the candidates of that type, and the same results."""
    texts, asked = corpus(6)
    kinds = ["documentation", "code_example", "troubleshooting"]
    texts = [(c, kinds[i % 3], t) for i, (c, _, t) in enumerate(texts)] + [(f"chunk_9{i:04d}", "documentation", "onlyhere common usual") for i in range(50)]
    chunks = spark.createDataFrame(texts, "chunk_id string, chunk_type string, content string").withColumn("char_count", F.length("content"))
    intents = ["code_help", "troubleshoot", "explain", None]
    rows = [(q, f"{t} onlyhere", intents[q % 4]) for q, t in asked]
    queries = spark.createDataFrame(rows, "query_id long, text string, intent string")
    index = rt.postings(chunks)
    want = set()
    for q, text, intent in rows:
        kind, found = rt.INTENT_CHUNK_TYPE.get(intent), []
        for c, d, t in texts:
            if (n := len(words(text) & words(t))) and kind in (None, d):
                found.append((-(2 * n + {"documentation": 3, "code_example": 2}.get(d, 0) + (200 <= len(t) <= 1000) + 10 * (text.lower() in t.lower())), c))
        want |= {(q, c, -s, r + 1) for r, (s, c) in enumerate(sorted(found)[:5])}
    got = {(r["query_id"], r["chunk_id"], r["score"], r["rank"]) for r in rt.scored_retrieval(queries, chunks, index).collect()}
    assert got == want
    terms = spark.createDataFrame([(1, "onlyhere", "code_example"), (1, "common", "code_example"), (2, "onlyhere", None)], "query_id long, keyword string, _type string")
    held = rt._by_rarity(terms, index)
    assert {(r["query_id"], r["keyword"], r["_place"], r["_words"]) for r in held.collect()} == {(1, "common", 1, 1), (2, "onlyhere", 1, 1)}
    typed = {c for c, d, _ in texts if d == "code_example"}
    for pairs in (rt._champions(held, index, 5), rt._matching(held.select("query_id", "keyword", "_type"), index, 8)):
        met = [(r["query_id"], r["chunk_id"]) for r in pairs.collect()]
        assert {c for q, c in met if q == 1} <= typed and {q for q, _ in met} == {1, 2}


def test_short_lists_of_keywords_leave_postings_where_they_are(spark, monkeypatch):
    """Only a long list of asked keywords makes the postings move."""
    chunks = spark.createDataFrame(corpus(7, 40)[0], "chunk_id string, chunk_type string, content string")
    terms = spark.createDataFrame([(1, "common"), (1, "rare003"), (2, "common")], "query_id long, keyword string")
    index, found = rt.postings(chunks, unique_sources=True), []
    for limit in (500, 0):
        monkeypatch.setattr(rt, "ASKED_ROWS", limit)
        listed = rt._asked(index, terms)
        found.append(sorted(tuple(r) for r in listed.collect()))
        assert limit == 0 or "Exchange hashpartitioning" not in listed._jdf.queryExecution().executedPlan().toString()
    assert found[0] == found[1] and {r[0] for r in found[0]} == {"common", "rare003"}


def test_an_update_moves_the_stored_rows_once(spark, tmp_path, monkeypatch):
    """The rows of touched folders aren't written to the checkpoint folder on the way; repeated rows and rows with nulls stay."""
    path = str(tmp_path / "index")
    rows = [("a", "t", "one"), ("a", "t", "two"), ("b", "t", "one"), ("b", "t", "one"), (None, "t", "one"), ("c", None, "one")]
    index = spark.createDataFrame(rows, "chunk_id string, chunk_type string, keyword string")
    rt.store_index(index, path, 1)
    kept, cut = [], rt.cut_lineage
    monkeypatch.setattr(rt, "cut_lineage", lambda df: kept.append(cut(df)) or kept[-1])
    old = spark.createDataFrame([("a", "t", "one two"), (None, "t", "one")], "chunk_id string, chunk_type string, content string")
    new = spark.createDataFrame([("a", "t", "two three")], old.schema)
    assert rt.update_stored_index(spark, path, old, new, 1) == [0]
    assert sorted(map(str, rt.read_index(spark, path).collect())) == sorted(map(str, spark.createDataFrame(
        [("a", "t", "two"), ("a", "t", "three"), ("b", "t", "one"), ("b", "t", "one"), (None, "t", "one"), ("c", None, "one")], index.schema).collect()))
    assert sum(frame.count() for frame in kept) == 3  # lost and gained pairs only
    gone = spark.createDataFrame([(c, t, k) for c, t, k in (("a", "t", "two three"), ("b", "t", "one"))], old.schema)
    assert rt.update_stored_index(spark, path, gone, new.limit(0), 1) == [0]
    assert sorted(map(str, rt.read_index(spark, path).collect())) == sorted(map(str, index.filter("chunk_id IS NULL OR chunk_type IS NULL").collect()))
