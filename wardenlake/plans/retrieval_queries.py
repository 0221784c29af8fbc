"""Retrieval over documents and benchmark items, and conversation analytics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wardenlake.operators import retrieval as rt
from wardenlake.plans.code_queries import _CODE
from wardenlake.plans.derived import CODE_FILES
from wardenlake.plans.registry import derive, plain, query
from wardenlake.session import cut_lineage, ensure_checkpoint_dir
from wardenlake.sources.tables import load, spread

# Document type by language, so that every type bonus occurs.
DOCS = """
SELECT doc_id, concat('doc-', cast(doc_id AS string)) AS source, text,
       CASE lang WHEN 'en' THEN 'documentation' WHEN 'fr' THEN 'code_example' WHEN 'de' THEN 'troubleshooting' ELSE 'general' END AS doc_type
FROM {documents}
"""
_SECTIONS = f"""
SELECT doc_id, source, doc_type, CAST(i - 1 AS INT) AS section_index, trim(sections[i], ' ' || chr(10) || chr(9) || chr(13)) AS content
FROM (SELECT *, unnest(range(1, len(sections) + 1)) AS i FROM (SELECT doc_id, source, doc_type, regexp_split_to_array(text, '\\n\\n+|\\n#{{1,3}}\\s+') AS sections FROM ({plain(DOCS)})))"""
_CHUNKS = f"""
SELECT 'chunk_' || left(md5(source || '_' || section_index || '_' || left(content, 100)), 12) AS chunk_id, doc_id, source, doc_type AS chunk_type, section_index, content,
  length(content) AS char_count FROM ({_SECTIONS}) WHERE length(content) >= 1"""
_STOP = ", ".join(f"'{w}'" for w in rt.STOP_WORDS)


def _kw(text: str) -> str:
    words = f"regexp_split_to_array(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s]', ' ', 'g'), '\\s+')"
    return (f"list_sort(list_distinct(list_filter({words}, lambda w: length(w) > 2 AND NOT list_contains([{_STOP}], w) "
            f"AND NOT regexp_matches(w, '^[0-9]+$'))))")


_POST = f"SELECT DISTINCT chunk_id, chunk_type, unnest({_kw('content')}) AS keyword FROM ({_CHUNKS})"
_TERMS = f"SELECT item_id AS query_id, unnest({_kw('text')}) AS keyword FROM benchmark"


def _chunks(spark, sf_dir):
    return rt.chunk(spread(derive(spark, sf_dir, DOCS, "documents")))


def _index(chunks):
    """The stored keywords of each chunk, as a search finds them, and the postings in them."""
    stored = cut_lineage(rt.forward_index(chunks))
    return rt.postings_of(stored), stored


def _queries(spark, sf_dir):
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("chunks", f"SELECT chunk_id, doc_id, chunk_type, section_index, CAST(char_count AS INT) AS char_count, md5(content) AS content_md5 FROM ({_CHUNKS})")
def chunks(spark, sf_dir):
    return _chunks(spark, sf_dir).select("chunk_id", "doc_id", "chunk_type", "section_index", "char_count", F.md5("content").alias("content_md5"))


@query("chunk_keywords", f"SELECT chunk_id, array_to_string({_kw('content')}, ' ') AS keywords FROM ({_CHUNKS})")
def chunk_keywords(spark, sf_dir):
    return _chunks(spark, sf_dir).select("chunk_id", F.array_join(rt.keywords(F.col("content")), " ").alias("keywords"))


@query("postings_top", f"SELECT keyword, count(*) AS chunks FROM ({_POST}) GROUP BY keyword ORDER BY chunks DESC, keyword LIMIT 50")
def postings_top(spark, sf_dir):
    return rt.postings(_chunks(spark, sf_dir), unique_sources=True).groupBy("keyword").agg(F.count("*").alias("chunks")).orderBy(F.desc("chunks"), "keyword").limit(50)


@query("keyword_search", f"""
SELECT query_id, chunk_id, hits, CAST(rank AS INT) AS rank FROM (
  SELECT query_id, chunk_id, count(*) AS hits, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, chunk_id) AS rank
  FROM ({_TERMS}) JOIN ({_POST}) USING (keyword) GROUP BY query_id, chunk_id) WHERE rank <= 10""")
def keyword_search(spark, sf_dir):
    index, stored = _index(_chunks(spark, sf_dir))
    return rt.keyword_search(_queries(spark, sf_dir), index, forward=stored)


@query("keyword_search_by_type", f"""
SELECT query_id, chunk_id, hits, CAST(rank AS INT) AS rank FROM (
  SELECT query_id, chunk_id, count(*) AS hits, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, chunk_id) AS rank
  FROM ({_TERMS}) JOIN ({_POST}) USING (keyword) WHERE chunk_type = 'code_example' GROUP BY query_id, chunk_id) WHERE rank <= 10""")
def keyword_search_by_type(spark, sf_dir):
    index, stored = _index(_chunks(spark, sf_dir))
    return rt.keyword_search(_queries(spark, sf_dir), index, "code_example", forward=stored)


@query("scored_retrieval", f"""
SELECT query_id, chunk_id, CAST(score AS BIGINT) AS score, CAST(rank AS INT) AS rank FROM (
  SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT h.query_id, h.chunk_id, h.hits * 2 + CASE WHEN contains(lower(c.content), lower(b.text)) THEN 10 ELSE 0 END
      + CASE c.chunk_type WHEN 'documentation' THEN 3 WHEN 'code_example' THEN 2 ELSE 0 END + CASE WHEN c.char_count BETWEEN 200 AND 1000 THEN 1 ELSE 0 END AS score
    FROM (SELECT query_id, chunk_id, count(*) AS hits FROM ({_TERMS}) JOIN ({_POST}) USING (keyword) GROUP BY ALL) h
    JOIN ({_CHUNKS}) c ON c.chunk_id = h.chunk_id JOIN benchmark b ON b.item_id = h.query_id)) WHERE rank <= 5""")
def scored_retrieval(spark, sf_dir):
    c = cut_lineage(_chunks(spark, sf_dir))
    index, stored = _index(c)
    return rt.scored_retrieval(_queries(spark, sf_dir), c, index, forward=stored)


_RECENT = "CAST(doc_id % 7 AS BIGINT)"
_INTENTS = "SELECT item_id AS query_id, text, CASE item_id % 3 WHEN 0 THEN 'code_help' WHEN 1 THEN 'troubleshoot' ELSE 'explain' END AS intent FROM benchmark"


@query("scored_retrieval_by_intent", f"""
SELECT query_id, chunk_id, CAST(score AS BIGINT) AS score, CAST(rank AS INT) AS rank FROM (
  SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT h.query_id, h.chunk_id, h.hits * 2 + CASE WHEN contains(lower(c.content), lower(b.text)) THEN 10 ELSE 0 END + {_RECENT}
      + CASE c.chunk_type WHEN 'documentation' THEN 3 WHEN 'code_example' THEN 2 ELSE 0 END + CASE WHEN c.char_count BETWEEN 200 AND 1000 THEN 1 ELSE 0 END AS score
    FROM (SELECT query_id, chunk_id, count(*) AS hits FROM ({_TERMS}) JOIN ({_POST}) USING (keyword) GROUP BY ALL) h
    JOIN ({_CHUNKS}) c ON c.chunk_id = h.chunk_id JOIN ({_INTENTS}) b ON b.query_id = h.query_id
    WHERE b.intent = 'explain' OR c.chunk_type = CASE b.intent WHEN 'code_help' THEN 'code_example' ELSE 'troubleshooting' END)) WHERE rank <= 5""")
def scored_retrieval_by_intent(spark, sf_dir):
    c = cut_lineage(_chunks(spark, sf_dir).withColumn("recency", F.expr(_RECENT)))
    intent = F.when(F.col("query_id") % 3 == 0, "code_help").when(F.col("query_id") % 3 == 1, "troubleshoot").otherwise("explain")
    index, stored = _index(c)
    return rt.scored_retrieval(_queries(spark, sf_dir).withColumn("intent", intent), c, index, recency="recency", forward=stored)


@query("late_keyword_hits", f"""
SELECT chunk_id, word FROM (SELECT chunk_id, {_kw('content')} AS words FROM ({_CHUNKS})), LATERAL (SELECT words[-1] AS word) WHERE len(words) > 20""")
def late_keyword_hits(spark, sf_dir):
    """The last keyword of each chunk that has more than twenty, found through the index."""
    c = _chunks(spark, sf_dir)
    index = rt.postings(c, unique_sources=True)
    return index.groupBy("chunk_id").agg(F.count("*").alias("n"), F.max("keyword").alias("word")).filter("n > 20").select("chunk_id", "word")


@query("index_statistics", f"""
SELECT (SELECT count(*) FROM ({_CHUNKS})) AS total_chunks, (SELECT round(avg(char_count), 4) FROM ({_CHUNKS})) AS average_chunk_size,
  (SELECT count(DISTINCT keyword) FROM ({_POST})) AS total_keywords, (SELECT count(DISTINCT source) FROM ({_CHUNKS})) AS sources""")
def index_statistics(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    return rt.index_statistics(c, rt.postings(c, unique_sources=True)).withColumn("average_chunk_size", F.round("average_chunk_size", 4))


@query("chunk_types", f"SELECT chunk_type, count(*) AS chunks FROM ({_CHUNKS}) GROUP BY chunk_type")
def chunk_types(spark, sf_dir):
    return rt.chunk_types(_chunks(spark, sf_dir))


@query("index_update", f"""
WITH p AS ({_POST}), c AS ({_CHUNKS}), changed AS (SELECT chunk_id, chunk_type, content || ' freshword' AS content FROM c WHERE doc_id % 10 = 1)
SELECT chunk_id, chunk_type, keyword FROM (
  SELECT chunk_id, chunk_type, keyword FROM p WHERE chunk_id NOT IN (SELECT chunk_id FROM c WHERE doc_id % 10 IN (1, 2))
  UNION ALL SELECT DISTINCT chunk_id, chunk_type, unnest({_kw('content')}) FROM changed)""")
def index_update(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    changed = c.filter("doc_id % 10 = 1").withColumn("content", F.concat("content", F.lit(" freshword")))
    return rt.update_index(rt.postings(c, unique_sources=True), changed, c.filter("doc_id % 10 = 2"))


@query("index_upkeep", f"""
WITH p AS ({_POST}), c AS ({_CHUNKS}), changed AS (SELECT chunk_id, chunk_type, content || ' freshword' AS content FROM c WHERE doc_id % 100 = 1)
SELECT chunk_id, chunk_type, keyword FROM p WHERE chunk_id NOT IN (SELECT chunk_id FROM c WHERE doc_id % 100 IN (1, 2))
UNION ALL SELECT DISTINCT chunk_id, chunk_type, unnest({_kw('content')}) FROM changed""")
def index_upkeep(spark, sf_dir):
    """The stored index after an update in place, read back."""
    c = _chunks(spark, sf_dir)
    changed = c.filter("doc_id % 100 = 1").withColumn("content", F.concat("content", F.lit(" freshword")))
    path = f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    rt.store_index(rt.postings(c, unique_sources=True), path)
    rt.update_stored_index(spark, path, c.filter("doc_id % 100 IN (1, 2)"), changed)
    return rt.read_index(spark, path)


@query("index_lookup", f"SELECT chunk_id, chunk_type, keyword FROM ({_POST}) WHERE keyword IN (SELECT keyword FROM ({_TERMS}))")
def index_lookup(spark, sf_dir):
    path = f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    rt.store_index(rt.postings(_chunks(spark, sf_dir), unique_sources=True), path)
    return rt.stored_postings(spark, path, rt.query_terms(_queries(spark, sf_dir)))


_INTENT_SQL = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(t, '{w}')" for w in words) + f" THEN '{intent}'" for intent, words in rt.INTENTS) + " ELSE 'general' END"
# Messages with intent words by turn, a time per turn and a confidence for answers.
MESSAGES = """
SELECT conv_id, turn, role, concat(text, CASE (conv_id + turn) % 8 WHEN 0 THEN ' Error in job' WHEN 1 THEN ' should I go' WHEN 2 THEN ' what is it'
         WHEN 3 THEN ' convert this' WHEN 4 THEN ' timeline' WHEN 5 THEN ' is it safe' ELSE '' END) AS text,
       cast(turn AS double) / 10 AS confidence, cast(turn * 90 AS bigint) AS seconds
FROM {conversations}
"""
_M = plain(MESSAGES)


def _messages(spark, sf_dir):
    return derive(spark, sf_dir, MESSAGES, "conversations")


@query("intent_mix", f"SELECT intent, count(*) AS messages FROM (SELECT {_INTENT_SQL} AS intent FROM (SELECT lower(text) AS t FROM ({_M}))) GROUP BY intent")
def intent_mix(spark, sf_dir):
    return _messages(spark, sf_dir).groupBy(rt.classify_intent(F.col("text")).alias("intent")).agg(F.count("*").alias("messages"))


@query("conversation_summary", f"""
SELECT conv_id, count(*) AS total_messages, count(*) FILTER (role = 'user') AS user_messages, count(*) FILTER (role = 'assistant') AS assistant_messages,
  string_agg(DISTINCT intent, ',' ORDER BY intent) AS topics, CASE WHEN count(*) < 2 THEN 0.0::DOUBLE ELSE (max(seconds) - min(seconds)) / 60 END AS duration_minutes,
  coalesce(round(avg(confidence) FILTER (role = 'assistant'), 6), 0.0) AS average_confidence
FROM (SELECT *, {_INTENT_SQL} AS intent FROM (SELECT *, lower(text) AS t FROM ({_M}))) GROUP BY conv_id""")
def conversation_summary(spark, sf_dir):
    stamped = _messages(spark, sf_dir).withColumn("ts", F.timestamp_seconds("seconds"))
    out = rt.conversation_summary(stamped)
    return out.withColumn("topics", F.array_join("topics", ",")).withColumn("average_confidence", F.round("average_confidence", 6))


@query("context_window", """
SELECT conv_id, turn, string_agg(turn2 || role2, ',' ORDER BY turn2) AS context FROM (
  SELECT a.conv_id, a.turn, b.turn AS turn2, b.role AS role2, row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY b.turn DESC) AS rn
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn <= a.turn) WHERE rn <= 5 GROUP BY conv_id, turn""")
def context_window(spark, sf_dir):
    windows = rt.context_window(load(spark, sf_dir, "conversations"), size=5, block=4)
    return windows.select("conv_id", "turn", F.array_join(F.transform("window", lambda m: F.concat(m["turn"].cast("string"), m["role"])), ",").alias("context"))


# Knowledge patterns per part and practices per supplier.
PATTERNS = """
SELECT p_partkey AS pattern_id, p_name AS name, concat('use ', p_type) AS description,
       CASE p_size % 3 WHEN 0 THEN 'react-hooks' WHEN 1 THEN 'python3' ELSE 'vue3' END AS migration_type FROM {part}
"""
PRACTICES = """
SELECT s_suppkey AS practice_id, s_name AS title, concat('cat', cast(s_nationkey % 4 AS string)) AS category,
       CASE WHEN s_acctbal < 0 THEN 'HIGH' ELSE 'LOW' END AS severity,
       CASE WHEN s_nationkey % 2 = 0 THEN 'react-hooks' ELSE 'python3' END AS t1 FROM {supplier}
"""


def _knowledge(spark, sf_dir):
    practices = derive(spark, sf_dir, PRACTICES, "supplier").withColumn("applicable_types", F.array("t1", F.lit("vue3")))
    return derive(spark, sf_dir, PATTERNS, "part"), practices


@query("knowledge_recommendations", f"""
SELECT pattern_id AS id, name AS title, 'HIGH' AS priority, 'pattern' AS type FROM ({plain(PATTERNS)}) WHERE migration_type = 'react-hooks'
UNION ALL SELECT practice_id, title, severity, 'best_practice' FROM ({plain(PRACTICES)}) WHERE t1 = 'react-hooks'""")
def knowledge_recommendations(spark, sf_dir):
    return rt.recommendations(*_knowledge(spark, sf_dir), "react-hooks")


@query("knowledge_statistics", f"""
SELECT (SELECT count(*) FROM part) AS total_patterns, (SELECT count(DISTINCT migration_type) FROM ({plain(PATTERNS)})) AS migration_types_covered,
  (SELECT count(*) FROM supplier) AS total_practices, (SELECT count(DISTINCT category) FROM ({plain(PRACTICES)})) AS categories_covered""")
def knowledge_statistics(spark, sf_dir):
    return rt.knowledge_statistics(*_knowledge(spark, sf_dir))


@query("pattern_search", f"SELECT pattern_id FROM ({plain(PATTERNS)}) WHERE contains(lower(name), 'bolt') OR contains(lower(description), 'bolt') OR contains(migration_type, 'bolt')")
def pattern_search(spark, sf_dir):
    return rt.search_patterns(_knowledge(spark, sf_dir)[0], "Bolt").select("pattern_id")


_LITERALS = [("mount", "componentDidMount"), ("props", "this.props"), ("import", "import os"), ("execute", "cur.execute("), ("storage", "localStorage")]


@query("pattern_matches", " UNION ALL ".join(f"SELECT path, '{i}' AS pattern_id FROM ({_CODE}) WHERE contains(content, '{w}')" for i, w in _LITERALS))
def pattern_matches(spark, sf_dir):
    return rt.pattern_matches(derive(spark, sf_dir, CODE_FILES, "part"), "path", _LITERALS)


# A pattern table that grows with the code: one literal per part, of three lengths.
LITERAL_PATTERNS = """
SELECT p_partkey AS pattern_id, CASE p_partkey % 3 WHEN 0 THEN concat('m', cast(p_partkey AS string)) WHEN 1 THEN concat('class K', cast(p_partkey AS string), ':')
         ELSE concat('componentDidMount() { fetch("/api/user/', cast(p_partkey AS string)) END AS literal FROM {part}
"""


@query("pattern_table_matches", f"SELECT path, pattern_id FROM ({_CODE}) JOIN ({plain(LITERAL_PATTERNS)}) ON contains(content, literal)")
def pattern_table_matches(spark, sf_dir):
    return rt.match_patterns(derive(spark, sf_dir, CODE_FILES, "part", deal=True), "path", derive(spark, sf_dir, LITERAL_PATTERNS, "part", deal=True))
