"""Chunking, inverted index, ranked search, knowledge look-ups and conversations."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from wardenlake.functions.text import contains_any, let, strip
from wardenlake.functions.totals import merge_totals
from wardenlake.functions.windows import number_rows
from wardenlake.session import cut_and_count, cut_lineage

# Stop words of keyword extraction.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "up", "about", "into",
    "through", "during", "before", "after", "above", "below", "between", "among", "is", "are", "was", "were", "be", "been",
    "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "can",
    "this", "that", "these", "those", "i", "you", "he", "she", "it", "we", "they", "them", "their", "there", "then", "than",
]
SECTION_BREAK = r"(?U)\n\n+|\n#{1,3}\s+"

# Intent words in the order they are tried.
INTENTS = [
    ("troubleshoot", ["error", "issue", "problem", "failed", "not working", "bug"]),
    ("recommend", ["recommend", "suggest", "best practice", "should i"]),
    ("explain", ["explain", "how does", "what is", "why"]),
    ("code_help", ["code", "example", "transform", "convert", "migrate"]),
    ("planning", ["plan", "schedule", "timeline", "estimate"]),
    ("security", ["security", "safe", "risk", "vulnerable"]),
]
INTENT_CHUNK_TYPE = {"troubleshoot": "troubleshooting", "code_help": "code_example"}


def chunk(documents: DataFrame, at_least: int = 1) -> DataFrame:
    """Sections of documents(doc_id, source, doc_type, text) of at least so many characters; narrow, no shuffle."""
    parts = F.transform(F.split("text", SECTION_BREAK, -1), strip)
    kept = documents.select("doc_id", "source", "doc_type", F.posexplode(parts).alias("section_index", "content")).filter(F.length("content") >= at_least)
    identity = F.concat(F.col("source"), F.lit("_"), F.col("section_index").cast("string"), F.lit("_"), F.substring("content", 1, 100))
    return kept.select(
        F.concat(F.lit("chunk_"), F.substring(F.md5(identity), 1, 12)).alias("chunk_id"), "doc_id", "source",
        F.col("doc_type").alias("chunk_type"), "section_index", "content",
        F.size(F.split("content", r"(?U)\s+")).alias("word_count"), F.length("content").alias("char_count"))


def keywords(text: Column) -> Column:
    """All distinct lower-case words over two letters, no stop words, no numbers, by name."""
    words = F.split(F.lower(text), r"(?U)[^\w]+")
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.sort_array(F.filter(F.array_except(words, stop), lambda w: (F.length(w) > 2) & ~w.rlike(r"^\p{Nd}+$")))


def postings(chunks: DataFrame, unique_sources: bool = False) -> DataFrame:
    """keyword → chunk, one row per pair.

    A source added twice repeats its chunk ids, so pairs are made distinct; a caller
    whose sources are unique says so and saves that shuffle.
    """
    pairs = postings_of(forward_index(chunks))
    return pairs if unique_sources else pairs.distinct()


def forward_index(chunks: DataFrame) -> DataFrame:
    """chunk → its keywords, one row per chunk; narrow.  Stored, it serves the searches and gives the postings."""
    return chunks.select("chunk_id", "chunk_type", keywords(F.col("content")).alias("words"))


def postings_of(forward: DataFrame) -> DataFrame:
    return forward.select("chunk_id", "chunk_type", F.explode("words").alias("keyword"))


def write_postings(index: DataFrame, table: str, buckets: int) -> None:
    """Bucketed and sorted by keyword, so look-ups join without a shuffle of the index."""
    index.write.mode("overwrite").bucketBy(buckets, "keyword").sortBy("keyword").saveAsTable(table)


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(keywords(F.col("text"))).alias("keyword"))


#: A query's first k results come from this many of its rarest keywords, and so many chunks of each.
CHAMPION_WORDS, CHAMPIONS = 8, 16
#: Up to so many asked keywords are sent to the tasks, about 30 MB; the postings are shuffled for longer lists.
ASKED_ROWS = 500_000


def _fits() -> Column:
    """Whether a chunk is of the type that the query asks for; without ``_type`` any is."""
    return F.col("_type").isNull() | (F.col("_type") == F.col("chunk_type"))


def _asked(index: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings of the terms' keywords; where they stand is not shuffled while the list is short."""
    asked, n = cut_and_count(terms.select("keyword").distinct())
    return index.join(F.broadcast(asked) if n <= ASKED_ROWS else asked, "keyword", "left_semi")


def _by_rarity(terms: DataFrame, index: DataFrame) -> DataFrame:
    """Each query's keywords that the index holds, with their place from the rarest on and how many there are.

    Where terms have a ``_type``, keywords are held and counted in chunks of that type.
    """
    listed = _asked(index, terms)
    if "_type" in terms.columns:
        by_type = listed.groupBy("keyword", "chunk_type").agg(F.count("*").alias("_n"))
        of_type = F.map_from_entries(F.collect_list(F.when(F.col("chunk_type").isNotNull(), F.struct("chunk_type", "_n"))))
        frequency = by_type.groupBy("keyword").agg(F.sum("_n").alias("_all"), of_type.alias("_of"))
        df = F.when(F.col("_type").isNull(), F.col("_all")).otherwise(F.col("_of")[F.col("_type")])
        held = terms.join(frequency, "keyword").withColumn("_df", df).filter("_df IS NOT NULL").drop("_all", "_of")
    else:
        held = terms.join(listed.groupBy("keyword").agg(F.count("*").alias("_df")), "keyword")
    mine = Window.partitionBy("query_id")
    placed = held.withColumn("_place", F.row_number().over(mine.orderBy("_df", "keyword"))).withColumn("_words", F.count("*").over(mine))
    return cut_lineage(placed.drop("_df"))


def _champions(terms: DataFrame, index: DataFrame, least: int) -> DataFrame:
    """(query_id, chunk_id) of the smallest chunk ids of the rarest keywords; every task keeps few of a keyword before the shuffle."""
    rare = terms.filter(F.col("_place") <= CHAMPION_WORDS)
    asked = _asked(index, rare)
    typed = ["chunk_type"] if "_type" in terms.columns else []
    first = asked.withColumn("_n", F.row_number().over(Window.partitionBy("keyword", *typed).orderBy("chunk_id"))).filter(F.col("_n") <= max(least, CHAMPIONS))
    met = rare.join(first, "keyword")
    return (met.filter(_fits()) if typed else met).select("query_id", "chunk_id").distinct()


def _matching(needed: DataFrame, index: DataFrame, salt: int) -> DataFrame:
    """(query_id, chunk_id) pairs of the keywords that are needed.

    The index side gets a random-free salt from the chunk id and the query side is repeated per
    salt, so no join task holds one whole keyword.
    """
    listed = _asked(index, needed)
    salted = listed.withColumn("_salt", F.pmod(F.xxhash64("chunk_id"), F.lit(salt)).cast("int"))
    repeated = needed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    hits = repeated.join(salted.hint("merge"), ["keyword", "_salt"])  # sizes of exploded postings are estimated far too small
    if "_type" in needed.columns:
        hits = hits.filter(_fits())
    if "_before" in needed.columns:  # at the last place only chunks that win the tie by their id
        hits = hits.filter(F.col("_before").isNull() | (F.col("chunk_id") < F.col("_before")))
    return hits.select("query_id", "chunk_id").distinct()


def _with_hits(pairs: DataFrame, terms: DataFrame, forward: DataFrame) -> DataFrame:
    """How many of its query's keywords each candidate holds, from the candidates' own keywords."""
    asked = terms.groupBy("query_id").agg(F.collect_set("keyword").alias("_asked"))
    joined = pairs.join(forward.select("chunk_id", "words").hint("merge"), "chunk_id").join(asked, "query_id")
    return joined.select("query_id", "chunk_id", F.size(F.array_intersect("words", "_asked")).cast("bigint").alias("hits"))


def _grouped(index: DataFrame) -> DataFrame:
    return index.groupBy("chunk_id").agg(F.collect_set("keyword").alias("words"))


def _top(scored: DataFrame, k: int, by: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(by), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def keyword_search(queries: DataFrame, index: DataFrame, doc_type: str | None = None, k: int = 10, salt: int = 8,
                   forward: DataFrame | None = None) -> DataFrame:
    """Top chunks per query by the number of its keywords they hold, ties to the smaller chunk id.

    ``forward`` is the stored ``forward_index`` of the same chunks; without it the postings are grouped.

    The k-th best of a few chunks of each keyword bounds the result from below.  A chunk that holds
    more than t of a query's m keywords holds one of its m - t rarest, so more common keywords are
    never matched; one that ties holds one of the next rarest and has a smaller id than the k-th best.
    """
    searched = index.filter(F.col("chunk_type") == doc_type) if doc_type else index
    held = _grouped(searched) if forward is None else forward
    terms = _by_rarity(query_terms(queries), searched)
    first = cut_lineage(_top(_with_hits(_champions(terms, searched, k), terms, held), k, "hits"))
    bound = first.filter(F.col("rank") == k).select("query_id", F.col("hits").alias("_least"), F.col("chunk_id").alias("_last"))
    left = F.col("_words") - F.coalesce("_least", F.lit(0))
    needed = terms.join(bound, "query_id", "left").filter(F.col("_place") <= left + 1)
    needed = needed.select("query_id", "keyword", F.when(F.col("_place") > left, F.col("_last")).alias("_before"))
    more = _matching(needed, searched, salt).join(first.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    return _top(first.drop("rank").unionByName(_with_hits(more, terms, held)), k, "hits")


def _type_points(chunk_type: Column) -> Column:
    return F.when(chunk_type == "documentation", 3).when(chunk_type == "code_example", 2).otherwise(0)


def scored_retrieval(queries: DataFrame, chunks: DataFrame, index: DataFrame, k: int = 5, salt: int = 8,
                     recency: str | None = None, forward: DataFrame | None = None) -> DataFrame:
    """Phrase, keyword, type, length and recency points; best five per query.

    As in ``keyword_search`` the k-th best of a few chunks bounds the result.  Type and length give
    four points at most, recency the most that a chunk has.  A chunk that beats the bound without
    the phrase needs so many keywords that it holds one of the rarest; one with the phrase holds all
    keywords but those at its two ends, so it holds one of the three rarest.  Only such chunks meet the texts.
    A query whose intent asks for a type looks among the chunks of that type from the start, with the
    bound and the keyword counts of that type.
    """
    asked = query_terms(queries)
    if "intent" in queries.columns:  # rows of one query id that ask for several types look among all
        types = F.create_map(*[F.lit(v) for kv in INTENT_CHUNK_TYPE.items() for v in kv])[F.col("intent")]
        one = (F.count(types) == F.count("*")) & (F.min(types) == F.max(types))
        asked = asked.join(queries.groupBy("query_id").agg(F.when(one, F.min(types)).alias("_type")), "query_id")
    terms = _by_rarity(asked, index)
    held = forward_index(chunks) if forward is None else forward
    wanted = [c for c in ("intent",) if c in queries.columns]
    facts = queries.select("query_id", F.lower("text").alias("_phrase"), *wanted)
    kinds = chunks.select("chunk_id", "chunk_type", "char_count", F.lower("content").alias("_body"), (F.coalesce(F.col(recency), F.lit(0)) if recency else F.lit(0)).alias("_recent"))

    def score(pairs: DataFrame) -> DataFrame:
        read = _with_hits(pairs, terms, held).join(kinds.hint("merge"), "chunk_id").join(facts, "query_id")
        if wanted:
            type_ = F.create_map(*[F.lit(v) for kv in INTENT_CHUNK_TYPE.items() for v in kv])[F.col("intent")]
            read = read.filter(type_.isNull() | (type_ == F.col("chunk_type")))
        points = (F.col("hits") * 2 + _type_points(F.col("chunk_type"))
                  + F.when(F.col("char_count").between(200, 1000), 1).otherwise(0) + F.when(F.col("_body").contains(F.col("_phrase")), 10).otherwise(0) + F.col("_recent"))
        return read.select("query_id", "chunk_id", points.alias("score"))

    first = cut_lineage(_top(score(_champions(terms, index, k)), k, "score"))
    bound = first.filter(F.col("rank") == k).select("query_id", F.col("score").alias("_least"))
    if recency:
        bound = bound.crossJoin(chunks.agg(F.greatest(F.coalesce(F.max(recency), F.lit(0)), F.lit(0)).alias("_spare")))  # one row
    else:
        bound = bound.withColumn("_spare", F.lit(0))
    kind = [c for c in ("_type",) if c in terms.columns]
    most = 1 + (F.when(F.col("_type").isNull(), 3).otherwise(_type_points(F.col("_type"))) if kind else F.lit(3))
    words = F.ceil((F.col("_least") - most - F.col("_spare")) / 2)
    needed = terms.join(bound, "query_id", "left").filter(F.col("_least").isNull() | (F.col("_place") <= F.greatest(F.lit(3), F.col("_words") - words + 1)))
    more = _matching(needed.select("query_id", "keyword", *kind), index, salt).join(first.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    return _top(first.drop("rank").unionByName(score(more)), k, "score")


def update_index(index: DataFrame, changed_chunks: DataFrame, deleted: DataFrame) -> DataFrame:
    """Drop postings of changed and deleted chunks, add those of the new text."""
    touched = changed_chunks.select("chunk_id").unionByName(deleted.select("chunk_id")).distinct()
    return index.join(touched, "chunk_id", "left_anti").unionByName(postings(changed_chunks).select(*index.columns))


#: Folders of a stored index; a keyword's postings lie in one of them.
INDEX_PARTS = 64
POSTING = "chunk_id string, chunk_type string, keyword string"


def _part(keyword: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(keyword), F.lit(parts)).cast("int").alias("part")


def _slot() -> Column:
    return F.pmod(F.xxhash64("chunk_id"), F.lit(4))


def store_index(index: DataFrame, path: str, parts: int = INDEX_PARTS) -> None:
    """The postings in one folder a part of the keywords, sorted by keyword so that look-ups skip row groups."""
    placed = index.withColumn("part", _part(F.col("keyword"), parts))
    placed.repartition("part", _slot()).sortWithinPartitions("part", "keyword").write.partitionBy("part").parquet(path)


def _stored(spark: SparkSession, path: str, wanted: list[int]) -> DataFrame:
    return spark.read.schema(f"{POSTING}, part int").parquet(path).filter(F.col("part").isin(wanted))


def stored_postings(spark: SparkSession, path: str, terms: DataFrame, parts: int = INDEX_PARTS) -> DataFrame:
    """Postings of the asked keywords; only the folders that may hold one of them are opened."""
    asked = terms.select("keyword").distinct()
    wanted = [r["part"] for r in asked.select(_part(F.col("keyword"), parts)).distinct().collect()]  # at most ``parts`` numbers
    return _stored(spark, path, wanted).drop("part").join(asked, "keyword", "left_semi")


def update_stored_index(spark: SparkSession, path: str, before: DataFrame, after: DataFrame, parts: int = INDEX_PARTS) -> list[int]:
    """Bring a stored index up to date; gives the numbers of the folders that were rewritten.

    ``before`` and ``after`` hold the changed chunks as they were and as they are; a new chunk is
    in ``after`` only and a deleted one in ``before`` only.  Pairs that stand in both stay where they are; only folders
    of keywords that a chunk lost or gained are written again, each in one commit, and other files keep their names.
    """
    old, new = (postings(side).select("chunk_id", "chunk_type", "keyword") for side in (before, after))
    pairs = ["chunk_id", "chunk_type", "keyword"]
    lost, gained = cut_lineage(old.join(new, pairs, "left_anti")), cut_lineage(new.join(old, pairs, "left_anti"))
    touched = sorted(r["part"] for r in lost.unionByName(gained).select(_part(F.col("keyword"), parts)).distinct().collect())
    if touched:
        # A folder that loses its last row would not be written, so each keeps a row of nulls that no look-up meets.
        nothing = spark.range(len(touched)).select(*[F.lit(None).cast("string").alias(c) for c in pairs], F.element_at(F.lit(touched), (F.col("id") + 1).cast("int")).alias("part"))
        own = _part(F.col("keyword"), parts)
        kept = _stored(spark, path, touched).filter(F.col("keyword").isNotNull()).unionByName(gained.withColumn("part", own)).unionByName(nothing)
        # Kept and lost pairs meet in the one shuffle that the files need; a pair with a null is never lost.
        both = kept.withColumn("_lost", F.lit(False)).unionByName(lost.dropna().withColumn("part", own).withColumn("_lost", F.lit(True)))
        dealt = both.withColumn("_slot", _slot()).repartition("part", "_slot")
        same = Window.partitionBy("part", "keyword", "_slot", "chunk_id", "chunk_type")
        rows = dealt.withColumn("_gone", F.max("_lost").over(same)).filter(~F.col("_gone"))
        rows.select(*pairs, "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    return touched


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{POSTING}, part int").parquet(path).filter(F.col("keyword").isNotNull()).drop("part")


def index_statistics(chunks: DataFrame, index: DataFrame) -> DataFrame:
    size = chunks.agg(F.count("*").alias("total_chunks"), F.coalesce(F.avg("char_count"), F.lit(0.0)).alias("average_chunk_size"))
    words = index.select("keyword").distinct().agg(F.count("*").alias("total_keywords"))
    sources = chunks.select("source").distinct().agg(F.count("*").alias("sources"))
    return merge_totals(size, words, sources)


def chunk_types(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("chunk_type").agg(F.count("*").alias("chunks"))


def classify_intent(text: Column) -> Column:
    def chain(lowered: Column) -> Column:
        out = None
        for intent, words in INTENTS:
            hit = contains_any(lowered, words)
            out = F.when(hit, intent) if out is None else out.when(hit, intent)
        return out.otherwise("general")

    return let(F.lower(text), chain)


def conversation_summary(messages: DataFrame) -> DataFrame:
    """messages(conv_id, turn, role, text[, ts, confidence]) → one row per conversation, partial sums first."""
    role = F.col("role")
    aggs = [F.count("*").alias("total_messages"), F.sum((role == "user").cast("int")).alias("user_messages"),
            F.sum((role == "assistant").cast("int")).alias("assistant_messages"),
            F.sort_array(F.collect_set(classify_intent(F.col("text")))).alias("topics")]
    if "ts" in messages.columns:
        minutes = (F.max("ts").cast("timestamp").cast("double") - F.min("ts").cast("timestamp").cast("double")) / 60
        aggs.append(F.when(F.count("*") < 2, 0.0).otherwise(minutes).alias("duration_minutes"))
    if "confidence" in messages.columns:
        aggs.append(F.coalesce(F.avg(F.when(role == "assistant", F.col("confidence"))), F.lit(0.0)).alias("average_confidence"))
    return messages.groupBy("conv_id").agg(*aggs)


def context_window(messages: DataFrame, size: int = 10, block: int = 1000) -> DataFrame:
    """The last ``size`` messages up to each turn, oldest first.

    Turn numbers only have to grow.  Messages are numbered exactly in two levels
    (rank inside a turn block plus the count of earlier blocks), and each run of
    ``block`` messages becomes its own window group that also carries the ``size - 1``
    messages before it, so one conversation never becomes one task.
    """
    numbered = number_rows(messages, ["conv_id"], ["turn"], F.floor(F.col("turn") / block))
    own = F.floor((F.col("ordinal") - 1) / block)
    carried = F.when((F.col("ordinal") - 1) % block >= block - (size - 1), F.array(own, own + 1)).otherwise(F.array(own))
    grouped = numbered.withColumn("_own", own).withColumn("_group", F.explode(carried))
    order = Window.partitionBy("conv_id", "_group").orderBy("ordinal").rowsBetween(-(size - 1), 0)
    return (grouped.withColumn("window", F.collect_list(F.struct("turn", "role", "text")).over(order))
            .filter(F.col("_own") == F.col("_group")).drop("_own", "_group", "ordinal"))


def recommendations(patterns: DataFrame, practices: DataFrame, migration_type: str) -> DataFrame:
    from_patterns = patterns.filter(F.col("migration_type") == migration_type).select(
        F.col("pattern_id").alias("id"), F.col("name").alias("title"), F.lit("HIGH").alias("priority"), F.lit("pattern").alias("type"))
    from_practices = practices.filter(F.array_contains("applicable_types", migration_type)).select(
        F.col("practice_id").alias("id"), "title", F.col("severity").alias("priority"), F.lit("best_practice").alias("type"))
    return from_patterns.unionByName(from_practices)


def pattern_matches(files: DataFrame, key: str, patterns: list[tuple[str, str]]) -> DataFrame:
    """Which of the knowledge-base literals occur in each text.

    The pattern list is metadata of the knowledge base, tested inside the row; the
    texts are neither shuffled nor paired with pattern rows.
    """
    hits = F.array_compact(F.array(*[F.when(F.col("content").contains(literal), F.lit(pattern_id)) for pattern_id, literal in patterns]))
    return (files.select(key, F.explode_outer(hits).alias("pattern_id")).filter(F.col("pattern_id").isNotNull()))


#: Sizes of grams in bytes: a literal is looked up by grams of the largest size that it holds, a short one as a whole,
#: a longer one by four fifths of it at least, so that literals with a common beginning have grams of their own.
GRAM_SIZES = np.array([*range(1, 17), *(n << k for k in range(17) for n in (20, 24, 28, 32))])
#: Bytes of text that are hashed at a time, and bits of the filter that tasks apply to the grams of texts.
GRAM_BLOCK, FILTER_BITS = 1 << 20, 26
_BASE = 0x9E3779B97F4A7C15  # odd, so powers have inverses
_BYTE_VALUES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


def _gram_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse."""
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)])) for base in (_BASE, pow(_BASE, -1, 1 << 64)))


def _gram_blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first row, bytes, offsets) of about ``GRAM_BLOCK`` bytes of whole texts; a longer text is a block of its own."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        after = max(first + 1, int(np.searchsorted(offsets, offsets[first] + GRAM_BLOCK, "right")) - 1)
        yield first, raw[offsets[first] : offsets[after]], offsets[first : after + 1] - offsets[first]
        first = after


def _grams(column: pa.Array, sizes: Iterable[int], bits: np.ndarray | None = None, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, gram) of the distinct hashed grams of each text, of all ``sizes`` or only of its ``own``, and only those that ``bits`` has."""
    rows, grams = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    powers = inverses = np.empty(0, np.uint64)
    for first, raw, offsets in _gram_blocks(column):
        n = len(raw)
        if n > len(powers):
            powers, inverses = _gram_powers(n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_VALUES[raw] * powers[:n])])
        for size in sizes:
            if n < size:
                continue
            code = (sums[size:] - sums[:-size]) * inverses[: n - size + 1] + np.uint64(size)
            code = (code ^ code >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            code = (code ^ code >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            code ^= code >> np.uint64(31)
            at = np.arange(len(code)) if bits is None else np.flatnonzero(bits[code >> np.uint64(70 - FILTER_BITS)] >> (code >> np.uint64(64 - FILTER_BITS) & np.uint64(63)) & np.uint64(1))
            row = np.searchsorted(offsets, at, "right") - 1
            inside = at + size <= offsets[row + 1]
            if own is not None:
                inside &= own[first + row] == size
            rows.append(first + row[inside])
            grams.append(code[at[inside]])
    row, gram = np.concatenate(rows), np.concatenate(grams)
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
    return row[new], gram[new].view(np.int64)


def _gram_filter(grams: DataFrame) -> np.ndarray:
    """Which leading bits the grams have; a bitmap of 8 MB, put together by tasks, whatever the number of grams."""
    words = grams.groupBy(F.shiftrightunsigned("gram", 70 - FILTER_BITS).alias("word")).agg(
        F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(gram, {64 - FILTER_BITS}) & 63 AS int)))").alias("held")).toArrow()
    bits = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    bits[words["word"].to_numpy()] = words["held"].to_numpy().view(np.uint64)
    return bits


def match_patterns(files: DataFrame, key: str, patterns: DataFrame, content: str = "content") -> DataFrame:
    """(key, pattern_id) of every literal of patterns(pattern_id, literal) that a text holds; both tables may be of any size.

    Literals are looked up by their grams of bytes.  Texts are read once to count the grams that
    literals have; a literal with a gram that no text has is nowhere, any other waits under its
    rarest gram.  Texts then meet the literals that wait under one of their grams, and those pairs
    are verified on the whole text.  Null and empty literals and null texts match nothing, pattern rows that repeat
    count once, files that repeat a key are matched row by row.
    """
    listed = patterns.filter(F.length("literal") > 0).select("pattern_id", "literal")
    spark = files.sparkSession

    def of_literals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array([len(text.encode()) for text in batch["literal"].to_pylist()], np.int64)
            own = GRAM_SIZES[np.searchsorted(GRAM_SIZES, lengths, "right") - 1]
            row, gram = _grams(batch["literal"], np.unique(own), own=own)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch["pattern_id"].take(at), batch["literal"].take(at), pa.array(own[row]), pa.array(gram)],
                                             names=["pattern_id", "literal", "size", "gram"])

    literal_grams = cut_lineage(listed.mapInArrow(of_literals, StructType([*listed.schema.fields]).add("size", "long").add("gram", "long")))
    sizes = sorted(r["size"] for r in literal_grams.select("size").distinct().collect())  # as many as GRAM_SIZES at most
    texts = files.filter(F.col(content).isNotNull()).select(F.col(key).alias("_key"), F.xxhash64(content).alias("_hash"), F.col(content).alias("_text"))
    wanted = spark.sparkContext.broadcast(_gram_filter(literal_grams))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, times = np.unique(_grams(batch["_text"], sizes, wanted.value)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(times)], names=["gram", "n"])

    seen = texts.select("_text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest")
    waiting = cut_lineage(literal_grams.join(seen, "gram", "left").groupBy("pattern_id", "literal").agg(rarest)
                          .filter("rarest.n > 0").select("pattern_id", "literal", "rarest.gram"))
    anchors = spark.sparkContext.broadcast(_gram_filter(waiting))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, gram = _grams(batch["_text"], sizes, anchors.value)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch["_key"].take(at), batch["_hash"].take(at), pa.array(gram)], names=["_key", "_hash", "gram"])

    met = texts.mapInArrow(meet, StructType(texts.select("_key", "_hash").schema.fields).add("gram", "long"))
    pairs = met.join(waiting, "gram").select("_key", "_hash", "pattern_id", "literal").distinct()
    return texts.join(pairs, ["_key", "_hash"]).filter(F.col("_text").contains(F.col("literal"))).select(F.col("_key").alias(key), "pattern_id")


def search_patterns(patterns: DataFrame, text: str) -> DataFrame:
    needle = text.lower()
    return patterns.filter(F.lower("name").contains(needle) | F.lower("description").contains(needle) | F.lower("migration_type").contains(needle))


def knowledge_statistics(patterns: DataFrame, practices: DataFrame) -> DataFrame:
    p = patterns.groupBy("migration_type").agg(F.count("*").alias("n")).agg(
        F.sum("n").alias("total_patterns"), F.count("*").alias("migration_types_covered"))
    c = practices.groupBy("category").agg(F.count("*").alias("n")).agg(F.sum("n").alias("total_practices"), F.count("*").alias("categories_covered"))
    return merge_totals(p, c)
