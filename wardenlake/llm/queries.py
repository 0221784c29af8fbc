"""Registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenlake.llm import bpe_codec, filter_audit, hyperminhash, language_id, license_scan, maxent_lm, packing, quality, token_store, vector_links, vector_search, warc_archive, whitening
from wardenlake.llm.common import fold, shared_folder

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    docs = given(spark, sf_dir, "documents")
    model = language_id.train(docs, fold(F.col("doc_id"), 3) != 1)
    named = docs.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "text")
    return language_id.identify(named, model, keep=["doc_id", "held_out"])


@query("op10_quality_classifier")
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels that are not held out."""
    docs = given(spark, sf_dir, "documents")
    model = quality.train(docs, given(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    named = docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return quality.score(named, model, keep=["doc_id", "held_out"])


@query("op5_hyperminhash")
def op5_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all documents: three-word shingles, similarity of 0.85 and more."""
    return hyperminhash.near_duplicates(given(spark, sf_dir, "documents"), size=3, percent=85).drop("mark", "first")


@query("op7_warc_archive", """
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
           CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id < max(page_id) OVER same THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id < max(page_id) OVER same THEN max(page_id) OVER same END AS refers_to
    FROM pages WINDOW same AS (PARTITION BY coalesce(html, ''))""")
def op7_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to a content-addressed archive and read back."""
    path = shared_folder(spark, "warc")
    warc_archive.write_archive(given(spark, sf_dir, "pages"), path)
    return warc_archive.read_records(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_bin_slack_packing")
def op9_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token pieces, packed into sequences of at most 1024 tokens."""
    docs = given(spark, sf_dir, "documents")
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


@query("op4_token_store")
def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written to token files and read back."""
    folder = shared_folder(spark, "tokens")
    manifest = token_store.write_tokens(given(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_store.read_tokens(manifest, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op3_backtracking_bpe")
def op3_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    decoded = bpe_codec.round_trip(given(spark, sf_dir, "documents"), vocabulary)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


@query("op8_vector_search")
def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all embeddings for every twentieth."""
    return vector_search.nearest(given(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op6_vector_links")
def op6_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all embeddings of a label: cosine of 0.93 and more."""
    return vector_links.near_duplicates(given(spark, sf_dir, "embeddings"), threshold=0.93)


@query("op2_maxent_lm")
def op2_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document, learned from the documents that are not held out."""
    docs = given(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 7) == 2
    model = maxent_lm.train(docs, ~held_out)
    return maxent_lm.score(docs.select("doc_id", held_out.alias("held_out"), "text"), model, keep=["doc_id", "held_out"])


@query("op12_license_scan", license_scan.duckdb_sql())
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and detections of every document."""
    return license_scan.summary(license_scan.scan(given(spark, sf_dir, "documents")))


@query("op11_filter_audit", """
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    f AS (SELECT doc_id, part, (CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END)
                 + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
                 + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS mask FROM d),
    l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
    m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
    c(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
    o AS (SELECT v.c || w.c || x.c || y.c || z.c AS filter_order FROM c v, c w, c x, c y, c z WHERE len(list_distinct([v.c, w.c, x.c, y.c, z.c])) = 5),
    s AS (SELECT filter_order, step::INT AS step, substr(filter_order, step::INT, 1) AS letter, 1 << (instr('ABCDE', substr(filter_order, step::INT, 1)) - 1) AS bit,
                 coalesce(list_sum(list_transform(range(1, step), lambda k: 1 << (instr('ABCDE', substr(filter_order, k::INT, 1)) - 1))), 0)::INT AS before FROM o, range(1, 6) r(step)),
    g AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (WHERE mask & (before | bit) = 0), 0)::BIGINT AS kept,
                 coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (WHERE mask & before <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
                 coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
                 coalesce(sum(toxic) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost FROM m, s GROUP BY ALL)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM g""")
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five text filters remove, in every order of them, in each language."""
    flagged = filter_audit.text_filters(given(spark, sf_dir, "documents"), given(spark, sf_dir, "labels"))
    return filter_audit.audit(flagged, {f: f for f in "ABCDE"}, lost={"good_lost": "good", "toxic_lost": "toxic"})


@query("op13_embedding_whitening")
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 32 leading whitened components of all embeddings."""
    return whitening.whiten(given(spark, sf_dir, "embeddings"))
