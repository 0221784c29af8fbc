"""Small tables with the awkward rows that every operator must take."""

from __future__ import annotations

import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text: str | None) -> list[bytes]:
    return [w.lower() for w in WORD.findall((text or "").encode())]


def table(spark, texts, lang="en", first=0, extra=False):
    """Documents with ids from ``first``; with ``extra``, columns whose names clash with results."""
    rows = [(first + i, t, lang if isinstance(lang, str) or lang is None else lang[i], "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        for name in ("score", "predicted", "kept", "component_id", "n_shingles", "n_tokens", "length", "start", "ids", "id", "u", "v", "bits", "lang_pred", "k", "t", "label"):
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("clash"))
    return df


ODD = [None, "", " \n\t", "12 34 !!", "one", "Ünï çøðé", "word " * 30_000, "x" * 100_000, "a b c d e f", "a b c d e f"]
