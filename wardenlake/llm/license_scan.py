"""License detections by ordered signature rules, in DataFrame functions only.

A text's words are lower-cased and joined by single spaces.  One expression finds which keywords of
the rules it holds; only rules that have all theirs are matched.  A detection is a span of words.  It
is suppressed if the span of another of equal or higher priority contains it; of equal spans the
higher priority and then the earlier rule stays.  Everything happens within the row: nothing is
shuffled, and a sweep over the spans in order of their starts keeps the work near-linear.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenlake.functions.text import let
from wardenlake.llm.license_rules import BASE, BASE_CONFIDENCE, BASE_PRIORITY, Rule, rules

RULE_SCHEMA = "array<struct<label:string,priority:int,confidence:double,keywords:array<string>,regex:string,base:boolean,ord:int>>"
SPAN = "struct<start:int,less_end:int,less_priority:int,ord:int,label:string,confidence:double,base:boolean>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Marks around a match; no word holds them.
OPENS, CLOSES = "\x01", "\x02"
#: Spans that are gathered before they are put away, so that long lists aren't copied for each of them.
CHUNK = 256


def rule_table(extra: list[Rule], base: tuple[tuple[str, str], ...]) -> tuple[Column, list[str], int]:
    """The rules as one constant, their keywords, and the number of priorities."""
    rows = [Rule(label, BASE_PRIORITY, BASE_CONFIDENCE, tuple(words.split()), words) for label, words in base] + list(extra)
    named = [r._asdict() | {"regex": f"(?<= )(?:{r.expression})(?= )", "base": k < len(base), "ord": k} for k, r in enumerate(rows)]
    keywords = sorted({k for r in rows for k in r.keywords})
    return F.from_json(F.lit(json.dumps(named)), RULE_SCHEMA), keywords, max(r.priority for r in rows) + 1


def spaced_words(text: Column) -> Column:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z as a-z, each with a space before and behind."""
    plain = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.concat(F.lit(" "), F.btrim(plain), F.lit(" "))


def _places(s: Column, rule: Column) -> Column:
    """The spans of a rule's matches: first word, and one past the last."""
    marked = F.split(F.regexp_replace(s, rule["regex"], F.lit(f"{OPENS}$0{CLOSES}")), " ")

    def where(words: Column, hit) -> Column:
        return F.filter(F.transform(words, lambda w, i: F.when(hit(w), i)), lambda i: i.isNotNull())

    # the first piece is empty, for the text begins with a space
    return let(marked, lambda words: F.transform(
        F.arrays_zip(where(words, lambda w: F.startswith(w, F.lit(OPENS))).alias("a"), where(words, lambda w: F.endswith(w, F.lit(CLOSES))).alias("b")),
        lambda m: F.struct(
            (m["a"] - 1).alias("start"), (-m["b"]).alias("less_end"), (-rule["priority"]).alias("less_priority"), rule["ord"].alias("ord"),
            rule["label"].alias("label"), rule["confidence"].alias("confidence"), rule["base"].alias("base"))))


def _surviving(spans: Column, priorities: int) -> Column:
    """Spans in order, less those that one before them contains at no lower priority."""

    def step(acc: Column, x: Column) -> Column:
        gone = F.exists(F.slice(acc["reach"], 1 - x["less_priority"], F.lit(priorities)), lambda r: r >= -x["less_end"])
        full = F.size(acc["tail"]) >= CHUNK
        return F.struct(
            F.transform(acc["reach"], lambda r, p: F.when(p == -x["less_priority"], F.greatest(r, -x["less_end"])).otherwise(r)).alias("reach"),
            F.when(gone, acc["tail"]).when(full, F.array(x)).otherwise(F.concat(acc["tail"], F.array(x))).alias("tail"),
            F.when(~gone & full, F.concat(acc["chunks"], F.array(acc["tail"]))).otherwise(acc["chunks"]).alias("chunks"))

    zero = F.struct(F.array_repeat(F.lit(-1), priorities).alias("reach"), F.array().cast(f"array<{SPAN}>").alias("tail"), F.array().cast(f"array<array<{SPAN}>>").alias("chunks"))
    return F.aggregate(spans, zero, step, lambda acc: F.flatten(F.concat(acc["chunks"], F.array(acc["tail"]))))


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None, extra: list[Rule] | None = None, base: tuple[tuple[str, str], ...] = BASE) -> DataFrame:
    """One row per document: the columns of ``keep`` (doc_id), n_words, base and detections.

    ``base`` holds every place of the base phrases, ``detections`` the spans that no other suppresses,
    base ones among them; both are arrays of (start, end, label, priority, confidence, rule) in order
    of their starts, in words from 0, the end one past the last word.  Null and empty texts have no
    words and no spans; very long texts are scanned whole; repeated rows and null ids come out as they
    went in; an empty table gives no rows.  Equal spans of equal priority leave the earlier rule.
    Columns that aren't kept, whatever their names, are left out.
    """
    table, keywords, priorities = rule_table(rules() if extra is None else extra, base)
    some = F.lit(r"(?<= )(?:" + "|".join(keywords) + ")(?= )")

    def tried(s: Column, held: Column) -> Column:
        mine = F.filter(table, lambda r: F.forall(r["keywords"], lambda k: F.array_contains(held, k)))
        hits = F.filter(mine, lambda r: F.rlike(s, r["regex"]))
        return F.array_sort(F.flatten(F.transform(hits, lambda r: _places(s, r))))

    def spans(s: Column) -> Column:
        held = F.array_distinct(F.regexp_extract_all(s, some, F.lit(0)))
        return let(held, lambda h: F.when(F.size(h) > 0, tried(s, h)).otherwise(F.array().cast(f"array<{SPAN}>")))

    def plain(found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(
            x["start"].alias("start"), (-x["less_end"]).alias("end"), x["label"].alias("label"), (-x["less_priority"]).alias("priority"),
            x["confidence"].alias("confidence"), x["ord"].alias("rule")))

    def both(s: Column) -> Column:
        count = F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) - 1
        return let(spans(s), lambda found: F.struct(
            F.when(F.length(s) > 2, count).otherwise(0).cast("long").alias("n_words"),
            plain(F.filter(found, lambda x: x["base"])).alias("base"), plain(_surviving(found, priorities)).alias("detections")))

    keep = keep or ["doc_id"]
    out = docs.select(*keep, let(spaced_words(F.col(text)), both).alias("__scan"))
    return out.select(*keep, *(F.col(f"__scan.{c}").alias(c) for c in ("n_words", "base", "detections")))


def summary(scanned: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Counts, first and last places, labels and score of scanned documents: one row each.

    The score is the highest confidence among the detections, 0 without any.  Labels are distinct,
    sorted and joined by commas, empty without any; base labels stay also where their spans are
    suppressed.  Repeated rows and null ids come out as they went in.
    """

    def names(*spans: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.concat(*(F.transform(s, lambda x: x["label"]) for s in spans)))), ",")

    starts = F.transform("base", lambda x: x["start"])
    return scanned.select(
        *(keep or ["doc_id"]), "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"), names(F.col("base")).alias("base_labels"), names(F.col("base"), F.col("detections")).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda x: x["confidence"])), F.lit(0.0)).alias("score"))


def duckdb_sql() -> str:
    """The same over the documents table in DuckDB, whose expressions know no look-around: spaces are doubled instead."""
    rows = [(k, label, BASE_PRIORITY, BASE_CONFIDENCE, words.split(), words, True) for k, (label, words) in enumerate(BASE)]
    rows += [(len(BASE) + k, r.label, r.priority, r.confidence, r.keywords, r.expression, False) for k, r in enumerate(rules())]
    values = ",\n        ".join(
        f"({k}, '{label}', {priority}, {confidence}, {[str(w) for w in keywords]}, ' ({expression.replace(' ', '  ')}) ', {base})"
        for k, label, priority, confidence, keywords, expression, base in rows)
    return f"""
    WITH r(ord, label, priority, confidence, keywords, regex, base) AS (VALUES
        {values}),
    d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
    hits AS (SELECT k, ord, label, priority, confidence, base, string_split_regex(regexp_replace('  ' || array_to_string(words, '  ') || '  ', regex, ' {OPENS}\\1{CLOSES} ', 'g'), ' +') AS marked
             FROM d JOIN r ON list_has_all(words, keywords) WHERE regexp_matches('  ' || array_to_string(words, '  ') || '  ', regex)),
    ends AS (SELECT *, list_filter(list_transform(marked, lambda w, i: CASE WHEN starts_with(w, '{OPENS}') THEN i - 2 END), lambda x: x IS NOT NULL) AS a,
                    list_filter(list_transform(marked, lambda w, i: CASE WHEN ends_with(w, '{CLOSES}') THEN i - 1 END), lambda x: x IS NOT NULL) AS b FROM hits),
    spans AS (SELECT k, ord, label, priority, confidence, base, unnest(a) AS a, unnest(b) AS b FROM ends),
    kept AS (SELECT * FROM spans x WHERE NOT EXISTS (SELECT 1 FROM spans y WHERE x.k = y.k AND y.a <= x.a AND y.b >= x.b AND y.priority >= x.priority
                     AND (y.a < x.a OR y.b > x.b OR y.priority > x.priority OR y.ord < x.ord))),
    named AS (SELECT k, label, a, confidence, false AS base FROM kept UNION ALL SELECT k, label, a, NULL, true FROM spans WHERE base),
    sums AS (SELECT k, count(*) FILTER (WHERE base) AS n_base, min(a) FILTER (WHERE base) AS first_word, max(a) FILTER (WHERE base) AS last_word,
                    array_to_string(list_sort(list_distinct(list(label) FILTER (WHERE base))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels,
                    max(confidence) AS score FROM named GROUP BY k)
    SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
           coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN sums USING (k)"""
