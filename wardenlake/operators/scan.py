"""Sensitive-data scan: findings, summaries and ranked reports over a file table.

Every function takes a DataFrame with a key column and a text column.  The text
never crosses a shuffle: all position work is done inside the row, and only the
small findings are exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardenlake.functions import sensitive_patterns as sp
from wardenlake.functions.text import LOCATED, Spec, let, line_starts, located, matches, passes_luhn, strip
from wardenlake.functions.totals import merge_totals


RAW_HITS = "array<struct<type:string,raw:string>>"


def _regex(pattern: sp.Pattern, case_sensitive: bool) -> str:
    return ("(?mU)" if case_sensitive else sp.FLAGS) + pattern.regex


def _guard(pattern: sp.Pattern, text: Column) -> Column | None:
    return text.contains(pattern.prefilter) if pattern.prefilter else None


def _with_digit_guard(body: Column, patterns: list[sp.Pattern], scanned, array_type: str) -> Column:
    """Scan for all patterns; one digit test skips those that need a digit."""
    with_digit = scanned([p for p in patterns if p.type in sp.NEEDS_DIGIT])
    free = scanned([p for p in patterns if p.type not in sp.NEEDS_DIGIT])
    return F.concat(F.when(body.rlike(r"\p{Nd}"), with_digit).otherwise(F.array().cast(array_type)), free)


def _explode_hits(files: DataFrame, key: str, hits: Column) -> DataFrame:
    # A plain explode makes the optimizer add a size(hits) > 0 filter, which would
    # run every expression twice; the outer form with a filter after it does not.
    return files.select(F.col(key), F.explode_outer(hits).alias("hit")).filter(F.col("hit").isNotNull())


def _selected(types: list[str] | None) -> list[sp.Pattern]:
    return [p for p in sp.PATTERNS if types is None or p.type in types]


def redact(raw: Column, expose_raw: bool = False) -> Column:
    if expose_raw:
        return raw
    return F.when(F.length(raw) <= 4, F.lit("[REDACTED]")).otherwise(
        F.concat(F.lit("[REDACTED:"), F.length(raw).cast("string"), F.lit(" chars]")))


def fingerprint(raw: Column) -> Column:
    return F.substring(F.sha2(raw, 256), 1, 12)


def _context(line_text: Column, raw: Column) -> Column:
    return strip(F.replace(line_text, raw, F.lit("[REDACTED]")))


def pattern_table(spark) -> DataFrame:
    rows = [(p.type, p.severity, p.confidence, p.regulation, p.validator) for p in sp.PATTERNS]
    return spark.createDataFrame(rows, "type string, severity string, confidence string, regulation string, validator string")


def _describe(found: DataFrame) -> DataFrame:
    """Attach severity, confidence, regulation and advice through literal maps (18 entries)."""
    def lookup(attribute: str) -> Column:
        pairs = [F.lit(v) for p in sp.PATTERNS for v in (p.type, getattr(p, attribute))]
        return F.create_map(*pairs)[F.col("type")]

    advice = F.create_map(*[F.lit(v) for kv in sp.RECOMMENDATIONS.items() for v in kv])
    return (
        found.withColumn("severity", lookup("severity"))
        .withColumn("confidence", lookup("confidence"))
        .withColumn("regulation", lookup("regulation"))
        .withColumn("recommendation", F.replace(
            F.coalesce(advice[F.col("type")], F.lit(sp.DEFAULT_RECOMMENDATION)),
            F.lit("{regulation}"), F.col("regulation")))
    )


def findings_core(files: DataFrame, key: str, text: str = "content", types: list[str] | None = None,
                  case_sensitive: bool = False, expose_raw: bool = False) -> DataFrame:
    """One row per match without positions; the cheap form that summaries read."""
    body = F.col(text)

    def of_type(p: sp.Pattern) -> Column:
        valid = matches(body, _regex(p, case_sensitive))
        if p.validator == "luhn":
            valid = F.filter(valid, passes_luhn)
        rows = F.transform(valid, lambda m: F.struct(F.lit(p.type).alias("type"), m.alias("raw")))
        guard = _guard(p, body)
        return rows if guard is None else F.when(guard, rows)

    def scanned(patterns: list[sp.Pattern]) -> Column:
        empty = F.array().cast(RAW_HITS)
        return F.concat(empty, *[F.coalesce(of_type(p), empty) for p in patterns])

    hits = _with_digit_guard(body, _selected(types), scanned, RAW_HITS)
    found = _explode_hits(files, key, hits).select(key, "hit.type", "hit.raw")
    return _describe(found).select(
        key, "type", "severity", "confidence", "regulation",
        redact(F.col("raw"), expose_raw).alias("match"),
        fingerprint(F.col("raw")).alias("fingerprint"), "recommendation")


def findings(files: DataFrame, key: str, text: str = "content", types: list[str] | None = None,
             case_sensitive: bool = False, expose_raw: bool = False) -> DataFrame:
    """One row per match with line, column and redacted context."""
    body = F.col(text)

    def scanned(patterns: list[sp.Pattern]) -> Column:
        hits = located(body, [Spec(p.type, _regex(p, case_sensitive), 0, _guard(p, body)) for p in patterns])
        checked = [p.type for p in patterns if p.validator == "luhn"]
        if not checked:
            return hits
        return F.filter(hits, lambda m: ~m["tag"].isin(checked) | passes_luhn(m["raw"]))

    hits = _with_digit_guard(body, _selected(types), scanned, LOCATED)

    def place(lines: Column, found: Column) -> Column:
        return let(line_starts(lines), lambda starts: F.transform(found, lambda m: F.struct(
            m["tag"].alias("type"), m["raw"].alias("raw"),
            (m["newlines_before"] + 1).alias("line"),
            (m["start"] - F.get(starts, m["newlines_before"]) + 1).alias("column"),
            _context(F.get(lines, m["newlines_before"]), m["raw"]).alias("context"))))

    placed = let(hits, lambda found: F.when(F.size(found) > 0, let(F.split(body, "\n", -1),
                                                                   lambda lines: place(lines, found))))
    found = _explode_hits(files, key, placed).select(key, "hit.*")
    return _describe(found).select(
        key, "type", "severity", "confidence", "regulation", "line", "column",
        redact(F.col("raw"), expose_raw).alias("match"),
        fingerprint(F.col("raw")).alias("fingerprint"), "context", "recommendation")


def scan_totals(files: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Files scanned, files with findings, findings."""
    per_file = found.groupBy(key).agg(F.count("*").alias("n"))
    return merge_totals(
        files.agg(F.count("*").alias("files_scanned")),
        per_file.agg(F.count("*").alias("files_with_findings"), F.sum("n").alias("total_findings")))


def risk_score() -> Column:
    weight = F.create_map(*[F.lit(v) for kv in sp.SEVERITY_WEIGHT.items() for v in kv])
    return F.sum(weight[F.col("severity")]).alias("risk_score")


def summary_cells(found: DataFrame) -> DataFrame:
    """Findings per severity, regulation and type: what a summary is made of, and what upkeep changes."""
    return found.groupBy("severity", "regulation", "type").agg(F.count("*").alias("n"))


def scan_summary(found: DataFrame) -> DataFrame:
    """Counts per severity, per regulation, per type and overall, in one pass."""
    return summary_of(summary_cells(found))


def summary_of(cells: DataFrame) -> DataFrame:
    weight = F.create_map(*[F.lit(v) for kv in sp.SEVERITY_WEIGHT.items() for v in kv])
    weighted = cells.withColumn("score", F.col("n") * weight[F.col("severity")])
    return (
        weighted.groupingSets([["severity"], ["regulation"], ["type"], []], "severity", "regulation", "type")
        .agg(F.grouping_id().alias("level"), F.sum("n").alias("findings"), F.sum("score").alias("risk_score"))
        .select(
            F.when(F.col("level") == 3, "severity").when(F.col("level") == 5, "regulation")
            .when(F.col("level") == 6, "type").otherwise("all").alias("dimension"),
            F.coalesce("severity", "regulation", "type", F.lit("all")).alias("value"),
            "findings", "risk_score")
    )


def regulation_matrix(found: DataFrame) -> DataFrame:
    wide = found.groupBy("regulation").pivot("severity", sp.SEVERITIES).count()
    return wide.select("regulation", *[F.coalesce(s, F.lit(0)).alias(s.lower()) for s in sp.SEVERITIES])


def top_findings(found: DataFrame, order: list[str], k: int = 10,
                 severities: tuple[str, ...] = ("CRITICAL", "HIGH")) -> DataFrame:
    """First ``k`` findings per severity; Spark keeps only k rows per task before the shuffle."""
    ranking = Window.partitionBy("severity").orderBy(*order)
    return (found.filter(F.col("severity").isin(*severities))
            .withColumn("rank", F.row_number().over(ranking)).filter(F.col("rank") <= k))


def incremental_scan(files: DataFrame, key: str, checksum: str, manifest: DataFrame) -> DataFrame:
    """The files whose checksum is not the one recorded at the last scan."""
    known = manifest.select(F.col(key).alias("_k"), F.col(checksum).alias("_c"))
    return files.join(known, (files[key] == known["_k"]) & (files[checksum] == known["_c"]), "left_anti")


def touched_keys(files: DataFrame, key: str, checksum: str, manifest: DataFrame) -> DataFrame:
    """Keys whose stored findings no longer hold: files that changed and files that are gone."""
    changed = incremental_scan(files, key, checksum, manifest).select(key)
    gone = manifest.select(key).join(files.select(key), key, "left_anti")
    return changed.unionByName(gone).distinct()


def maintain_findings(found: DataFrame, files: DataFrame, key: str, checksum: str, manifest: DataFrame, text: str = "content") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored findings brought up to date: all findings now, those taken away, and those added.

    Only new and changed files are scanned again; the findings of changed and removed files are
    taken away.  The result equals a scan of all files.  ``manifest`` has the key and checksum of each
    file at the last scan, and a key stands once in both.
    """
    touched = touched_keys(files, key, checksum, manifest)
    taken = found.join(touched, key, "left_semi")
    added = findings_core(incremental_scan(files, key, checksum, manifest), key, text).select(*found.columns)
    return found.join(touched, key, "left_anti").unionByName(added), taken, added


def maintain_cells(cells: DataFrame, taken: DataFrame, added: DataFrame) -> DataFrame:
    """Stored summary cells less the findings taken away, and with those added; no other finding is read."""
    less = summary_cells(taken).withColumn("n", -F.col("n"))
    summed = cells.unionByName(less).unionByName(summary_cells(added)).groupBy("severity", "regulation", "type").agg(F.sum("n").alias("n"))
    return summed.filter("n > 0")
