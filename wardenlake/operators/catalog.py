"""Pattern catalog, coverage reports, test symbols and templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_REVIEWS = 3


def search_catalog(catalog: DataFrame, text: str | None = None, migration_type: str | None = None, tags: list[str] | None = None,
                   min_rating: float = 0.0, sort_by: str = "rating", limit: int | None = None) -> DataFrame:
    """Text in name, description or a tag; any of the tags; rating floor; best first."""
    found = catalog.filter(F.col("rating") >= min_rating)
    if text:
        needle = text.lower()
        found = found.filter(F.lower("name").contains(needle) | F.lower("description").contains(needle)
                             | F.exists("tags", lambda t: F.lower(t).contains(needle)))
    if migration_type:
        found = found.filter(F.col("migration_type") == migration_type)
    if tags:
        found = found.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    ordered = found.orderBy(F.desc(sort_by), "pattern_id")
    return ordered.limit(limit) if limit else ordered


def popular(catalog: DataFrame, k: int = 10) -> DataFrame:
    return catalog.orderBy(F.desc("downloads"), "pattern_id").limit(k)


def top_rated(catalog: DataFrame, k: int = 10) -> DataFrame:
    return catalog.filter(F.col("review_count") >= MIN_REVIEWS).orderBy(F.desc("rating"), "pattern_id").limit(k)


def fold_ratings(catalog: DataFrame, ratings: DataFrame) -> DataFrame:
    """Add valid ratings (0 to 5) to the stored mean and count."""
    added = ratings.filter(F.col("rating").between(0, 5)).groupBy("pattern_id").agg(
        F.sum("rating").alias("_sum"), F.count("*").alias("_n"))
    joined = catalog.join(added, "pattern_id", "left").fillna({"_sum": 0.0, "_n": 0})
    count = F.col("review_count") + F.col("_n")
    mean = (F.col("rating") * F.col("review_count") + F.col("_sum")) / count
    return (joined.withColumn("rating", F.when(count > 0, mean).otherwise(F.col("rating")))
            .withColumn("review_count", count).drop("_sum", "_n"))


def catalog_statistics(catalog: DataFrame) -> DataFrame:
    """Totals overall and per migration type; authors are grouped before they are counted."""
    per_author = catalog.groupBy("migration_type", "author").agg(
        F.count("*").alias("n"), F.sum("downloads").alias("d"), F.sum("rating").alias("r"), F.sum((F.col("rating") > 0).cast("int")).alias("rated"))
    return (per_author.groupingSets([["migration_type"], []], "migration_type").agg(
        F.sum("n").alias("patterns"), F.countDistinct("author").alias("authors"), F.sum("d").alias("downloads"), F.sum("r").alias("_r"), F.sum("rated").alias("_n"))
        .select(F.coalesce("migration_type", F.lit("ALL")).alias("migration_type"), "patterns", "authors", "downloads",
                F.when(F.col("_n") > 0, F.col("_r") / F.col("_n")).otherwise(0.0).alias("mean_rating")))


def coverage_grade(line: Column) -> Column:
    return F.when(line >= 90, "A").when(line >= 80, "B").when(line >= 70, "C").when(line >= 60, "D").otherwise("F")


def coverage_summary(coverage: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means in percent and the grade of the mean line coverage."""
    means = coverage.groupBy(*(by or [])).agg(
        F.count("*").alias("total_files"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"average_{c}") for c in ("line_coverage", "branch_coverage", "function_coverage")])
    return means.withColumn("overall_grade", coverage_grade(F.col("average_line_coverage")))


def under_covered(coverage: DataFrame, threshold: float = 80.0) -> DataFrame:
    return coverage.filter(F.col("line_coverage") < threshold).select("path", "line_coverage", "missing_lines")


def symbol_inventory(structures: DataFrame, scripts: DataFrame) -> DataFrame:
    """One row per symbol that a test stub would cover."""
    python = structures.filter("parsed").select("project", "path", F.explode(F.concat(
        F.transform("functions", lambda f: F.struct(F.lit("unit").alias("test_type"), f["name"].alias("symbol"))),
        F.transform("classes", lambda c: F.struct(F.lit("unit").alias("test_type"), c["name"].alias("symbol"))))).alias("s"))
    script = scripts.select("project", "path", F.explode(F.concat(
        F.transform("components", lambda c: F.struct(F.lit("component").alias("test_type"), c.alias("symbol"))),
        F.transform("functions", lambda f: F.struct(F.lit("unit").alias("test_type"), f.alias("symbol"))))).alias("s"))
    return python.unionByName(script).select("project", "path", "s.*")


def symbol_statistics(symbols: DataFrame) -> DataFrame:
    per_file = symbols.groupBy("project", "test_type", "path").agg(F.count("*").alias("n"))
    return per_file.groupBy("project", "test_type").agg(F.sum("n").alias("tests"), F.count("*").alias("files"))


def filter_templates(templates: DataFrame, test_type: str | None = None, language: str | None = None, tags: list[str] | None = None) -> DataFrame:
    found = templates
    if test_type:
        found = found.filter(F.col("test_type") == test_type)
    if language:
        found = found.filter(F.col("language") == language)
    if tags:
        found = found.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    return found


def template_counts(templates: DataFrame) -> DataFrame:
    return templates.groupBy("test_type", "language").agg(F.count("*").alias("templates"))
