"""Migration confidence and risk over many projects at once.

Inputs: ``files(project, path, ext, content)`` and the per-file structure rows of
``codemetrics.structure``.  Every result has one or more rows per project.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardenlake.functions.text import contains_any, literal_count

# Factor weights (sum 1.0).
WEIGHTS = {"test_coverage": 0.25, "complexity": 0.20, "dependencies": 0.15, "code_quality": 0.15,
           "breaking_changes": 0.15, "team_experience": 0.10}
# Migration type, complexity multiplier, base hours per file, file extensions.
MIGRATIONS = [
    ("react-hooks", 1.0, 0.5, [".js", ".jsx", ".ts", ".tsx"]),
    ("vue3", 1.2, 0.75, [".vue", ".js"]),
    ("python3", 0.8, 0.4, [".py"]),
    ("typescript", 1.5, 1.0, [".js", ".jsx"]),
    ("graphql", 1.8, 1.5, [".js", ".jsx", ".py", ".vue"]),
    ("angular", 1.6, 1.2, [".js", ".ts"]),
    ("svelte", 1.1, 0.6, [".js", ".jsx", ".py", ".vue"]),
]
# Literals whose occurrences mark breaking changes, per migration type.
BREAKING = {
    "react-hooks": ["componentDidMount", "componentWillUnmount", "componentDidUpdate", "this.state", "this.props",
                    "componentWillMount", "componentWillReceiveProps"],
    "vue3": ["Vue.component", "new Vue", "$on", "$off", "$once", "beforeDestroy", "destroyed", "filters"],
    "python3": ["print ", "xrange", "urllib2", "raw_input", "basestring", "has_key", "iteritems"],
    "typescript": ["var ", "function(", ": any", "any[]", "PropTypes", "React.createClass"],
    "angular": ["$scope", "$http", "controller(", "directive(", ".service(", ".factory("],
}
# The shorter lists of the risk register.
RISK_BREAKING = {
    "react-hooks": ["componentDidMount", "componentWillUnmount", "componentDidUpdate", "this.state", "this.props"],
    "vue3": ["Vue.component", "new Vue", "$on", "$off", "$once"],
    "python3": ["print ", "xrange", "urllib2", "raw_input"],
    "typescript": ["var ", "function(", ": any"],
}
RISK_EXTENSIONS = [".py", ".js", ".jsx", ".ts", ".tsx", ".vue"]
SOURCE_EXTENSIONS = [".py", ".js", ".jsx", ".ts", ".tsx"]
# Names of test files, forms of secrets and personal data, words of unsafe execution.
TEST_NAME = r"(^|/)(test_[^/]*\.py|[^/]*_test\.py|[^/]*\.test\.js|[^/]*\.test\.ts|[^/]*\.spec\.ts|[^/]*\.spec\.tsx)$"
SECRET_PATTERN = r"""(?iu)(password|api_key|secret|token)\s*=\s*["'][^"']+["']"""
PERSONAL_PATTERN = (r"(?U)\b\d{3}-\d{2}-\d{4}\b|\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
                    r"|\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b")
UNSAFE_WORDS = ["eval", "exec", "compile", "__import__"]
OVERHEAD, HOURLY_RATE = 1.3, 100


def secret_file(content: Column) -> Column:
    return content.rlike(SECRET_PATTERN)


def pii_file(content: Column) -> Column:
    return content.rlike(PERSONAL_PATTERN)


def migration_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MIGRATIONS, "migration_type string, multiplier double, base_hours double, extensions array<string>")


def _band(value: Column, steps: list[tuple[float, int]], otherwise: int, below: bool = True) -> Column:
    out = None
    for limit, score in steps:
        condition = value < limit if below else value >= limit
        out = F.when(condition, score) if out is None else out.when(condition, score)
    return out.otherwise(otherwise)


# Files that list requirements, the first that is there counts.
REQUIREMENT_FILES = ["requirements.txt", "requirements-dev.txt", "Pipfile"]


def breaking_occurrences(migration_type: str) -> Column:
    return sum((literal_count(F.col("content"), p) for p in BREAKING.get(migration_type, [])), F.lit(0))


def _extensions(migration_type: str) -> list[str]:
    return next(m[3] for m in MIGRATIONS if m[0] == migration_type)


def _requirement_counts() -> Column:
    """Counted, pinned and constrained lines of a requirements text."""
    lines = F.filter(F.transform(F.split("content", "\n"), F.trim), lambda s: (s != "") & ~s.startswith("#"))
    pinned = F.filter(lines, lambda s: s.contains("==") | s.startswith("-e ") | s.startswith("git+"))
    constrained = F.filter(lines, lambda s: contains_any(s, ["==", ">=", "<=", "~=", "<"]))
    return F.struct(F.size(lines).alias("n"), F.size(pinned).alias("pinned"), F.size(constrained).alias("constrained"))


def file_facts(files: DataFrame, migration_type: str) -> DataFrame:
    """Everything the scores need from the files, in one grouping by project."""
    source = F.col("ext").isin(SOURCE_EXTENSIONS) & ~F.col("path").rlike(r"(^|/)(node_modules|\.venv)(/|$)")
    target = F.col("ext").isin(_extensions(migration_type))
    order = F.array_position(F.array(*[F.lit(n) for n in REQUIREMENT_FILES]), F.col("path"))
    required = order > 0
    return files.groupBy("project").agg(
        F.sum(F.col("path").rlike(TEST_NAME).cast("int")).alias("tests"), F.sum(source.cast("int")).alias("sources"),
        F.sum(target.cast("int")).alias("file_count"), F.avg(F.when(target, breaking_occurrences(migration_type))).alias("mean_breaking"),
        F.min_by(F.when(required, _requirement_counts()), F.when(required, order)).alias("requirements"))


def structure_facts(structures: DataFrame) -> DataFrame:
    """Everything the scores need from the parsed files, in one grouping by project."""
    return structures.groupBy("project").agg(
        F.sum(F.col("parsed").cast("int")).alias("parsed_files"), F.sum(F.when(F.col("parsed"), F.col("complexity"))).alias("total_complexity"),
        F.sum((~F.col("parsed")).cast("int")).alias("syntax_errors"), F.sum((F.col("line_count") > 1000).cast("int")).alias("long_files"))


def test_presence() -> Column:
    """85/70/55/40 by the share of test files; 30 without tests, 50 without sources."""
    ratio = F.col("tests") / F.greatest("sources", F.lit(1))
    return F.when(F.col("sources") == 0, 50).when(F.col("tests") == 0, 30).otherwise(_band(ratio, [(0.5, 85), (0.25, 70), (0.1, 55)], 40, below=False))


def complexity_score() -> Column:
    mean = F.col("total_complexity") / F.col("parsed_files")
    return F.when(F.coalesce("parsed_files", F.lit(0)) == 0, 50).otherwise(_band(mean, [(5, 90), (10, 70), (20, 50)], 30))


def dependency_score() -> Column:
    """40 without a requirements file, 60 for an empty one."""
    r = F.col("requirements")
    bonus = F.least(F.lit(15), F.floor(r["pinned"] / r["n"] * 15))
    score = F.floor(45 + r["constrained"] / r["n"] * 35 + bonus).cast("int")
    return F.when(r.isNull(), 40).when(r["n"] == 0, 60).otherwise(F.greatest(F.lit(35), F.least(F.lit(95), score)))


def quality_score() -> Column:
    scored = F.greatest(F.lit(30), F.least(F.lit(90), 90 - 25 * F.col("syntax_errors") - 5 * F.col("long_files"))).cast("int")
    return F.when(F.col("syntax_errors").isNull(), 70).otherwise(scored)


def breaking_score(migration_type: str) -> Column:
    mean = F.col("mean_breaking")
    if migration_type not in BREAKING:
        return F.lit(50)
    return F.when(mean.isNull(), 50).otherwise(_band(mean, [(2, 90), (5, 70), (10, 50)], 30))


def breaking_counts(files: DataFrame, migration_type: str) -> DataFrame:
    """Occurrences of breaking literals per file of the type's extensions."""
    return files.filter(F.col("ext").isin(_extensions(migration_type))).select("project", "path", breaking_occurrences(migration_type).alias("occurrences"))


def factor_table(files: DataFrame, structures: DataFrame, migration_type: str, team_experience: int = 50) -> DataFrame:
    """One row per project with the six factors and its file count.

    Files and parsed files are each grouped once; only per-project rows are joined.
    """
    facts = file_facts(files, migration_type).join(structure_facts(structures), "project", "left")
    return facts.select("project", test_presence().alias("test_coverage"), complexity_score().alias("complexity"), dependency_score().alias("dependencies"),
                        quality_score().alias("code_quality"), breaking_score(migration_type).alias("breaking_changes"),
                        F.lit(team_experience).alias("team_experience"), "file_count")


def weighted_score(factors: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    weights = weights or WEIGHTS
    if abs(sum(weights.values()) - 1.0) > 1e-9:
        raise ValueError("weights must sum to 1.0")
    return factors.withColumn("overall", F.round(sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0)), 6))


def risk_level(score: Column) -> Column:
    return F.when(score >= 80, "LOW").when(score >= 60, "MEDIUM").when(score >= 40, "HIGH").otherwise("CRITICAL")


def confidence(files: DataFrame, structures: DataFrame, migration_type: str, team_experience: int = 50,
               weights: dict[str, float] | None = None) -> DataFrame:
    """Score, level, complexity class, hours and cost per project."""
    _, multiplier, base_hours, _ = next(m for m in MIGRATIONS if m[0] == migration_type)
    scored = weighted_score(factor_table(files, structures, migration_type, team_experience), weights)
    penalty = (F.when(F.col("complexity") < 50, 0.3).otherwise(0.0) + F.when(F.col("breaking_changes") < 50, 0.2).otherwise(0.0)
               + F.when(F.col("dependencies") < 50, 0.1).otherwise(0.0))
    final = F.round(multiplier * (1 + penalty), 6)
    hours = F.col("file_count") * base_hours * (1 + (100 - F.col("overall")) / 50) * multiplier * OVERHEAD
    return (scored.select(
        "project", F.floor("overall").cast("int").alias("overall_score"), risk_level(F.col("overall")).alias("risk_level"),
        F.when(final < 0.8, "SIMPLE").when(final < 1.2, "MODERATE").when(final < 1.6, "COMPLEX").otherwise("VERY_COMPLEX").alias("migration_complexity"),
        "file_count", F.round(hours, 1).alias("estimated_hours"))
        .withColumn("estimated_cost", F.round(F.col("estimated_hours") * HOURLY_RATE, 1)))


# Factor, upper limit, lower limit, kind, message.
THRESHOLD_RULES = [
    ("test_coverage", 30, 0, "blocker", "❌ BLOCKER: Test coverage is critically low (<30%). Add tests before migration to ensure correctness."),
    ("test_coverage", 60, 30, "warning", "⚠️  WARNING: Test coverage is below recommended level (60%). Consider adding more tests."),
    ("complexity", 40, 0, "warning", "⚠️  WARNING: High code complexity detected. Refactor complex functions before migration."),
    ("dependencies", 50, 0, "blocker", "❌ BLOCKER: Security vulnerabilities found in dependencies. Update vulnerable packages before migration."),
    ("code_quality", 50, 0, "warning", "⚠️  WARNING: Code quality issues detected. Run linters and fix issues first."),
    ("breaking_changes", 40, 0, "warning", "⚠️  WARNING: Many breaking changes expected. Plan for extensive testing and validation."),
]
# Advice that every project gets.
RECOMMENDATIONS = [
    "✓ Create a dedicated feature branch for migration",
    "✓ Set up staging environment for testing",
    "✓ Plan for incremental rollout (not big-bang)",
    "✓ Document all manual steps required",
    "✓ Schedule team code review sessions",
    "✓ Prepare rollback strategy before starting",
]


def messages(factors: DataFrame) -> DataFrame:
    """Blockers, warnings and recommendations per project; a recommendation has no factor."""
    def message(kind: str, factor: str | None, text: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(factor).cast("string").alias("factor"), F.lit(text).alias("message"))

    hits = [F.when((F.col(f) < upper) & (F.col(f) >= lower), message(kind, f, text)) for f, upper, lower, kind, text in THRESHOLD_RULES]
    general = [message("recommendation", None, text) for text in RECOMMENDATIONS]
    return factors.select("project", F.explode(F.array_compact(F.array(*hits, *general))).alias("m")).select("project", "m.*")


def unpinned_requirements(files: DataFrame) -> DataFrame:
    line = F.trim("line")
    lines = files.filter(F.col("path") == "requirements.txt").select("project", F.explode(F.split("content", "\n")).alias("line"))
    return lines.select("project", line.alias("line")).filter(
        (F.col("line") != "") & ~F.col("line").startswith("#") & ~contains_any(F.col("line"), ["==", ">=", "<="]))


def high_risk_files(files: DataFrame, migration_type: str) -> DataFrame:
    patterns = RISK_BREAKING.get(migration_type, [])
    if not patterns:
        return files.select("project", "path").limit(0)
    return files.filter(F.col("ext").isin(RISK_EXTENSIONS) & contains_any(F.col("content"), patterns)).select("project", "path")


# Title, category, level, probability, impact, mitigation.
REGISTER = {
    "high_complexity": ("High Code Complexity", "TECHNICAL", "HIGH", 80, 70,
                        "Refactor complex functions before migration. Break down large functions into smaller, testable units."),
    "moderate_complexity": ("Moderate Code Complexity", "TECHNICAL", "MEDIUM", 60, 50,
                            "Consider refactoring the most complex functions before migration."),
    "breaking": ("Breaking Changes Required", "TECHNICAL", "HIGH", 90, 80,
                 "Plan for incremental migration. Create compatibility layers where possible."),
    "unpinned": ("Unpinned Dependencies", "TECHNICAL", "MEDIUM", 60, 65,
                 "Pin all dependency versions to prevent unexpected breaking changes."),
    "secrets": ("Hardcoded Secrets Detected", "SECURITY", "CRITICAL", 95, 90,
                "Remove all hardcoded secrets and use environment variables or secret management systems."),
    "unsafe": ("Unsafe Code Execution", "SECURITY", "HIGH", 70, 85,
               "Review and remove unsafe code execution patterns. Use safer alternatives."),
    "learning": ("Team Learning Curve", "OPERATIONAL", "MEDIUM", 70, 60,
                 "Schedule training sessions. Start with a pilot migration. Consider hiring experienced consultants."),
    "downtime": ("Potential Downtime", "BUSINESS", "HIGH", 60, 80,
                 "Plan migration during low-traffic periods. Use blue-green deployment. Have rollback plan ready."),
    "experience": ("User Experience Impact", "BUSINESS", "MEDIUM", 50, 70,
                   "Communicate changes to users in advance. Provide support during transition. Test thoroughly."),
    "personal_data": ("PII Data Detected", "COMPLIANCE", "HIGH", 85, 90,
                      "Review and secure all PII data. Ensure compliance with GDPR/CCPA. Implement data anonymization."),
}
RISK_FIELDS = ["title", "category", "level", "probability", "impact", "mitigation"]


def risk_files(files: DataFrame, migration_type: str) -> DataFrame:
    """(project, path, rule) for each content rule that a file meets."""
    text, ext = F.col("content"), F.col("ext")
    code = ext.isin(RISK_EXTENSIONS)
    breaking = contains_any(text, RISK_BREAKING[migration_type]) if migration_type in RISK_BREAKING else F.lit(False)
    flags = F.array_compact(F.array(
        F.when(code & breaking, F.lit("breaking")), F.when(code & secret_file(text), F.lit("secrets")),
        F.when((ext == ".py") & contains_any(text, UNSAFE_WORDS), F.lit("unsafe")), F.when(code & pii_file(text), F.lit("personal_data"))))
    return files.select("project", "path", F.explode(flags).alias("rule"))


def risk_register(files: DataFrame, structures: DataFrame, migration_type: str, listed: int = 5) -> DataFrame:
    """One row per project and risk.

    Each file is tested once for all content rules; a rule then groups its files.
    The first ``listed`` paths by name are shown, kept with a bounded sort per task; ``risk_files`` has them all.
    """
    flagged = risk_files(files, migration_type)
    flagged = flagged.withColumn("_r", F.row_number().over(Window.partitionBy("project", "rule").orderBy("path"))).filter(F.col("_r") <= listed)
    from_files = (flagged.groupBy("project", "rule").agg(F.sort_array(F.collect_list("path")).alias("file_paths")))
    none = F.array().cast("array<string>")
    mean = F.col("c") / F.col("n")
    averages = structures.filter("parsed").groupBy("project").agg(F.sum("complexity").alias("c"), F.count("*").alias("n"))
    from_complexity = averages.select("project", F.when(mean > 20, "high_complexity").when(mean > 10, "moderate_complexity").alias("rule"),
                                      none.alias("file_paths")).filter(F.col("rule").isNotNull())
    from_pins = unpinned_requirements(files).select("project").distinct().select(
        "project", F.lit("unpinned").alias("rule"), F.array(F.lit("requirements.txt")).alias("file_paths"))
    always = files.select("project").distinct().select(
        "project", F.explode(F.array(F.lit("learning"), F.lit("downtime"), F.lit("experience"))).alias("rule"), none.alias("file_paths"))
    rows = from_files.unionByName(from_complexity).unionByName(from_pins).unionByName(always)
    facts = F.create_map(*[v for rule, values in REGISTER.items() for v in (
        F.lit(rule), F.struct(*[F.lit(value).alias(name) for name, value in zip(RISK_FIELDS, values)]))])
    return rows.select("project", "rule", facts[F.col("rule")].alias("f"), "file_paths").select("project", "f.*", "file_paths")


def ranked_risks(register: DataFrame) -> DataFrame:
    # A project has at most eleven risks, so each window group is tiny.
    order = Window.partitionBy("project").orderBy(F.desc(F.col("probability") * F.col("impact")), "title")
    return register.withColumn("rank", F.row_number().over(order))


def risk_rollup(register: DataFrame) -> DataFrame:
    return (register.rollup("category", "level").agg(
        F.count("*").alias("risks"), F.round(F.avg(F.col("probability") * F.col("impact") / 100), 4).alias("mean_score"))
        .select(F.coalesce("category", F.lit("ALL")).alias("category"), F.coalesce("level", F.lit("ALL")).alias("level"), "risks", "mean_score"))
