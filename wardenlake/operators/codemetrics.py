"""Code structure and complexity over a file table (project, path, ext, content).

Parsing runs once per file inside ``mapInArrow``; everything after it is grouped
Spark work on the per-file rows, which no longer hold the text.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenlake.sources.corpus import SCAN_SKIP_DIRS, in_dirs

STRUCTURE_SCHEMA = """
project string, path string, ext string, size_bytes bigint, line_count int, parsed boolean, error string,
complexity int, cognitive int, docstring string, format_calls int,
functions array<struct<name:string,line:int,args:array<string>,complexity:int>>,
classes array<struct<name:string,line:int,methods:array<string>>>,
imports array<struct<module:string,line:int>>
"""

_BRANCHES = (ast.If, ast.While, ast.For, ast.AsyncFor, ast.ExceptHandler, ast.With, ast.AsyncWith,
             ast.ListComp, ast.DictComp, ast.SetComp, ast.GeneratorExp)
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


# Fields that hold no statement or expression: contexts and operators count for nothing here.
_PLAIN_FIELDS = {"ctx", "op", "ops"}


def _walk(tree: ast.AST) -> tuple[list[ast.AST], list[int]]:
    """The nodes in the order of ``ast.walk``, without contexts and operators, and the place of each one's parent."""
    nodes, parents, known = [tree], [-1], {}
    for at, node in enumerate(nodes):  # the list grows while it is read
        kind = node.__class__
        fields = known.get(kind)
        if fields is None:
            fields = known[kind] = [f for f in kind._fields if f not in _PLAIN_FIELDS]
        for name in fields:
            value = getattr(node, name, None)
            if value.__class__ is list:
                inner = [v for v in value if isinstance(v, ast.AST)]
                nodes += inner
                parents += [at] * len(inner)
            elif isinstance(value, ast.AST):
                nodes.append(value)
                parents.append(at)
    return nodes, parents


def _cyclomatic(nodes: list[ast.AST], parents: list[int]) -> list[int]:
    """One more than the branches and further operands at and below each node; a child stands behind its parent, so one pass sums up."""
    below = [1 if isinstance(n, _BRANCHES) else len(n.values) - 1 if isinstance(n, ast.BoolOp) else 0 for n in nodes]
    for at in range(len(nodes) - 1, 0, -1):
        below[parents[at]] += below[at]
    return [1 + b for b in below]


def _cognitive(nodes: list[ast.AST]) -> int:
    """A counter over the breadth-first walk; each block raises the price of later ones."""
    score = depth = 0
    for node in nodes:
        if isinstance(node, ast.BoolOp):
            score += len(node.values) - 1 + depth
        elif isinstance(node, (ast.If, ast.While, ast.For, ast.With, ast.ExceptHandler, ast.ListComp)):
            score += 1 + depth
            depth += not isinstance(node, (ast.ExceptHandler, ast.ListComp))
    return score


def _parse(content: str, max_bytes: int | None = None) -> dict:
    """Structure of one Python text, or the reason it has none.  Nothing is executed."""
    lines = content.count("\n") + 1
    row = {"line_count": lines, "parsed": False, "error": None, "complexity": 0, "cognitive": 0, "docstring": None,
           "format_calls": 0, "functions": [], "classes": [], "imports": []}
    if max_bytes is not None and len(content.encode()) > max_bytes:
        return row | {"error": "too large"}
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as problem:
        return row | {"error": f"{type(problem).__name__}: {getattr(problem, 'msg', problem)}"}
    nodes, parents = _walk(tree)
    functions = [{"name": n.name, "line": n.lineno, "args": [a.arg for a in n.args.args], "complexity": c}
                 for n, c in zip(nodes, _cyclomatic(nodes, parents)) if isinstance(n, _FUNCTIONS)]
    classes = [{"name": n.name, "line": n.lineno, "methods": [m.name for m in n.body if isinstance(m, _FUNCTIONS)]}
               for n in nodes if isinstance(n, ast.ClassDef)]
    imports = [{"module": a.name, "line": n.lineno} for n in nodes if isinstance(n, ast.Import) for a in n.names]
    imports += [{"module": n.module, "line": n.lineno} for n in nodes if isinstance(n, ast.ImportFrom) and n.module]
    text = ast.get_docstring(tree)
    return row | {
        "parsed": True, "functions": functions, "classes": classes, "imports": imports,
        "complexity": sum(f["complexity"] for f in functions), "cognitive": _cognitive(nodes),
        "docstring": text,
        "format_calls": sum(isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr == "format" for n in nodes),
    }


def structure(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """One row per Python file with its functions, classes, imports and errors.

    A file above ``max_bytes``, if that is given, has a row with an error.
    """

    made = pa.schema(_PARSED_TYPES)

    def parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = pa.RecordBatch.from_pylist([_parse(text, max_bytes) for text in batch["content"].to_pylist()], made)
            kept = batch.drop_columns(["content"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *parsed.columns], names=[*kept.schema.names, *made.names])

    python = files.filter((F.col("ext") == ".py") & ~in_dirs(F.col("path"), SCAN_SKIP_DIRS)).select(
        "project", "path", "ext", F.octet_length("content").cast("bigint").alias("size_bytes"), "content")
    return python.mapInArrow(parse_batches, STRUCTURE_SCHEMA)


_FUNCTION = pa.struct([("name", pa.string()), ("line", pa.int32()), ("args", pa.list_(pa.string())), ("complexity", pa.int32())])
_CLASS = pa.struct([("name", pa.string()), ("line", pa.int32()), ("methods", pa.list_(pa.string()))])
_IMPORT = pa.struct([("module", pa.string()), ("line", pa.int32())])
_PARSED_TYPES = {  # by name, in the order of STRUCTURE_SCHEMA
    "line_count": pa.int32(), "parsed": pa.bool_(), "error": pa.string(), "complexity": pa.int32(), "cognitive": pa.int32(), "docstring": pa.string(),
    "format_calls": pa.int32(), "functions": pa.list_(_FUNCTION), "classes": pa.list_(_CLASS), "imports": pa.list_(_IMPORT)}


def functions_of(structures: DataFrame) -> DataFrame:
    return structures.select("project", "path", F.explode("functions").alias("f")).select("project", "path", "f.*")


def imports_of(structures: DataFrame) -> DataFrame:
    return structures.select("project", "path", F.explode("imports").alias("i")).select("project", "path", "i.*")


def corpus_aggregate(structures: DataFrame, by: list[str]) -> DataFrame:
    """Totals per project, with both averages: per file and per function."""
    ok = F.col("parsed")

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(F.when(ok, value)), F.lit(0))

    sums = structures.groupBy(*by).agg(
        F.sum(ok.cast("int")).alias("files_analyzed"), F.sum((~ok).cast("int")).alias("errors"),
        total(F.col("line_count")).alias("total_lines"), total(F.col("size_bytes")).alias("total_size"),
        total(F.col("complexity")).alias("total_complexity"), total(F.size("functions")).alias("total_functions"),
        total(F.size("classes")).alias("total_classes"), total(F.size("imports")).alias("total_imports"))
    files, functions = F.greatest("files_analyzed", F.lit(1)), F.greatest("total_functions", F.lit(1))
    return (sums.withColumn("avg_complexity_per_file", F.col("total_complexity") / files)
            .withColumn("avg_lines_per_file", F.col("total_lines") / files)
            .withColumn("avg_complexity_per_function", F.col("total_complexity") / functions)
            .withColumn("avg_lines_per_function", F.col("total_lines") / functions)
            .withColumn("maintainability_index", maintainability(F.col("total_lines"), F.col("total_complexity"), F.col("total_functions")))
            .withColumn("technical_debt_hours", technical_debt(F.col("total_complexity"), F.col("total_lines"), F.col("files_analyzed"))))


def raw_index(lines: Column, complexity: Column, functions: Column) -> Column:
    """The maintainability index before it is held between 0 and 100, which tells small files apart."""
    return F.lit(171.0) - 5.2 * F.pow(lines.cast("double"), F.lit(0.23)) - 0.23 * complexity - 16.2 * F.sqrt(functions.cast("double"))


def maintainability(lines: Column, complexity: Column, functions: Column) -> Column:
    index = raw_index(lines, complexity, functions)
    return F.when((functions == 0) | (lines <= 0), F.lit(100.0)).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), index)))


def technical_debt(complexity: Column, lines: Column, files: Column) -> Column:
    from_complexity = F.when(complexity > 1000, (complexity - 1000) * 0.1).when(complexity > 500, (complexity - 500) * 0.05).otherwise(0.0)
    from_size = F.when(lines > 50000, (lines - 50000) / 1000 * 2).otherwise(0.0)
    from_files = F.when(files > 100, (files - 100) * 0.5).otherwise(0.0)
    return F.round(from_complexity + from_size + from_files, 1)


def dependency_list(structures: DataFrame) -> DataFrame:
    """Sorted distinct modules per file; bounded by the imports one file can hold."""
    return structures.filter("parsed").select(
        "project", "path", F.sort_array(F.array_distinct(F.transform("imports", lambda i: i["module"]))).alias("modules"))


def complexity_distribution(structures: DataFrame) -> DataFrame:
    c = F.col("complexity")
    bucket = F.when(c <= 5, "simple").when(c <= 10, "moderate").when(c <= 20, "complex").otherwise("very_complex")
    names = ["simple", "moderate", "complex", "very_complex"]
    return functions_of(structures).groupBy("project").agg(*[F.sum((bucket == n).cast("int")).alias(n) for n in names])


def complexity_level(total: Column) -> Column:
    return F.when(total <= 10, "LOW").when(total <= 20, "MEDIUM").when(total <= 50, "HIGH").otherwise("VERY_HIGH")


def file_metrics(structures: DataFrame) -> DataFrame:
    index = F.col("line_count"), F.col("complexity"), F.size("functions")
    return structures.filter("parsed").select(
        "project", "path", "line_count", F.size("functions").alias("functions_count"), F.size("classes").alias("classes_count"),
        F.col("complexity").alias("cyclomatic"), "cognitive", complexity_level(F.col("complexity")).alias("level"),
        raw_index(*index).alias("index_raw"), maintainability(*index).alias("maintainability_index"))


def most_complex(structures: DataFrame, k: int = 5) -> DataFrame:
    return structures.filter("parsed").select("project", "path", "complexity").orderBy(F.desc("complexity"), "path").limit(k)


# Component and function forms of JavaScript.
COMPONENT_PATTERN = r"(?U)(?:export\s+)?(?:default\s+)?(?:class|function)\s+(\w+)"
FUNCTION_PATTERN = r"(?U)(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:\([^)]*\)\s*=>|function)"
SCRIPT_EXTENSIONS = [".js", ".jsx", ".ts", ".tsx"]


def script_structure(files: DataFrame) -> DataFrame:
    """Line count and component/function names of JavaScript files, by expression."""
    text = F.col("content")
    lines = F.size(F.split(F.regexp_replace(text, r"\n$", ""), "\n", -1))
    return files.filter(F.col("ext").isin(SCRIPT_EXTENSIONS)).select(
        "project", "path", "ext", F.when(text == "", 0).otherwise(lines).alias("line_count"),
        F.regexp_extract_all(text, F.lit(COMPONENT_PATTERN), F.lit(1)).alias("components"),
        F.regexp_extract_all(text, F.lit(FUNCTION_PATTERN), F.lit(1)).alias("functions"))


def issue_rules(files: DataFrame) -> DataFrame:
    """Rows of matched old-style rules per file."""
    text, ext = F.col("content"), F.col("ext")
    script, python = ext.isin(SCRIPT_EXTENSIONS), ext == ".py"
    rules = [
        (script & (text.rlike(r"class\s+\w+\s+extends\s+(?:React\.)?Component") | text.contains("createClass")), "class_component", "INFO", ""),
        *[(script & text.contains(m), "lifecycle_method", "INFO", m) for m in ("componentDidMount", "componentWillUnmount", "componentDidUpdate")],
        (script & text.contains("this.setState"), "set_state", "INFO", ""),
        (python & text.contains("print ") & ~text.contains("print("), "python2_print", "ERROR", ""),
        (python & text.rlike(r"/\s*\d+"), "integer_division", "WARNING", ""),
    ]
    hits = F.array_compact(F.array(*[
        F.when(condition, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(detail).alias("detail")))
        for condition, kind, severity, detail in rules]))
    return (files.select("project", "path", F.explode_outer(hits).alias("hit")).filter(F.col("hit").isNotNull())
            .select("project", "path", "hit.*"))


def advice_steps(files: DataFrame, structures: DataFrame) -> DataFrame:
    """Modernisation steps and breaking changes per file."""
    from_parse = structures.select("project", "path", F.explode_outer(F.array_compact(F.array(
        F.when(~F.col("parsed"), F.struct(F.lit("breaking_change").alias("kind"), F.lit("syntax_error").alias("step"), F.lit(1).alias("times"))),
        F.when(F.col("format_calls") > 0, F.struct(F.lit("step").alias("kind"), F.lit("use_f_string").alias("step"), F.col("format_calls").alias("times"))),
    ))).alias("s"))
    text = F.col("content")
    # A file that does not parse has no text steps; a component needs a render body.
    component = text.rlike(r"class\s+\w+\s+extends\s+(?:React\.)?Component\s*\{") & text.rlike(r"render\s*\(\)\s*\{[\s\S]*?\}")
    script = F.col("ext").isin(SCRIPT_EXTENSIONS) & component

    def when(condition: Column, kind: str, step: str) -> Column:
        return F.when(condition, F.struct(F.lit(kind).alias("kind"), F.lit(step).alias("step"), F.lit(1).alias("times")))

    from_text = files.select("project", "path", F.explode_outer(F.array_compact(F.array(
        when((F.col("ext") == ".py") & text.contains("xrange("), "step", "replace_xrange"),
        when(script, "step", "class_to_function"),
        when(script & text.contains("this.state"), "breaking_change", "state"),
        when(script & text.contains("componentDidMount"), "breaking_change", "lifecycle")))).alias("s"))
    broken = structures.filter(~F.col("parsed")).select("project", "path")
    text_rows = from_text.filter(F.col("s").isNotNull()).join(broken, ["project", "path"], "left_anti")
    return from_parse.filter(F.col("s").isNotNull()).unionByName(text_rows).select("project", "path", "s.*")
