"""Rewrite job: class components to functions, with diff, summary and no-op check."""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REWRITE_SCHEMA = "project string, path string, ext string, content string, new_content string, changed boolean, diff string, error string"

# Expressions that find a component and its render body.
_COMPONENT = re.compile(r"class\s+(\w+)\s+extends\s+(?:React\.)?Component\s*{")
_RENDER = re.compile(r"render\s*\(\)\s*{")
_BRACE = re.compile(r"[{}]")
# Fixed value: the output text of the rewrite.
_OUTPUT = """import React, {{ useState, useEffect }} from 'react';

const {name} = (props) => {{
{note}

  {body}
}};

export default {name};
"""
_STATE_NOTE = ("\n  // TODO: Migrate state manually or use advanced ast-migrator"
               "\n  // const [state, setState] = useState(initialState);")


def _closing_brace(text: str, start: int) -> int | None:
    """Index of the brace that closes the one before ``start``."""
    depth = 1
    for brace in _BRACE.finditer(text, start):
        depth += 1 if brace.group() == "{" else -1
        if depth == 0:
            return brace.start()
    return None


def component_to_function(text: str) -> str:
    component = _COMPONENT.search(text)
    render = component and _RENDER.search(text)
    end = render and _closing_brace(text, render.end())
    if not end:
        return text
    body = text[render.end():end].strip().replace("this.props", "props")
    note = _STATE_NOTE if "this.state" in text else ""
    return _OUTPUT.format(name=component.group(1), note=note, body=body)


# Registered rewriters: name → (extensions, text function).
REWRITERS: dict[str, tuple[list[str], Callable[[str], str]]] = {
    "react-hooks": ([".jsx", ".tsx", ".js", ".ts"], component_to_function),
}


def register_rewriter(name: str, extensions: list[str], rewrite: Callable[[str], str]) -> None:
    """Add a rewriter; it must be a module-level function so that tasks can load it."""
    REWRITERS[name] = (extensions, rewrite)


def can_migrate(name: str) -> Column:
    return F.lower("ext").isin(REWRITERS[name][0])


def candidates(files: DataFrame, name: str) -> DataFrame:
    return files.filter(can_migrate(name))


def rewrite(files: DataFrame, name: str) -> DataFrame:
    """New text, change flag, unified diff and per-file error for every candidate."""
    change = REWRITERS[name][1]

    def one(path: str, text: str) -> tuple[str, bool, str, str | None]:
        try:
            new = change(text)
        except Exception as problem:  # one bad file must not fail the job
            return text, False, "", str(problem)
        diff = "\n".join(difflib.unified_diff(text.splitlines(), new.splitlines(), path, path, lineterm="")) if new != text else ""
        return new, new != text, diff, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [one(p, t) for p, t in zip(batch["path"], batch["content"])]
            yield batch.assign(**dict(zip(["new_content", "changed", "diff", "error"], map(list, zip(*out)))) if out else
                               {"new_content": [], "changed": [], "diff": [], "error": []})

    return candidates(files, name).select("project", "path", "ext", "content").mapInPandas(run, REWRITE_SCHEMA)


def change_summary(rewritten: DataFrame) -> DataFrame:
    return rewritten.groupBy("project").agg(
        F.count("*").alias("total_candidates"), F.sum(F.col("changed").cast("int")).alias("changed_files"),
        F.sum(F.col("error").isNotNull().cast("int")).alias("failed_files"))


def apply_rewrite(files: DataFrame, rewritten: DataFrame) -> DataFrame:
    """The next version of the file table."""
    new = rewritten.filter("changed").select("project", "path", F.col("new_content").alias("_new"))
    return files.join(new, ["project", "path"], "left").withColumn("content", F.coalesce("_new", "content")).drop("_new")


def remaining_after_apply(files: DataFrame, name: str) -> DataFrame:
    """Files that a second run would still change; empty when the rewrite is stable."""
    once = rewrite(files, name).select("project", "path", "ext", F.col("new_content").alias("content"))
    return rewrite(once, name).filter("changed").select("project", "path")
