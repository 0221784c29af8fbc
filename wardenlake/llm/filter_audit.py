"""What a chain of filters removes in every order, by decision diagrams of failure masks.

Each document is a mask of the filters that it fails.  The counts of masks are the leaves of one
diagram a part: a level a filter, a node's low child for documents that pass and its high child for
those that fail, equal sub-diagrams shared, and with each node the counts below it.  All orders are
visited by swaps of adjacent levels, each of which touches the nodes of two levels only.  In each
order the all-pass path from the root gives its steps: a high child holds what a filter removes, a low
child what stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenlake.llm.common import through_table

#: The rows that an audit returns grow with the factorial of the filters.
MOST_FILTERS = 7


def plain_changes(n: int) -> Iterator[int]:
    """Positions whose swaps with the next one lead through all orders of n things, each once."""
    if n < 2:
        return
    inner = plain_changes(n - 1)
    while True:
        yield from range(n - 2, -1, -1)
        at = next(inner, None)
        if at is None:
            return
        yield at + 1
        yield from range(n - 1)
        at = next(inner, None)
        if at is None:
            return
        yield at


class Diagram:
    """A count-weighted diagram over the filters, in an order that swaps change."""

    def __init__(self, counts: dict[int, tuple[int, ...]], filters: int, width: int):
        self.order = list(range(filters))
        self.low, self.high, self.weight = {}, {}, {}
        self.levels: list[dict[tuple[int, int], int]] = [{} for _ in range(filters)]
        leaves: dict[tuple[int, ...], int] = {}
        row = []
        for place in range(1 << filters):  # the first filter is the highest bit of a place
            mask = sum(1 << f for f in range(filters) if place >> (filters - 1 - f) & 1)
            weight = counts.get(mask, (0,) * width)
            node = leaves.setdefault(weight, len(leaves))
            self.weight[node] = weight
            row.append(node)
        self.next = len(leaves)
        for level in reversed(range(filters)):
            row = [self._node(level, row[i], row[i + 1]) for i in range(0, len(row), 2)]
        self.root = row[0]

    def _node(self, level: int, low: int, high: int) -> int:
        node = self.levels[level].get((low, high))
        if node is None:
            node, self.next = self.next, self.next + 1
            self.levels[level][low, high] = node
            self._set(node, low, high)
        return node

    def _set(self, node: int, low: int, high: int) -> None:
        self.low[node], self.high[node] = low, high
        self.weight[node] = tuple(a + b for a, b in zip(self.weight[low], self.weight[high]))

    def swap(self, level: int) -> None:
        """Exchange the filters of a level and the next; nodes above keep their places and meanings."""
        upper, lower = self.levels[level], self.levels[level + 1]
        self.levels[level], self.levels[level + 1] = {}, {}
        for (low, high), node in upper.items():
            passed = self._node(level + 1, self.low[low], self.low[high])
            failed = self._node(level + 1, self.high[low], self.high[high])
            self._set(node, passed, failed)
            self.levels[level][passed, failed] = node
        for node in lower.values():
            del self.low[node], self.high[node], self.weight[node]
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def path(self) -> list[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """(filter, kept, removed) of every step of the order."""
        node, steps = self.root, []
        for f in self.order:
            steps.append((f, self.weight[self.low[node]], self.weight[self.high[node]]))
            node = self.low[node]
        return steps


def audit_counts(counts: dict[int, tuple[int, ...]], filters: int, width: int) -> Iterator[tuple]:
    """(order, step, filter, kept, removed, redundant, unique_fails, shapley) of all orders; counts are (documents, ...)."""
    diagram = Diagram(counts, filters, width)
    steps = [(list(diagram.order), diagram.path())]
    for level in plain_changes(filters):
        diagram.swap(level)
        steps.append((list(diagram.order), diagram.path()))
    fails = {p[0][0]: p[0][2][0] for _, p in steps}  # as the first of an order a filter removes all that fail it
    alone = {p[-1][0]: p[-1][2][0] for _, p in steps}  # as the last, those that fail it only
    shapley = dict.fromkeys(range(filters), 0)
    for _, path in steps:
        for f, _, removed in path:
            shapley[f] += removed[0]
    for order, path in steps:
        for k, (f, kept, removed) in enumerate(path):
            yield order, k + 1, kept[0], removed, fails[f] - removed[0], alone[f], shapley[f]


def audit(flagged: DataFrame, fails: dict[str, str], part: str = "part", lost: dict[str, str] | None = None) -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    ``fails`` gives each filter's letter and the boolean column that says a document fails it, ``lost``
    each further count's name and its boolean column.  Columns: part, filter_order, step, kept,
    removed, redundant (fail the step's filter, removed earlier), unique_fails (fail it only), the
    ``lost`` counts among those removed, and shapley (removed by the filter, summed over all orders).
    Null conditions count as false, a null part as the empty string; repeated rows count as often as
    they stand; an empty table gives no rows.  At most ``MOST_FILTERS`` filters.  A part's masks are
    counted before they meet, so no part is gathered, however large; other columns are ignored.
    """
    letters, lost = list(fails), lost or {}
    if not 0 < len(letters) <= MOST_FILTERS:
        raise ValueError(f"{len(letters)} filters have {factorial(max(len(letters), 0))} orders; 1 to {MOST_FILTERS} can be audited")
    mask = sum((F.coalesce(F.col(fails[f]), F.lit(False)).cast("int") * (1 << k) for k, f in enumerate(letters)), F.lit(0))
    counted = flagged.groupBy(F.coalesce(F.col(part), F.lit("")).alias("part"), mask.alias("mask")).agg(
        F.count(F.lit(1)).alias("n"), *(F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(f"lost_{k}") for k, c in enumerate(lost.values())))
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, " + "".join(f"`{name}` long, " for name in lost) + "shapley long"

    def run(table: pa.Table) -> pa.Table:
        columns = [table[c].to_pylist() for c in table.column_names]
        counts = {m: tuple(rest) for _, m, *rest in zip(*columns)}
        rows = [
            (columns[0][0], "".join(letters[f] for f in order), step, kept, removed[0], redundant, alone, *removed[1:], shapley)
            for order, step, kept, removed, redundant, alone, shapley in audit_counts(counts, len(letters), 1 + len(lost))]
        types = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * (5 + len(lost))]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *lost, "shapley"])

    return counted.groupBy("part").applyInArrow(run, schema)


WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, the five conditions A to E that a document's text fails, and its labels good and toxic: one row a document.

    A: under 100 words; B: distinct words under 80 % of the words; C: letters A-Z over 10 % of the code
    points; D: holds one of ``#$%&*|``; E: identical to the text of a smaller id.  Null texts are empty,
    very long ones are read whole; null ids are never copies and have no copies; repeated rows of an id
    aren't copies of each other; an id labelled several times has a label if one row gives it.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    read = docs.select(
        F.col("doc_id").cast("long").alias("id"), F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"),
        F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("different"),
        (100 * (F.length(text) - F.length(F.translate(text, UPPER, ""))) > 10 * F.length(text)).alias("C"), F.rlike(text, F.lit("[#$%&*|]")).alias("D"))
    read = read.select("id", "part", "digest", (F.col("n") < 100).alias("A"), (100 * F.col("different") < 80 * F.col("n")).alias("B"), "C", "D")
    read = through_table(read, "audit-conditions")
    # the first id of a text is looked up by id and text, so that no text's copies meet in one task
    first = read.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("is_first", F.lit(True))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    joined = read.join(first, ["id", "digest"], "left").join(known, "id", "left")
    return joined.select("part", "A", "B", "C", "D", (F.col("id").isNotNull() & F.col("is_first").isNull()).alias("E"), "good", "toxic")
