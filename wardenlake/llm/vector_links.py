"""Near copies among vectors of a label, by range search in flat robust-pruned graphs.

Equal vectors of a label are one class from the start.  A class is at home with its nearest pivot, of
as many as its label needs, and a guest with every earlier pivot whose home classes the threshold lets
it link with: a class u at home with p is no farther from p than from any pivot r, so a class v that
links with u has v.(r - p) at most sqrt(1 - threshold^2) |r - p| for every r.  No link is lost by that,
however many pivots there are.  Where vectors stand in no clusters all are guests everywhere, and all
pairs of a label are compared.  The home classes of a label and a pivot, and the guests, are cut into
parts of bounded size; each pair of home parts and each home part with a guest part is a cell, and
each pair of classes meets in one cell.

The members of a cell form one flat graph.  They fall into overlapping clusters, each with its two
nearest centres; in each cluster a member's nearest are pruned to diverse neighbours, and a member's
neighbour lists from its clusters are united, along with some of those that point to it.  From the
clusters' medoids a greedy search walks towards each member and then expands to all that lie within
the threshold.  Pairs found are verified in double precision.  An audit compares a sample of the
cell's members, chosen by hash, with all others; if the graph missed one of their links, the whole
cell is compared by block products instead.  Cells of up to ``AUDITED`` members are audited whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from wardenlake.llm.common import mix, send, through_table
from wardenlake.llm.components import components
from wardenlake.llm.pruned_graph import medoid, prune, search
from wardenlake.llm.vector_search import lists, usable

#: Classes for which a label gets one more pivot, and members in a part: a graph search costs little more in a larger cell.
CLUSTER_ROWS = 8000
PIVOTS = 256
PART_ROWS = 8000
ROWS_AT_ONCE = 256
#: Single-precision products that lie this near to the threshold, or as near as they may err, are taken again in double precision.
SOFT = 1e-4
#: Members of a cell that are compared with all; with no miss among them, a share f of the members
#: with missed links stays unseen with a chance of (1 - f) ** AUDITED.
AUDITED = 128
#: Members in a cluster of a cell's graph, neighbours kept in each, those that point back, beam and nodes expanded at a time.
GRAPH_CLUSTER, DEGREE, BACK, BEAM, STEP = 400, 14, 8, 24, 24
ALPHA = 1.2


def blocks_within(vectors: np.ndarray, left: np.ndarray, right: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows whose cosine reaches the threshold, a block at a time: i of ``left`` and j of ``right``, or all i < j of ``left``."""
    length = np.sqrt((vectors**2).sum(axis=1))
    unit = (vectors / length[:, None]).astype(np.float32)
    soft = max(SOFT, vectors.shape[1] * 2.0**-22)
    for a in range(0, len(left), ROWS_AT_ONCE):
        rows, columns = left[a : a + ROWS_AT_ONCE], left[a:] if right is None else right
        product = unit[rows] @ unit[columns].T
        i, j = np.nonzero(product >= threshold - soft)
        if right is None:
            i, j = i[i < j], j[i < j]
        near = np.flatnonzero(product[i, j] < threshold + soft)
        i_, j_, good = rows[i], columns[j], np.ones(len(i), bool)
        for b in range(0, len(near), 1 << 14):
            k = near[b : b + (1 << 14)]
            good[k] = np.einsum("ij,ij->i", vectors[i_[k]], vectors[j_[k]]) / (length[i_[k]] * length[j_[k]]) >= threshold
        yield i_[good], j_[good]


def pairs_within(vectors: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs (i < j) of rows whose cosine reaches the threshold."""
    return np.concatenate([np.empty((2, 0), np.int64), *map(np.stack, blocks_within(vectors, np.arange(len(vectors)), None, threshold))], axis=1)


def flat_graph(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbour lists of unit vectors (-1: none), united over overlapping clusters, and the clusters' medoids."""
    n = len(unit)
    rng = np.random.default_rng(23)
    centres = unit[rng.choice(n, -(-n // GRAPH_CLUSTER), replace=False)]
    nearest = np.argsort(-(unit @ centres.T), axis=1, kind="stable")[:, :2]
    lists, medoids = [], []
    for place in range(nearest.shape[1]):
        out = np.full((n, DEGREE), -1, np.int32)
        for c in range(len(centres)):
            members = np.flatnonzero((nearest == c).any(axis=1))
            rng.shuffle(members)
            # a cluster that holds most of the cell is cut; its parts share members with other clusters
            for part in np.array_split(members, max(1, -(-len(members) // (4 * GRAPH_CLUSTER)))):
                own = part[nearest[part, place] == c]
                if len(part) < 2 or not len(own):
                    continue
                product = unit[own] @ unit[part].T
                wide = min(3 * DEGREE, len(part))
                near = part[np.argpartition(-product, wide - 1, axis=1)[:, :wide]]
                out[own] = prune(own, near.astype(np.int32), unit, DEGREE, ALPHA)
                medoids.append(part[medoid(unit[part])])
        lists.append(out)
    graph = np.concatenate(lists, axis=1)
    source, column = np.nonzero(graph >= 0)
    target = graph[source, column]
    back = np.full((n, BACK), -1, np.int32)
    order = np.lexsort((rng.random(len(target)), target))
    target, source = target[order], source[order]
    place = np.arange(len(target)) - np.searchsorted(target, target)
    back[target[place < BACK], place[place < BACK]] = source[place < BACK]
    return np.concatenate([graph, back, rng.integers(0, n, (n, 2)).astype(np.int32)], axis=1), np.unique(medoids).astype(np.int64) if medoids else np.zeros(1, np.int64)


def graph_pairs(vectors: np.ndarray, left: np.ndarray, right: np.ndarray | None, threshold: float) -> np.ndarray:
    """Pairs of rows found by range search in the flat graph, verified: i of ``left`` and j of ``right``, or i < j of ``left``."""
    length = np.sqrt((vectors**2).sum(axis=1))
    unit = (vectors / length[:, None]).astype(np.float32)
    soft = max(SOFT, vectors.shape[1] * 2.0**-22)
    graph, medoids = flat_graph(unit)
    within = np.zeros(len(vectors), bool)
    within[left if right is None else right] = True
    keys = []
    for a in range(0, len(left), ROWS_AT_ONCE):
        asked = left[a : a + ROWS_AT_ONCE]
        q, node = search(unit, graph, unit[asked], medoids, BEAM, step=STEP, reach=threshold - soft)
        i, j = asked[q], node
        good = within[j] & (i != j)
        i, j = i[good], j[good]
        if right is None:
            i, j = np.minimum(i, j), np.maximum(i, j)
        keys.append(np.unique(i * len(vectors) + j))
    key = np.unique(np.concatenate(keys)) if keys else np.empty(0, np.int64)
    i, j = key // len(vectors), key % len(vectors)
    good = np.ones(len(key), bool)
    for b in range(0, len(key), 1 << 14):
        k = slice(b, b + (1 << 14))
        good[k] = np.einsum("ij,ij->i", vectors[i[k]], vectors[j[k]]) / (length[i[k]] * length[j[k]]) >= threshold
    return np.stack([i[good], j[good]])


def audited_pairs(vectors: np.ndarray, ids: np.ndarray, left: np.ndarray, right: np.ndarray | None, threshold: float) -> tuple[Iterator[tuple[np.ndarray, np.ndarray]], int, int]:
    """Blocks of pairs, how many links of audited members there are, and how many of those the graph missed."""
    found = graph_pairs(vectors, left, right, threshold)
    sample = left[np.argsort(mix(ids[left].astype(np.uint64)), kind="stable")[:AUDITED]]
    everyone = left if right is None else right
    links = [np.empty(0, np.int64)]
    for i, j in blocks_within(vectors, sample, everyone, threshold):
        i, j = i[i != j], j[i != j]
        if right is None:
            i, j = np.minimum(i, j), np.maximum(i, j)
        links.append(i * len(vectors) + j)
    links = np.unique(np.concatenate(links))
    missed = int((~np.isin(links, found[0] * len(vectors) + found[1])).sum())
    return (iter([(found[0], found[1])]) if not missed else blocks_within(vectors, left, right, threshold)), len(links), missed


def homes_and_guests(vectors: list[np.ndarray], wanted: np.ndarray, pivots: list[np.ndarray], threshold: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each vector the nearest of its first ``wanted`` pivots of equal size, and the earlier ones that it must visit."""
    home, guests = np.zeros(len(vectors), np.int64), [np.empty(0, np.int64)] * len(vectors)
    sizes = np.array([len(v) for v in vectors])
    slope = np.sqrt(1 - min(threshold, 1.0) ** 2) if threshold > 0 else 1.0
    unit = [p / np.sqrt(p @ p) for p in pivots]
    for size, first in np.unique(np.stack([sizes, wanted]), axis=1).T:
        own = np.flatnonzero((sizes == size) & (wanted == first))
        usable_ = np.array([k for k, p in enumerate(unit[:first]) if len(p) == size], np.int64)
        if not len(usable_):
            continue
        among = np.stack([unit[k] for k in usable_])
        near = np.stack([vectors[k] for k in own])
        near = near @ among.T / np.sqrt((near**2).sum(axis=1))[:, None]
        best = near.argmax(axis=1)
        far = slope * np.sqrt(((among[:, None] - among) ** 2).sum(axis=2)) + 1e-9
        visits = np.stack([(near - far[:, k]).max(axis=1) <= near[:, k] for k in range(len(among))], axis=1)
        visits &= np.arange(len(among)) < best[:, None]
        home[own] = usable_[best]
        for row, k in enumerate(own):
            guests[k] = usable_[visits[row]]
    return home, guests


def _cell(table: pa.Table, threshold: float) -> pa.Table:
    """For each member of a cell with links: how many vectors it links with here, and a smaller member that it reaches.

    One more row without an id holds the audit: links of audited members, and how many the graph missed.
    """
    table = table.combine_chunks().sort_by("id")
    ids, times, part = (table[c].to_numpy() for c in ("id", "times", "part"))
    vectors = lists(table["v"].combine_chunks())
    sizes = np.array([len(v) for v in vectors])
    count, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    across = table["a"][0].as_py() != table["b"][0].as_py()
    audited = missed = 0
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        first = part[own] == part[0]
        left, right = (np.flatnonzero(first), np.flatnonzero(~first)) if across else (np.arange(len(own)), None)
        if not len(left) or right is not None and not len(right):
            continue
        blocks, links, lost = audited_pairs(np.stack([vectors[k] for k in own]), ids[own], left, right, threshold)
        audited, missed = audited + links, missed + lost
        for i, j in blocks:
            i, j = own[i], own[j]
            np.add.at(count, i, times[j])
            np.add.at(count, j, times[i])
            while True:  # the larger of two linked roots goes to the smallest one it links with
                one, two = root[i], root[j]
                apart = one != two
                if not apart.any():
                    break
                np.minimum.at(root, np.maximum(one, two)[apart], np.minimum(one, two)[apart])
                while (root[root] != root).any():
                    root = root[root]
    keep = (count > 0) | (root != np.arange(len(ids)))
    return pa.table({
        "id": pa.array([*ids[keep].tolist(), None], pa.int64()), "n": pa.array([*count[keep].tolist(), audited], pa.int64()),
        "root": pa.array([*ids[root[keep]].tolist(), missed], pa.int64())})


def audit(found: DataFrame) -> DataFrame:
    """One row: cells, links of audited members, those that the graphs missed, and cells that were compared whole for it."""
    return found.where("id is null").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("n").alias("audited"), F.sum("root").alias("missed"), F.count_if(F.col("root") > 0).alias("compared_whole"))


def cell_links(classes: DataFrame, threshold: float) -> DataFrame:
    """(id, n, root) for the classes (id, label, times, v) with links, by cell, and the audit of each cell."""
    spark = classes.sparkSession
    needs = classes.groupBy("label").agg(F.least(F.lit(PIVOTS), F.ceil(F.count(F.lit(1)) / CLUSTER_ROWS)).cast("long").alias("wanted"), F.count(F.lit(1)).alias("n"))
    total, wanted = (x or 0 for x in needs.agg(F.sum("n"), F.max("wanted")).first())
    rate = min(1.0, 20 * wanted / max(total, 1))
    pool = classes.where(F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1_000_000)) < int(rate * 1_000_000) + 1).orderBy(F.xxhash64(F.lit(9), "id")).limit(wanted)
    receive = send(spark, [np.array(r["v"]) for r in pool.select("v").collect()])  # at most PIVOTS rows

    def assign(batches):
        pivots = receive()
        for batch in batches:
            home, guests = homes_and_guests(list(lists(batch.column(3))), batch.column(4).to_numpy(), pivots, threshold)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(home), pa.array(guests, pa.list_(pa.int64()))], names=[*batch.schema.names[:4], "home", "guests"])

    asked = classes.join(needs.select("label", "wanted"), "label").select("id", "label", "times", "v", "wanted")
    placed = through_table(asked.mapInArrow(assign, asked.drop("wanted").schema.add("home", "long").add("guests", ArrayType(LongType()))), "placed")
    members = placed.select("id", "label", "times", "home", F.explode(F.concat(F.array("home"), "guests")).alias("cluster"))
    members = members.withColumn("guest", F.col("cluster") != F.col("home")).drop("home")
    parts = members.groupBy("label", "cluster").agg(*(F.ceil(F.count_if(x) / PART_ROWS).cast("int").alias(n) for n, x in (("homes", ~F.col("guest")), ("visits", F.col("guest")))))
    cut = members.join(parts.where("homes > 0"), ["label", "cluster"])
    # parts of home classes are numbered from 0 up, those of guests from -1 down
    dealt = F.xxhash64("id", "cluster")
    cut = cut.withColumn("part", F.when(F.col("guest"), -1 - F.pmod(dealt, F.greatest("visits", F.lit(1)))).otherwise(F.pmod(dealt, F.col("homes"))).cast("int"))
    met = F.sequence(F.lit(0), F.col("homes") - 1)
    met = F.when(F.col("guest") | (F.col("visits") == 0), met).otherwise(F.concat(met, F.sequence(F.lit(-1), -F.col("visits"))))
    cut = cut.withColumn("other", F.explode(met))
    cells = cut.select("id", "label", "times", "cluster", "part", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"))
    found = cells.join(placed.select("id", "v"), "id").groupBy("label", "cluster", "a", "b").applyInArrow(lambda t: _cell(t, threshold), "id long, n long, root long")
    return through_table(found, "vector-links")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93) -> DataFrame:
    """One row per vector: key, n_links, component_id and kept.

    Vectors of equal, non-null labels link when their cosine in double precision reaches the
    threshold.  Null, empty and zero vectors, those with null or non-finite components, and rows
    with a null label or key link with nothing and stand alone.  Vectors meet those of equal size
    only.  Of rows that repeat a key the first usable by its numbers stands for all.  Equal vectors
    link like any others; an empty table gives no rows.  Other columns are ignored.  ``cell_links`` and
    ``audit`` say how many links of audited vectors the graphs missed before cells were compared whole.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    good = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
    good = good.groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")
    good = through_table(good.select("id", "label", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")), "vectors")
    classes = good.groupBy("label", "h1", "h2").agg(F.min("id").alias("id"), F.min_by("v", "id").alias("v"), F.count(F.lit(1)).alias("times"))
    classes = through_table(classes, "vector-classes")

    found = cell_links(classes, threshold).where("id is not null")

    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    of = components(found.where("id <> root").select(F.col("id").alias("u"), F.col("root").alias("v")))
    named = classes.select("label", "h1", "h2", "id", "times").join(counts, "id", "left").join(of.withColumnRenamed("node", "id"), "id", "left")
    named = named.select("label", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    linked = good.select("id", "label", "h1", "h2").join(named, ["label", "h1", "h2"]).select("id", "n_links", "component")
    out = rows.select("id").join(linked, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
