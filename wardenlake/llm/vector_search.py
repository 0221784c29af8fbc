"""Approximate nearest neighbours by inner product: a robust-pruned graph a shard, beam search in each.

Vectors are dealt to shards of bounded size by the hash of their id.  The queries meet every shard,
block by block, behind the shard's vectors in one stream, so a task holds one graph and one block of
queries.  Products of what the beams find are taken again in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardenlake.llm.common import through_table
from wardenlake.llm.pruned_graph import SearchGraph

SHARD_ROWS = 6000
BEAM = 128


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, and one of them not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def lists(column: pa.Array) -> list[np.ndarray]:
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:])]


class Shard:
    """The graphs of one shard, one for each number of dimensions; equal vectors are one node."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray]):
        self.parts = {}
        sizes = np.array([len(v) for v in vectors])
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            own = own[np.argsort(ids[own], kind="stable")]
            nodes, node = np.unique(np.stack([vectors[i] for i in own]), axis=0, return_inverse=True)
            order = np.argsort(node, kind="stable")
            first = np.searchsorted(node[order], np.arange(len(nodes) + 1))
            self.parts[int(size)] = (nodes, SearchGraph(nodes), ids[own][order], first)

    def nearest(self, query: int, vector: np.ndarray, found: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        nodes, _, ids, first = self.parts[len(vector)]
        found = found[found >= 0]
        score = nodes[found] @ vector
        order, out = np.lexsort((found, -score)), []
        last = -np.inf
        for i in order:
            if len(out) > k and score[i] < last:
                break
            # one more than k, for the query may be among them; equal vectors by id
            out += [(query, int(x), float(score[i])) for x in ids[first[found[i]] : first[found[i] + 1]][: k + 1]]
            last = score[i]
        out = [x for x in out if x[1] != query]
        return sorted(out, key=lambda x: (-x[2], x[1]))[:k]

    def search(self, ids: list[int], vectors: list[np.ndarray], k: int, beam: int) -> list[tuple[int, int, float]]:
        out = []
        for size in {len(v) for v in vectors} & set(self.parts):
            own = [i for i, v in enumerate(vectors) if len(v) == size]
            found = self.parts[size][1].nearest(np.stack([vectors[i] for i in own]), max(beam, k + 1))
            for i, row in zip(own, found):
                out += self.nearest(ids[i], vectors[i], row, k)
        return out


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, <key>, score): each query's k nearest among all other rows, ties to the smaller key.

    ``is_query`` is a condition over the table.  Null, empty and zero vectors and those with null or
    non-finite components take no part; neither do null keys.  Vectors meet those of equal size only.
    A query's own key is never among its results, also where rows repeat a key.  Other columns are ignored.
    An empty table, or one without queries, gives no rows.
    """
    spark = vectors.sparkSession
    own = vectors.where(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    own = through_table(own, "vectors")
    shards = max(1, -(-own.count() // shard_rows))
    home = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    points = own.select(home.alias("shard"), F.lit(0).alias("kind"), "id", "v")
    asked = own.where("q").dropDuplicates(["id"]).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "id", "v")
    stream = points.unionByName(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind", "id")

    def run(batches):
        at, shard, ids, rows = None, None, [], []
        for batch in batches:
            number, kind, key_, vecs = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), lists(batch.column(3))
            cuts = np.flatnonzero((number[1:] != number[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(number)]):
                if a == b:
                    continue
                if number[a] != at:
                    at, shard, ids, rows = number[a], None, [], []
                if kind[a] == 0:
                    ids.append(key_[a:b])
                    rows += [np.array(v) for v in vecs[a:b]]
                elif ids:
                    if shard is None:
                        shard, rows = Shard(np.concatenate(ids), rows), []
                    found = shard.search(key_[a:b].tolist(), vecs[a:b], k, beam)
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "id", "score"])

    found = stream.mapInArrow(run, "query_id long, id long, score double").dropDuplicates(["query_id", "id"])
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
