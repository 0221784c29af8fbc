"""Quality classifier: naive Bayes support vectors over word and shape n-grams.

A text's features are indicators: its words, and n-grams of word shapes (case, length, closing
marks, and whether the word repeats an earlier one nearby).  Each indicator is scaled by the
log-ratio of its smoothed shares in the two classes, the vector is brought to length one, and a
linear hinge-loss model is fitted to it by dual coordinate descent.  A logistic curve over the
margins of the training rows turns margins into scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenlake.llm.common import Words, arrow_bytes, mix, send, small_batches

BUCKETS = 1 << 18
SHAPE_GRAMS = 3


def _byte_kind() -> np.ndarray:
    kind = np.full(256, 3, np.uint64)  # other marks
    kind[97:123] = 0
    kind[65:91] = 1
    kind[48:58] = 2
    kind[128:] = 0  # bytes of letters outside ASCII, nearly always
    for mark in b".,;:?":
        kind[mark] = 4
    return kind


def shapes(words: Words) -> np.ndarray:
    """A small number for each word: kinds of its first, second, last and last but one byte, length class, repetition."""
    if not len(words.hashes):
        return np.empty(0, np.uint64)
    kind = _byte_kind()
    first, last = kind[words.data[words.start]], kind[words.data[words.end - 1]]
    second = kind[words.data[np.minimum(words.start + 1, words.end - 1)]]
    before = kind[words.data[np.maximum(words.end - 2, words.start)]]
    size = np.minimum(np.log2(words.end - words.start).astype(np.uint64), np.uint64(6))
    again = np.zeros(len(words.hashes), np.uint64)
    again[1:] = words.hashes[1:] == words.hashes[:-1]
    again[words.first[:-1][words.first[:-1] < len(again)]] = 0
    out = first
    for part in (second, before, last, again):
        out = out * np.uint64(8) + part
    return out * np.uint64(8) + size


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Streams of hashed features, each aligned with the words, and the word offsets of the rows.

    An n-gram belongs to the word that ends it; one that would reach over the start of its row is
    replaced by the shorter one.
    """
    words = Words(data, offsets)
    shape = shapes(words)
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    place = np.arange(len(shape)) - np.repeat(words.first[:-1], np.diff(words.first))
    streams, run = [(words.hashes >> shift).astype(np.int32)], np.zeros(len(shape), np.uint64)
    for n in range(SHAPE_GRAMS):
        moved = np.zeros(len(shape), np.uint64)
        moved[n:] = shape[: len(shape) - n] if n else shape
        run = np.where(place >= n, run * np.uint64(1 << 19) ^ (moved + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), run)
        streams.append((mix(run + np.uint64(n + 1)) >> shift).astype(np.int32))
    return streams, words.first


def distinct_rows(streams: list[np.ndarray], first: np.ndarray):
    """For each row its set of features."""
    seen = np.full(BUCKETS, -1, np.int64)
    clock = 0
    for a, b in zip(first[:-1], first[1:]):
        row = np.concatenate([s[a:b] for s in streams])
        order = np.arange(clock, clock + len(row))
        seen[row] = order
        yield row[seen[row] == order]
        clock += len(row)


@dataclass
class QualityModel:
    weight: np.ndarray  # feature's log-count ratio times its fitted weight
    square: np.ndarray  # squared log-count ratio, for the length
    slope: float
    shift: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        streams, first = features(data, offsets)
        margin = np.zeros(len(offsets) - 1)
        for i, row in enumerate(distinct_rows(streams, first)):
            row = np.sort(row)  # sums in one order, whatever the batch
            margin[i] = self.weight[row].sum() / max(np.sqrt(self.square[row].sum()), 1e-9)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


def dual_coordinate_descent(first: np.ndarray, places: np.ndarray, values: np.ndarray, sign: np.ndarray, cost: np.ndarray, size: int, rounds: int = 12) -> np.ndarray:
    """Weights of least hinge loss with an L2 penalty: one dual variable a row, updated in closed form in shuffled order.

    Row i has values[first[i]:first[i + 1]] at its places.
    """
    count = len(first) - 1
    weight, alpha = np.zeros(size), np.zeros(count)
    length = np.array([float(values[a:b] @ values[a:b]) for a, b in zip(first[:-1], first[1:])])
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(count):
            at, value = places[first[i] : first[i + 1]], values[first[i] : first[i + 1]]
            if length[i] == 0:
                continue
            slope = sign[i] * float(weight[at] @ value) - 1
            new = min(max(alpha[i] - slope / length[i], 0.0), cost[i])
            if new != alpha[i]:
                weight[at] += (new - alpha[i]) * sign[i] * value
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return weight


def _logistic(margin: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve over margins, by Newton steps with a small penalty."""
    x, beta = np.stack([margin, np.ones(len(margin))], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (p - positive) + 1e-3 * beta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), gradient)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(beta[0]), 1e-3), float(beta[1])


def fit(first: np.ndarray, places: np.ndarray, positive: np.ndarray, cost: float = 1.0) -> QualityModel:
    """Fit ratios, weights and curve to feature sets, end to end with their offsets, and their labels; rows are in a fixed order."""
    counts, rows = [np.ones(BUCKETS), np.ones(BUCKETS)], list(zip(first[:-1], first[1:]))
    for (a, b), label in zip(rows, positive):
        counts[int(label)][places[a:b]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ratio[(counts[0] + counts[1]) == 2] = 0.0  # never seen
    if not len(rows) or positive.all() or not positive.any():
        return QualityModel(np.zeros(BUCKETS), ratio**2, 1.0, 30.0 if len(rows) and positive.all() else -30.0 if len(rows) else 0.0)
    values = ratio[places]
    for a, b in rows:
        values[a:b] /= max(np.sqrt(values[a:b] @ values[a:b]), 1e-9)
    sign = np.where(positive, 1.0, -1.0)
    share = positive.mean()
    weight = dual_coordinate_descent(first, places, values, sign, cost * np.where(positive, 0.5 / share, 0.5 / (1 - share)), BUCKETS)
    margin = np.array([float(weight[places[a:b]] @ values[a:b]) for a, b in rows])
    slope, shift = _logistic(margin, positive.astype(float))
    return QualityModel(weight * ratio, ratio**2, slope, shift)


def train(docs: DataFrame, labels: DataFrame, train_on: Column, text: str = "text", key: str = "doc_id", label: str = "quality", sample_rows: int = 6000) -> QualityModel:
    """Fit on at most about ``sample_rows`` labelled rows, chosen by the hash of their key.

    The labelled rows are counted first; the chosen labels are few enough to be broadcast to the
    documents.  Null labels and keys don't take part; a key labelled or stored twice counts twice.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = labels.where(train_on).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y is not null")
    total = own.count()
    rate = int(min(1.0, sample_rows / max(total, 1)) * 1e9)
    chosen = own.where(F.pmod(F.xxhash64("k"), F.lit(1_000_000_000)) < rate)
    sample = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k").select("k", "y", "t")

    def extract(batches):
        for batch in batches:
            rows = list(distinct_rows(*features(*arrow_bytes(batch.column(2)))))
            sets = pa.array([np.sort(r).tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sets], names=["k", "y", "f"])

    got = sample.mapInArrow(extract, sample.select("k", "y").schema.add("f", "binary")).toArrow().sort_by([("k", "ascending"), ("y", "ascending"), ("f", "ascending")])
    data, offsets = arrow_bytes(got["f"])
    return fit(offsets // 4, data.view(np.int32), got["y"].to_numpy() > 0)


def score(docs: DataFrame, model: QualityModel, text: str = "text", threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all, if none are named), then score (0 to 1, higher: label 1 likelier) and predicted.

    Null and empty texts have no features and get the score of margin zero.  Very long texts count
    whole: a feature that repeats counts once.  Columns of these two names are replaced; rows stay
    as they are, equal texts get equal scores, and an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in ("score", "predicted")]
    carried = docs.select(*kept, F.col(text).alias("__text"))
    schema = carried.drop("__text").schema.add("score", "double").add("predicted", "integer")
    receive = send(docs.sparkSession, model)

    def rate(batches):
        own = receive()
        for batch in batches:
            scores = own.scores(*arrow_bytes(batch.column(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=schema.names)

    return carried.mapInArrow(rate, schema)
