"""Language identification by prediction by partial matching.

Each language has a context tree over bytes: how often each byte followed each context of up to
``ORDER`` bytes.  A byte that its context has not seen costs an escape to the context one byte
shorter, where the bytes already ruled out no longer take part (exclusion), down to a flat code
over the bytes never seen.  The statistics are frozen after training, so the code length of a byte
depends on it and the ``ORDER`` bytes before it only, and a text's code length is exact: the
probabilities of the 256 bytes after any context sum to one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenlake.llm.common import arrow_bytes, send, small_batches

ORDER = 4
#: Code lengths are whole multiples of this part of a bit, so that sums don't depend on their order.
UNIT = 1 << 16
BLOCK = 1 << 19
_LEAD = np.uint64(0x0A0A0A0A0A)  # a text stands after line ends


def _mask(n_bytes: int) -> np.uint64:
    return np.uint64((1 << (8 * n_bytes)) - 1)


def grams(data: np.ndarray, offsets: np.ndarray, a: int, b: int) -> np.ndarray:
    """Each byte of data[a:b] with the ORDER bytes before it in its text, as one number."""
    back = data[max(0, a - ORDER) : b]
    if a < ORDER:
        back = np.concatenate([np.full(ORDER - a, 10, np.uint8), back])
    out = np.zeros(b - a, np.uint64)
    for k in range(ORDER + 1):
        out |= back[ORDER - k : len(back) - k].astype(np.uint64) << np.uint64(8 * k)
    rows = slice(np.searchsorted(offsets[:-1], a - ORDER), np.searchsorted(offsets[:-1], b))
    begin, size = offsets[:-1][rows], np.diff(offsets)[rows]
    for k in range(ORDER):
        at = begin[size > k] + k
        at = at[(at >= a) & (at < b)] - a
        out[at] = (out[at] & _mask(k + 1)) | (_LEAD << np.uint64(8 * (k + 1))) & _mask(ORDER + 1)
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places in sorted keys, -1 where absent."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class ContextTree:
    """Frozen byte statistics of one language."""

    def __init__(self, seen: np.ndarray, times: np.ndarray):
        self.pairs, self.times, self.contexts, self.total, self.distinct, self.ruled_out = [], [], [], [], [], []
        for k in range(ORDER + 1):
            keys, place = np.unique(seen & _mask(k + 1), return_inverse=True)
            count = np.bincount(place, weights=times, minlength=len(keys)).astype(np.int64)
            contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            self.pairs.append(keys)
            self.times.append(count)
            self.contexts.append(contexts)
            self.total.append(np.bincount(of, weights=count, minlength=len(contexts)).astype(np.int64))
            self.distinct.append(np.bincount(of, minlength=len(contexts)))
            # how often the shorter context saw the bytes that this context has seen
            shorter = self.times[k - 1][_find(self.pairs[k - 1], keys & _mask(k))] if k else np.zeros(len(keys))
            self.ruled_out.append(np.bincount(of, weights=shorter, minlength=len(contexts)).astype(np.int64))

    def bits(self, wanted: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each gram after the bytes before it."""
        cost = np.zeros(len(wanted))
        open_, before = np.arange(len(wanted)), np.full(len(wanted), -1)
        for k in range(ORDER, -1, -1):
            asked = wanted[open_]
            context = _find(self.contexts[k], (asked & _mask(k + 1)) >> np.uint64(8))
            pair = _find(self.pairs[k], asked & _mask(k + 1))
            known = context >= 0
            total = np.where(known, self.total[k][context] if len(self.total[k]) else 0, 0)
            distinct = np.where(known, self.distinct[k][context] if len(self.distinct[k]) else 0, 0)
            if k < ORDER:
                longer = before >= 0
                if longer.any():
                    total = total - np.where(longer, self.ruled_out[k + 1][before], 0)
                    distinct = distinct - np.where(longer, self.distinct[k + 1][before], 0)
            whole = np.maximum(total + distinct, 1)
            hit = pair >= 0
            count = np.where(hit, self.times[k][pair] if len(self.times[k]) else 1, np.maximum(distinct, 1))
            paid = known & (hit | (distinct > 0))
            cost[open_[paid]] -= np.log2(count[paid] / whole[paid])
            open_, before = open_[~hit], context[~hit]
        cost[open_] += np.log2(max(1, 256 - (int(self.distinct[0][0]) if len(self.distinct[0]) else 0)))
        return cost


@dataclass
class LanguageModel:
    languages: list[str]
    trees: list[ContextTree]
    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    costs: np.ndarray = field(default_factory=lambda: np.empty((0, 0), np.int32))
    slots: np.ndarray = field(default_factory=lambda: np.full(1, -1, np.int32))

    def lay_out(self, seen: np.ndarray) -> LanguageModel:
        """Precompute the costs of all grams seen in training, with a hash table over them."""
        self.keys = np.unique(seen)
        self.costs = self.cost_of(self.keys)
        size = 1 << max(4, int(len(self.keys) * 2).bit_length())
        self.slots = np.full(size, -1, np.int32)
        left, step = np.arange(len(self.keys)), 0
        while len(left) and step < 4:
            at = self._slot(self.keys[left], step)
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            left = left[self.slots[at] != left]
            step += 1
        return self

    def _slot(self, wanted: np.ndarray, step: int) -> np.ndarray:
        shift = np.uint64(64 - (len(self.slots).bit_length() - 1))
        return (((wanted * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64) + step) & (len(self.slots) - 1)

    def cost_of(self, wanted: np.ndarray) -> np.ndarray:
        return np.stack([np.rint(t.bits(wanted) * UNIT).astype(np.int32) for t in self.trees], axis=1)

    def costs_at(self, wanted: np.ndarray) -> np.ndarray:
        """Costs in units, one column a language."""
        at = np.full(len(wanted), -1, np.int32)
        if len(self.keys):
            at = self.slots[self._slot(wanted, 0)]
            missed = np.flatnonzero((at < 0) | (self.keys[at] != wanted))
            for step in (1, 2, 3):
                if not len(missed):
                    break
                other = self.slots[self._slot(wanted[missed], step)]
                good = (other >= 0) & (self.keys[other] == wanted[missed])
                at[missed[good]] = other[good]
                missed = missed[~good]
            at[missed] = -1
            costs = self.costs[at]
        else:
            missed, costs = np.arange(len(wanted)), np.zeros((len(wanted), len(self.trees)), np.int32)
        if len(missed):
            new, back = np.unique(wanted[missed], return_inverse=True)
            costs[missed] = self.cost_of(new)[back]
        return costs

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Units for each row and language; a long text is coded in blocks that see what stands before."""
        out = np.zeros((len(offsets) - 1, len(self.trees)), np.int64)
        rows = np.flatnonzero(np.diff(offsets))
        begins = offsets[rows]
        for a in range(0, len(data), BLOCK):
            b = min(a + BLOCK, len(data))
            costs = self.costs_at(grams(data, offsets, a, b))
            own = slice(np.searchsorted(begins, a, "right") - 1, np.searchsorted(begins, b))
            out[rows[own]] += np.add.reduceat(costs, np.maximum(begins[own], a) - a, axis=0, dtype=np.int64)
        return out


def train(docs: DataFrame, train_on: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_docs: int = 500) -> LanguageModel:
    """Fit the trees on about ``sample_docs`` labelled documents a language.

    The documents are chosen by the hash of their key, at a rate from the number that the language
    has; whole texts count.  Rows without text or language don't take part.  What reaches the driver
    are the counts of the sample, whatever the corpus holds, and one number a language.  Repeated rows
    count each time; without any usable row nothing is learned.
    """
    spark = docs.sparkSession
    small_batches(spark)
    usable = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"), train_on.alias("on")).where("on and t is not null and l is not null")
    known = {r["l"]: r["n"] for r in usable.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(known)
    if not languages:
        return LanguageModel([], [])
    rate = F.create_map(*[x for name in languages for x in (F.lit(name), F.lit(int(min(1.0, sample_docs / known[name]) * 1e9)))])
    chosen = usable.where(F.pmod(F.xxhash64("k"), F.lit(1_000_000_000)) < rate[F.col("l")])
    place = {name: i for i, name in enumerate(languages)}

    def count(batches):
        for batch in batches:
            of = np.array([place[x] for x in batch.column(0).to_pylist()], np.uint64)
            data, offsets = arrow_bytes(batch.column(1))
            for a in range(0, len(data), 4 * BLOCK):
                b = min(a + 4 * BLOCK, len(data))
                rows = np.searchsorted(offsets, np.arange(a, b), "right") - 1
                found, times = np.unique(grams(data, offsets, a, b) | of[rows] << np.uint64(40), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(times.astype(np.int64))], names=["g", "n"])

    counted = chosen.select("l", "t").mapInArrow(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()
    found, times = counted["g"].to_numpy().astype(np.uint64), counted["n"].to_numpy()
    order = np.argsort(found)
    found, times = found[order], times[order]
    seen = found & _mask(ORDER + 1)
    of = found >> np.uint64(40)
    trees = [ContextTree(seen[of == i], times[of == i]) for i in range(len(languages))]
    return LanguageModel(languages, trees).lay_out(seen)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all, if none are named), then lang_pred, score, bits and flat_bits.

    ``score`` is the posterior of the predicted language under equal priors, ``bits`` its code length
    and ``flat_bits`` eight for each byte.  Null texts, texts without a letter, and any text when no
    language was learned are ``und`` with score 0 and null bits.  Equal code lengths go to the first
    language by name.  Rows stay as they are, repeated or not; columns of these four names are replaced.
    Very long texts are scored whole, block by block, and an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    made = ["lang_pred", "score", "bits", "flat_bits"]
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in made]
    carried = docs.select(*kept, F.when(F.col(text).rlike(r"\p{L}"), F.col(text)).alias("__text"))
    schema = carried.drop("__text").schema.add("lang_pred", "string").add("score", "double").add("bits", "double").add("flat_bits", "long")
    receive = send(docs.sparkSession, model)

    def label(batches):
        own = receive()
        names = pa.array([*own.languages, "und"])
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            known = ~column.is_null().to_numpy(zero_copy_only=False) & bool(own.languages)
            pick, score, bits = np.full(len(known), len(own.languages)), np.zeros(len(known)), np.zeros(len(known))
            data, offsets = arrow_bytes(column)
            if own.languages and len(known):
                units = own.code_lengths(data, offsets)
                best = units.argmin(axis=1)
                least = units[np.arange(len(best)), best]
                odds = np.exp2(-np.minimum((units - least[:, None]) / UNIT, 1000.0)).sum(axis=1)
                pick, score, bits = np.where(known, best, pick), np.where(known, 1 / odds, 0.0), least / UNIT
            made_ = [names.take(pa.array(pick)), pa.array(score), pa.array(bits, mask=~known), pa.array(8 * np.diff(offsets), mask=~known)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made_], names=schema.names)

    return carried.mapInArrow(label, schema)
