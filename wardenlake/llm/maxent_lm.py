"""Hashed maximum-entropy language model with a class-factored softmax.

Tokens are lower-cased words and one end mark a text.  The most frequent ``CLASSES * MEMBERS - 1``
words and the end mark are the head, dealt to classes in order of frequency; all other words are
the tail class.  The probability of a token is that of its class given the words before it, times
that of the token in its class: for the head a softmax over the class's members, for the tail the
add-one share of its count.  Both softmaxes add up rows of weight tables at the places of the word
before, the word before that (a skip feature) and, hashed, the pair of both.

Counts are taken over all training texts.  Weights are trained over all of them once, in rounds:
tasks start from the same weights, update them over their own texts, and the changes of each row are
averaged by the number of tokens that touched it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenlake.llm.common import HashIndex, Words, arrow_bytes, send, small_batches, through_table

CLASSES, MEMBERS = 32, 32
HEAD = CLASSES * MEMBERS
TAIL_ROWS, PAIR_ROWS, MEMBER_ROWS = 1024, 2048, 1 << 14
_START = HEAD + TAIL_ROWS
_CONTEXTS = HEAD + TAIL_ROWS + 1
CLASS_ROWS = 2 * _CONTEXTS + PAIR_ROWS
#: Words whose counts every task holds, at most; rarer words meet their counts in a join.
KNOWN_WORDS = 1 << 19
ROUNDS = 2
STEP_TOKENS = 4096
RATE = 0.15
WIDTH = CLASSES + 1
END = np.uint64(0x0123456789ABCDEF)
BLOCK_TOKENS = 1 << 17


def token_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all rows, each row's words and then its end mark, and the row offsets."""
    words = Words(*arrow_bytes(column))
    rows = np.arange(len(words.first))
    first = words.first + rows
    out = np.full(first[-1], END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[first[1:] - 1] = False
    out[inside] = words.hashes
    return out, first


class Tokens:
    """Head places (-1: tail) of tokens and the rows of their features."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray, head: np.ndarray):
        self.head = head
        context = np.where(head >= 0, head, HEAD + (hashes >> np.uint64(20) & np.uint64(TAIL_ROWS - 1)).astype(np.int64))
        one, two = np.full(len(head), _START), np.full(len(head), _START)
        one[1:], two[2:] = context[:-1], context[:-2]
        begins = first[:-1]
        one[begins] = _START
        two[begins] = _START
        late = begins[np.diff(first) > 1] + 1
        two[late] = _START
        pair = ((one * 1_000_003 + two) * 2_654_435_761 >> 11) % PAIR_ROWS
        self.rows = np.stack([one, _CONTEXTS + two, 2 * _CONTEXTS + pair])


def _member_rows(rows: np.ndarray, of_class: np.ndarray) -> np.ndarray:
    return ((rows * 2_246_822_519 + of_class * 3_266_489_917) >> 7) % MEMBER_ROWS


def _softmax(scores: np.ndarray) -> np.ndarray:
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    return scores


@dataclass
class MaxEnt:
    class_bias: np.ndarray
    member_bias: np.ndarray
    class_rows: np.ndarray
    member_rows: np.ndarray

    @staticmethod
    def start(head_counts: np.ndarray, tail_tokens: int) -> MaxEnt:
        """Weights that give the add-one shares of the counts whatever stands before."""
        members = np.log(head_counts.reshape(CLASSES, MEMBERS) + 1.0)
        classes = np.append((head_counts.reshape(CLASSES, MEMBERS) + 1.0).sum(axis=1), tail_tokens + 1.0)
        return MaxEnt(np.log(classes).astype(np.float32), members.astype(np.float32), np.zeros((CLASS_ROWS, WIDTH), np.float32), np.zeros((MEMBER_ROWS, MEMBERS), np.float32))

    def log_probabilities(self, tokens: Tokens) -> np.ndarray:
        """Natural logarithms: of the class for tail tokens, of class and member for the others."""
        out = np.empty(len(tokens.head))
        for a in range(0, len(out), BLOCK_TOKENS):
            head, rows = tokens.head[a : a + BLOCK_TOKENS], tokens.rows[:, a : a + BLOCK_TOKENS]
            of_class = np.where(head >= 0, head // MEMBERS, CLASSES)
            scores = self.class_rows[rows[0]] + self.class_rows[rows[1]]
            scores += self.class_rows[rows[2]]
            scores += self.class_bias
            part = np.log(_softmax(scores)[np.arange(len(head)), of_class]).astype(np.float64)
            inner = np.flatnonzero(head >= 0)
            rows, of_class = rows[:, inner], of_class[inner]
            scores = self.member_bias[of_class]
            for row in rows:
                scores += self.member_rows[_member_rows(row, of_class)]
            part[inner] += np.log(_softmax(scores)[np.arange(len(inner)), head[inner] % MEMBERS])
            out[a : a + BLOCK_TOKENS] = part
        return out


class Trainer:
    """Adaptive gradient steps on a copy of the weights, remembering how often each row took part."""

    def __init__(self, model: MaxEnt):
        self.model = MaxEnt(model.class_bias, model.member_bias, model.class_rows.copy(), model.member_rows.copy())
        self.before = model
        self.power = [np.full(len(model.class_rows), 1.0, np.float32), np.full(len(model.member_rows), 1.0, np.float32)]
        self.touched = [np.zeros(len(model.class_rows), np.int64), np.zeros(len(model.member_rows), np.int64)]

    def learn(self, tokens: Tokens) -> None:
        m = self.model
        for a in range(0, len(tokens.head), STEP_TOKENS):
            head, rows = tokens.head[a : a + STEP_TOKENS], tokens.rows[:, a : a + STEP_TOKENS]
            of_class = np.where(head >= 0, head // MEMBERS, CLASSES)
            scores = m.class_rows[rows[0]] + m.class_rows[rows[1]] + m.class_rows[rows[2]] + m.class_bias
            error = _softmax(scores)
            error[np.arange(len(head)), of_class] -= 1
            self._step(0, m.class_rows, rows, error)
            inner = np.flatnonzero(head >= 0)
            if len(inner):
                rows, of_class = rows[:, inner], of_class[inner]
                places = np.stack([_member_rows(row, of_class) for row in rows])
                scores = m.member_bias[of_class] + m.member_rows[places[0]] + m.member_rows[places[1]] + m.member_rows[places[2]]
                error = _softmax(scores)
                error[np.arange(len(inner)), head[inner] % MEMBERS] -= 1
                self._step(1, m.member_rows, places, error)

    def _step(self, which: int, weights: np.ndarray, rows: np.ndarray, error: np.ndarray) -> None:
        for row in rows:
            order = np.argsort(row, kind="stable")
            first = np.flatnonzero(np.diff(row[order], prepend=-1))
            nodes = row[order][first]
            gradient = np.add.reduceat(error[order], first, axis=0)
            self.power[which][nodes] += (gradient**2).mean(axis=1)
            weights[nodes] -= RATE * gradient / np.sqrt(self.power[which][nodes])[:, None]
            self.touched[which][nodes] += np.diff(first, append=len(row))

    def changes(self):
        """(row number, touches, touches * change) of the rows that took part; member rows are numbered behind class rows."""
        for which, shift, now, before in ((0, 0, self.model.class_rows, self.before.class_rows), (1, CLASS_ROWS, self.model.member_rows, self.before.member_rows)):
            nodes = np.flatnonzero(self.touched[which])
            change = np.zeros((len(nodes), WIDTH), np.float32)
            times = self.touched[which][nodes]
            change[:, : now.shape[1]] = (now[nodes] - before[nodes]) * times[:, None]
            yield nodes + shift, times, change


@dataclass
class LanguageModel:
    """Counts and weights of a trained model; ``counts`` is a table (hash, c) of all training words."""

    counts: DataFrame
    train_tokens: int
    vocabulary: int
    known: np.ndarray
    known_counts: np.ndarray
    weights: MaxEnt

    @property
    def tail_total(self) -> float:
        """Denominator of the tail's add-one shares: its tokens, its words and one for all unseen words."""
        in_head = min(len(self.known), HEAD)
        return float(max(1, self.train_tokens - int(self.known_counts[:in_head].sum()) + self.vocabulary - in_head + 1))


def train(docs: DataFrame, train_on: Column, text: str = "text", key: str = "doc_id", rounds: int = ROUNDS) -> LanguageModel:
    """Count and train over all rows for which ``train_on`` is true; null texts are empty.

    The driver gets the counts of at most ``KNOWN_WORDS`` words and the weight changes summed over
    the tasks, both of fixed size.
    """
    spark = docs.sparkSession
    small_batches(spark)
    chosen = docs.where(train_on).select(F.col(text).alias("t"), F.pmod(F.xxhash64(F.col(key)), F.lit(rounds)).alias("round"))

    def count(batches):
        held, size = [], 0

        def flush():
            keys, times = np.unique(np.concatenate(held), return_counts=True)
            for a in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + (1 << 16)].astype(np.int64)), pa.array(times[a : a + (1 << 16)])], names=["hash", "c"])

        for batch in batches:
            held.append(token_hashes(batch.column(0))[0])
            size += len(held[-1])
            if size > 4_000_000:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    counts = through_table(chosen.select("t").mapInArrow(count, "hash long, c long").groupBy("hash").agg(F.sum("c").alias("c")), "word-counts")
    spread = counts.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    total, vocabulary = (x or 0 for x in spread.agg(F.sum(F.col("c") * F.col("n")), F.sum("n")).first())
    # the counts from which on at most KNOWN_WORDS words lie
    ladder = spread.orderBy(F.desc("c")).limit(KNOWN_WORDS).toArrow()
    fits = np.cumsum(ladder["n"].to_numpy()) <= KNOWN_WORDS
    least = int(ladder["c"].to_numpy()[fits].min()) if fits.any() else 1 << 62
    known = counts.where(F.col("c") >= least).toArrow()
    hashes, times = known["hash"].to_numpy().astype(np.uint64), known["c"].to_numpy()
    order = np.lexsort((hashes, -times, hashes != END))  # the end mark is the first of the head
    hashes, times = hashes[order], times[order]
    if not len(hashes) or hashes[0] != END:
        hashes, times = np.insert(hashes, 0, END), np.insert(times, 0, 0)
    head_counts = np.zeros(HEAD, np.int64)
    head_counts[: min(HEAD, len(times))] = times[:HEAD]
    model = MaxEnt.start(head_counts, total - int(head_counts.sum()))
    head_keys = hashes[:HEAD]

    for r in range(rounds):
        receive = send(spark, (model, head_keys))

        def learn(batches):
            start, keys = receive()
            trainer, index, seen = Trainer(start), HashIndex(keys), False
            for batch in batches:
                hashes_, first = token_hashes(batch.column(0))
                if len(hashes_):
                    trainer.learn(Tokens(hashes_, first, index.find(hashes_).astype(np.int64)))
                    seen = True
            for nodes, touches, change in trainer.changes() if seen else ():
                columns = [pa.array(nodes), pa.array(touches), *(pa.array(change[:, i]) for i in range(WIDTH))]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "n", *(f"d{i}" for i in range(WIDTH))])

        schema = "row long, n long, " + ", ".join(f"d{i} float" for i in range(WIDTH))
        summed = chosen.where(F.col("round") == r).select("t").mapInArrow(learn, schema).groupBy("row").agg(F.sum("n").alias("n"), *(F.sum(f"d{i}").alias(f"d{i}") for i in range(WIDTH))).toArrow()
        row, n = summed["row"].to_numpy(), summed["n"].to_numpy()
        change = np.stack([summed[f"d{i}"].to_numpy() for i in range(WIDTH)], axis=1) / np.maximum(n, 1)[:, None]
        model = MaxEnt(model.class_bias, model.member_bias, model.class_rows.copy(), model.member_rows.copy())
        low = row < CLASS_ROWS
        model.class_rows[row[low]] += change[low].astype(np.float32)
        model.member_rows[row[~low] - CLASS_ROWS] += change[~low][:, :MEMBERS].astype(np.float32)

    return LanguageModel(counts, int(total), int(vocabulary), hashes, times, model)


def score(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None, key: str = "doc_id") -> DataFrame:
    """The ``keep`` columns (all, if none are named), then n_tokens, n_known, train_tokens, base_score and score.

    Scores are log10 probabilities of the whole text with its end mark: base_score by add-one shares
    of the counts, score by the model.  Null texts are empty and have the end mark only; very long
    texts are scored whole.  Rows that repeat key and text get equal scores, also where the key is
    null.  Columns of these names are replaced, others stay whatever their names.  An empty table gives no rows, and
    a model that saw no text gives all tokens the share of unseen ones.
    """
    spark = docs.sparkSession
    small_batches(spark)
    made = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in made]
    own = [F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 62))).alias("__k"), F.xxhash64(F.col(text)).alias("__h"), F.col(text).alias("__text")]
    receive = send(spark, (model.weights, model.known, model.known_counts))

    def rare(batches):
        _, known, _ = receive()
        index = HashIndex(known)
        for batch in batches:
            hashes, first = token_hashes(batch.column(2))
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            out = index.find(hashes) < 0
            hashes, row = hashes[out], row[out]
            order = np.lexsort((hashes, row))
            hashes, row = hashes[order], row[order]
            new = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])) if len(row) else row)
            times = np.diff(new, append=len(row))
            at = pa.array(row[new])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(hashes[new].astype(np.int64)), pa.array(times)], names=["__k", "__h", "hash", "n"])

    found = docs.select(*own).mapInArrow(rare, "__k long, __h long, hash long, n long").repartition("hash").dropDuplicates(["__k", "__h", "hash"])
    c = F.coalesce("c", F.lit(0))
    tail = found.join(model.counts, "hash", "left").groupBy("__k", "__h").agg(F.sum(F.col("n") * F.log10(c + 1)).alias("__log"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("__known"))

    carried = docs.select(*kept, *own)
    schema = carried.drop("__text").schema.add("n_tokens", "long").add("__in", "long").add("__out", "long").add("__base", "double").add("__rest", "double").add("__model", "double")

    def rate(batches):
        weights, known, counts = receive()
        index, logs, seen = HashIndex(known), np.log10(counts + 1.0), counts > 0
        for batch in batches:
            hashes, first = token_hashes(batch.column(batch.num_columns - 1))
            at = index.find(hashes)
            head = np.where(at < HEAD, at, -1).astype(np.int64)
            logs_ = np.where(at >= 0, logs[at], 0.0)
            sums = lambda x: np.add.reduceat(x, first[:-1]) if batch.num_rows else np.empty(0, x.dtype)  # noqa: B023, E731
            model_log = weights.log_probabilities(Tokens(hashes, first, head)) / np.log(10)
            columns = [np.diff(first), sums(((at >= 0) & seen[at]).astype(np.int64)), sums((head < 0).astype(np.int64)), sums(logs_), sums(np.where(head < 0, logs_, 0.0)), sums(model_log)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, columns)], names=schema.names)

    rated = carried.mapInArrow(rate, schema).join(tail, ["__k", "__h"], "left")
    more = F.coalesce("__log", F.lit(0.0))
    return rated.select(*kept, "n_tokens", (F.col("__in") + F.coalesce("__known", F.lit(0))).alias("n_known"), F.lit(model.train_tokens).cast("long").alias("train_tokens"),
                        (F.col("__base") + more - F.col("n_tokens") * float(np.log10(model.train_tokens + model.vocabulary + 1))).alias("base_score"),
                        (F.col("__model") + F.col("__rest") + more - F.col("__out") * float(np.log10(model.tail_total))).alias("score"))
