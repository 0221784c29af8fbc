"""Byte-pair encoding by backtracking over longest matches, and decoding from an offset table.

An Aho-Corasick automaton finds all vocabulary tokens in a word.  The encoder takes the longest
token at its place that may stand behind the token before, and steps back where nothing fits.  Two
tokens may stand side by side when the merges would leave their border alone; that depends on the
two only and is kept in a table.  Each prefix of a word has one valid encoding, so a place that
leads nowhere is dead for good, and every token at a place is tried at most once.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from wardenlake.llm.common import small_batches, worker_cache
from wardenlake.llm.tokens import PieceEncoder

PAIRS_KEPT = 300_000
WORDS_KEPT = 100_000
_END = "\n"  # stands for the word-end mark; the byte alphabet has no such character
_NEVER = 1 << 40


class Vocabulary:
    """Tokens and merges of a tokenizer file of the byte alphabet with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        inner = lambda t: t[: -len(self.suffix)] + _END if self.suffix and t.endswith(self.suffix) else t
        self.ids = {inner(t): i for t, i in model["vocab"].items()}
        self.rank, self.made = {}, {}
        for r, (a, b) in enumerate(model["merges"]):
            a, b = inner(a), inner(b)
            pair = (self.ids[a], self.ids[b])
            self.rank[pair] = r
            self.made.setdefault(self.ids[a + b], (*pair, r))

    def borders(self, left: int, right: int) -> bool:
        """Whether the merges that make ``left right`` leave the border between the two alone.

        Going back in time from the finished tokens, the younger of the two at the border is taken
        apart.  While two symbols face each other across the border, a merge of theirs would come first
        if its rank is below that of the merge that uses up the left one, or not above that of the
        merge that uses up the right one, which stands further right.
        """
        left_used, right_used = _NEVER, _NEVER
        while True:
            r = self.rank.get((left, right), _NEVER)
            if r < left_used and r <= right_used and r < _NEVER:
                return False
            a, b = self.made.get(left), self.made.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[2] > b[2]):
                left, left_used = a[1], a[2]
            else:
                right, right_used = b[0], b[2]


class BacktrackingEncoder(PieceEncoder):
    """The same pieces and cache as the library's encoder, with ids made here."""

    def __init__(self, path: str):
        import ahocorasick

        super().__init__(path)
        self.vocabulary = Vocabulary(path)
        self.automaton = ahocorasick.Automaton()
        for token, i in self.vocabulary.ids.items():
            self.automaton.add_word(token, (len(token), i))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, list[int]] = {}
        self.marks = re.compile("|".join(map(re.escape, sorted(self.vocabulary.special, key=len, reverse=True))) or "(?!)")

    def fresh(self, pieces: list[str]) -> list[list[int]]:
        return [self.text_ids(piece) for piece in pieces]

    def text_ids(self, text: str) -> list[int]:
        """Ids of a text: special tokens as they stand, the rest normalised, split into words and encoded."""
        out, at = [], 0
        for mark in self.marks.finditer(text):
            self._plain(text[at : mark.start()], out)
            out.append(self.vocabulary.special[mark[0]])
            at = mark.end()
        self._plain(text[at:], out)
        return out

    def _plain(self, text: str, out: list[int]) -> None:
        """Append the ids of a text without special tokens; the library normalises it and splits it into words."""
        text = self.tokenizer.normalizer.normalize_str(text)
        for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text):
            ids = self.words.get(word)
            if ids is None:
                if len(self.words) >= WORDS_KEPT:
                    self.words.clear()
                ids = self.words[word] = self.word_ids(word)
            out += ids

    def word_ids(self, word: str) -> list[int]:
        """Ids of a word that is spelt in the byte alphabet."""
        symbols = word + _END
        options: list[list[tuple[int, int]]] = [[] for _ in range(len(symbols) + 1)]
        for end, (size, i) in self.automaton.iter(symbols):
            options[end + 1 - size].append((end + 1, i))  # the ends ascend, so the longest comes last
        pairs, borders = self.pairs, self.vocabulary.borders
        if len(pairs) > PAIRS_KEPT:
            pairs.clear()
        at, goal, out, back, dead = 0, len(symbols), [], [], set()
        while at < goal:
            waiting = options[at]
            while waiting:
                end, i = waiting.pop()
                if end in dead:
                    continue
                if out:
                    pair = out[-1] << 32 | i
                    good = pairs.get(pair)
                    if good is None:
                        good = pairs[pair] = borders(out[-1], i)
                    if not good:
                        continue
                out.append(i)
                back.append(at)
                at = end
                break
            else:
                dead.add(at)
                at = back.pop()
                out.pop()
        return out


class OffsetTable:
    """Byte strings by number, end to end with their offsets; a sequence of numbers is joined by one gather."""

    def __init__(self, strings: list[bytes]):
        self.bytes = np.frombuffer(b"".join(s + b" " for s in strings), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(s) + 1 for s in strings])])

    def joined(self, numbers: np.ndarray) -> bytes:
        """The strings with one space between them."""
        sizes = (self.offset[1:] - self.offset[:-1])[numbers]
        ends = np.cumsum(sizes)
        place = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32) + np.repeat((self.offset[numbers] - (ends - sizes)).astype(np.int32), sizes)
        return self.bytes[place].tobytes()[:-1]


class Tables:
    """Offset tables that decode ids and spell them as decimals."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        names = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.tokens = OffsetTable([names.get(i, "").encode() for i in range(max(names) + 1)])
        self.decimals = OffsetTable([str(i).encode() for i in range(max(names) + 1)])

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids as the library gives it for a vocabulary without a decoder: tokens with spaces between them."""
        return self.tokens.joined(ids)

    def batches(self, keys: pa.Array, rows: list[np.ndarray], names: list[str]):
        """Record batches of key, n_tokens, ids_text and text, a few rows at a time."""
        for a in range(0, len(rows), 64):
            part = rows[a : a + 64]
            made = [[len(r) for r in part], [self.decimals.joined(r) for r in part], [self.decode(r) for r in part]]
            yield pa.RecordBatch.from_arrays([keys.slice(a, 64), *(pa.array(c, k) for c, k in zip(made, (pa.int64(), pa.binary(), pa.binary())))], names=names)


def encoder(path: str) -> BacktrackingEncoder:
    return worker_cache(f"backtracking {path}", lambda: BacktrackingEncoder(path))


def tables(path: str) -> Tables:
    return worker_cache(f"tables {path}", lambda: Tables(path))


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array) of each row's whole text, split and normalised by the library and merged here.

    Null and empty texts have no ids; very long texts are encoded whole.  Repeated keys give a row each,
    an empty table gives none, and other columns are left aside, whatever their names.
    """
    small_batches(docs.sparkSession)
    kept = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = kept.drop("__text").schema.add("ids", ArrayType(IntegerType()))

    def run(batches):
        for batch in batches:
            rows = encoder(vocabulary).encode(batch.column(1))
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows).astype(np.int32) if rows else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=schema.names)

    return kept.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, n_tokens, ids_text, text): the ids as decimals with spaces between them, and decoded.

    Null and empty ids give no tokens and empty texts.  Repeated keys give a row each, an empty table
    gives none, and other columns are left aside, whatever their names.
    """
    kept = encoded.select(F.col(key), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("__ids"))
    schema = kept.drop("__ids").schema.add("n_tokens", "long").add("ids_text", "binary").add("text", "binary")

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            yield from tables(vocabulary).batches(batch.column(0), [values[x:y] for x, y in zip(ends[:-1], ends[1:])], schema.names)

    return kept.mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same as ``decode`` of ``encode``, in one pass over the texts, and with the same results in all cases named there."""
    small_batches(docs.sparkSession)
    kept = docs.select(F.col(key), F.col(text).alias("__text"))
    schema = kept.drop("__text").schema.add("n_tokens", "long").add("ids_text", "binary").add("text", "binary")

    def run(batches):
        for batch in batches:
            yield from tables(vocabulary).batches(batch.column(0), encoder(vocabulary).encode(batch.column(1)), schema.names)

    return kept.mapInArrow(run, schema)
