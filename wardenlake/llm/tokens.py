"""Token ids by the tokenizers library, one call for each piece of text that a worker hasn't met.

Both kinds of vocabulary never merge across white space, so a text's ids are those of its pieces
end to end: words, with the white space before them where the vocabulary keeps it.  A worker keeps
the ids of the pieces that it has met under a 64-bit hash, in plain arrays of bounded size.  Two
pieces of one worker share a hash with a chance of about 1e-7 for a million pieces.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from wardenlake.llm.common import HashIndex, Words, arrow_bytes, worker_cache

PIECES_KEPT = 1_000_000
PIECES_A_CALL = 4096


def _spots(data: np.ndarray, *patterns: bytes) -> np.ndarray:
    """Where any of the patterns begins; their bytes may also be given as (low, high) ranges."""
    out = [np.empty(0, np.int64)]
    for pattern in patterns:
        at = np.flatnonzero(data[: len(data) - len(pattern) + 1] == pattern[0])
        for k, byte in enumerate(pattern[1:], 1):
            at = at[data[at + k] == byte]
        out.append(at)
    return np.concatenate(out)


# The white space outside ASCII, in UTF-8.
_WIDE_SPACES = [c.encode() for c in "\x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))]


class PieceEncoder:
    """Encodes rows of texts with one vocabulary file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        # a byte-level splitter keeps a space with the word behind it; the other kind drops white space
        self.spaced = type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel"
        ends = self.tokenizer.model.end_of_word_suffix if hasattr(self.tokenizer.model, "end_of_word_suffix") else None
        names = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(names.values()) + 1, bool)
        if ends and not self.spaced:
            self.closes[[i for t, i in names.items() if t.endswith(ends)]] = True
        self._forget()

    def _forget(self) -> None:
        self.index, self.first, self.ids, self.used = HashIndex(), np.zeros(1024, np.int64), np.zeros(8192, np.uint32), 0

    def unusual(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows to encode whole: special tokens may stand in them, or white space isn't single spaces and line ends between words."""
        spots = [_spots(data, b"<|")]
        if self.spaced and len(data):
            white = (data == 32) | ((data >= 9) & (data <= 13))
            strange = (white & (data != 32) & (data != 10)) | ((data >= 28) & (data <= 31))
            strange[1:] |= white[1:] & white[:-1]
            begins, ends = offsets[:-1][np.diff(offsets) > 0], offsets[1:][np.diff(offsets) > 0] - 1
            strange[begins] |= white[begins]
            strange[ends] |= white[ends]
            spots += [np.flatnonzero(strange), _spots(data, *_WIDE_SPACES)]
        return np.unique(np.searchsorted(offsets, np.concatenate(spots), "right") - 1)

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each row's text; nulls are empty."""
        data, offsets = arrow_bytes(column)
        words = Words(data, offsets, lower=not self.spaced)
        keys, starts = words.hashes, words.start
        if self.spaced and len(keys):
            inner = np.ones(len(keys), bool)
            inner[words.first[:-1][np.diff(words.first) > 0]] = False
            starts = starts - inner
            keys = keys ^ np.where(inner, data[starts], 0).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
        rare = self.unusual(data, offsets)
        place = self.index.find(keys)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new, at = np.unique(keys[missing], return_index=True)
            if self.index.size + len(new) > PIECES_KEPT:
                self._forget()
                new, at = np.unique(keys, return_index=True)
                missing = np.arange(len(keys))
            at = missing[at]
            text = data.tobytes()
            for a in range(0, len(new), PIECES_A_CALL):
                part = at[a : a + PIECES_A_CALL]
                self._keep(new[a : a + PIECES_A_CALL], [text[s:e].decode("utf-8", "replace") for s, e in zip(starts[part], words.end[part])])
            place[missing] = self.index.find(keys[missing])
        begin = self.first[place]
        sizes = self.first[place + 1] - begin
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.ids[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], sizes)]
        cuts = ends[words.first]
        rows = [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        for r in rare:
            rows[r] = np.array(self.fresh([data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace")])[0], np.uint32)
        return rows

    def _keep(self, keys: np.ndarray, pieces: list[str]) -> None:
        got = self.fresh(pieces)
        sizes = [len(g) for g in got]
        more, n, total = np.array([i for g in got for i in g], np.uint32), self.index.size, self.used + sum(sizes)
        if total > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(total + total // 4 - self.used, np.uint32)])
        if n + len(keys) + 1 > len(self.first):
            self.first = np.concatenate([self.first[: n + 1], np.zeros((n + len(keys)) // 4 + len(keys), np.int64)])
        self.ids[self.used : total] = more
        self.first[n + 1 : n + len(keys) + 1] = self.used + np.cumsum(sizes)
        self.used = total
        self.index.add(keys)

    def fresh(self, pieces: list[str]) -> list[list[int]]:
        """The ids of pieces that the cache doesn't have."""
        out: list = [None] * len(pieces)
        left = range(len(pieces))
        if self.closes.any():
            # a run of letters, perhaps with closing marks, has one or two words, each ending in one closing
            # token; such pieces go through the library as one text and are told apart again
            bare = [p.rstrip(".,!?;:") for p in pieces]
            plain = [i for i, b in enumerate(bare) if b.isalpha()]
            ids = np.array(self.tokenizer.encode(" ".join([pieces[i] for i in plain]), add_special_tokens=False).ids, np.int64)
            words = np.cumsum([1 + (len(bare[i]) < len(pieces[i])) for i in plain])
            closing = np.flatnonzero(self.closes[ids]) + 1
            if len(plain) and len(closing) == words[-1]:
                flat, cuts = ids.tolist(), [0, *closing[words - 1].tolist()]
                for k, i in enumerate(plain):
                    out[i] = flat[cuts[k] : cuts[k + 1]]
                left = [i for i, got in enumerate(out) if got is None]
        for i, got in zip(left, self.tokenizer.encode_batch_fast([pieces[i] for i in left], add_special_tokens=False)):
            out[i] = got.ids
        return out


def encoder(path: str) -> PieceEncoder:
    return worker_cache(f"pieces of {path}", lambda: PieceEncoder(path))
