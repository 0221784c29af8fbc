import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import ODD, table
from wardenlake.llm import bpe_codec as B
from wardenlake.llm import tokens as T

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "B", " ", "  ", "\n", "\n ", "\t", "é", "É", "'s", "'LL", "12", "٣", "!!", "<|endoftext|>", "<|ENDOFTEXT|>", "Σ", "ΟΔΟΣ", "İ", "\xa0", " ", "\x1c", "\x85", "日本", "ß", "🙂", "th", "ing", "\x00", "|", "é"]


def samples():
    rng = random.Random(5)
    out = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    out += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    out += ["".join(rng.choice(["th", "er", "in", "ing", "an", "a", "s", "ee"]) for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    return out + [t or "" for t in ODD]


def library(path):
    own = Tokenizer.from_file(path)
    own.no_padding()
    own.no_truncation()
    return own


@pytest.mark.parametrize("path", [WORD, BYTE])
@pytest.mark.parametrize("kept", [2_000_000, 300])
def test_pieces_give_the_ids_of_whole_texts(path, kept, monkeypatch):
    monkeypatch.setattr(T, "PIECES_KEPT", kept)
    own, texts, encoder = library(path), samples(), T.PieceEncoder(path)
    for a in range(0, len(texts), 100):
        for text, got in zip(texts[a : a + 100], encoder.encode(pa.array(texts[a : a + 100]))):
            assert got.tolist() == own.encode(text, add_special_tokens=False).ids


def test_backtracking_equals_the_library():
    own, texts, codec = library(WORD), samples(), B.Tables(WORD)
    for text, got in zip(texts, B.BacktrackingEncoder(WORD).encode(pa.array(texts))):
        assert got.tolist() == own.encode(text, add_special_tokens=False).ids
        assert codec.decode(got).decode() == own.decode(got.tolist(), skip_special_tokens=False)
        assert codec.decimals.joined(got).decode() == " ".join(map(str, got.tolist()))


def test_every_code_point_is_split_as_by_the_library():
    own, codec = library(WORD), B.BacktrackingEncoder(WORD)
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{c}1" for c in points[a : a + 16]) for a in range(0, len(points), 16)]
    for a in range(0, len(texts), 2000):
        want = own.encode_batch_fast(texts[a : a + 2000], add_special_tokens=False)
        for text, ids in zip(texts[a : a + 2000], want):
            assert codec.text_ids(text) == ids.ids, text


def test_columns_left_aside(spark):
    docs = table(spark, ["a b", "x" * 300_000], extra=True).withColumn("ids", F.lit("clash")).withColumn("__text", F.lit("clash"))
    twice = docs.unionByName(docs)
    got = [tuple(r) for r in B.encode(twice, WORD).collect()]
    assert len(got) == 4 and len(set((k, tuple(i)) for k, i in got)) == 2


def test_borders_equal_merging_from_scratch():
    words = B.Vocabulary(WORD)

    def merge(symbols):
        symbols = list(symbols)
        while True:
            ranks = [(words.rank.get(pair, 1 << 40), i) for i, pair in enumerate(zip(symbols, symbols[1:]))]
            if not ranks or min(ranks)[0] == 1 << 40:
                return symbols
            i = min(ranks)[1]
            symbols[i : i + 2] = [words.ids[names[symbols[i]] + names[symbols[i + 1]]]]

    names = {i: t for t, i in words.ids.items()}
    rng = np.random.default_rng(0)
    plain = sorted(i for t, i in words.ids.items() if not t.endswith("\n"))
    common = [i for i in plain if i < 3000]
    for _ in range(4000):
        left, right = (int(rng.choice(common)) for _ in range(2))
        whole = merge([words.ids[c] for c in names[left] + names[right]])
        assert words.borders(left, right) == (whole == [left, right])


def test_columns(spark):
    docs = table(spark, ["Hello there", None, ""], extra=True).withColumn("ids_text", F.lit("clash"))
    rows = {r["doc_id"]: r for r in B.decode(B.encode(docs, WORD), WORD).collect()}
    assert rows[0]["n_tokens"] == 2 and bytes(rows[0]["text"]) == b"hello</w> there</w>"
    assert all(rows[i]["n_tokens"] == 0 and bytes(rows[i]["ids_text"]) == b"" for i in (1, 2))
    assert B.round_trip(docs, WORD).orderBy("doc_id").collect() == B.decode(B.encode(docs, WORD), WORD).orderBy("doc_id").collect()
    assert B.encode(table(spark, []), WORD).count() == B.round_trip(table(spark, []), WORD).count() == 0
