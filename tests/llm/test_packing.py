import itertools
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import ODD, table
from tests.llm.test_bpe_codec import BYTE, library
from wardenlake.llm import packing as P


def test_fullest_against_all_subsets():
    rng = np.random.default_rng(1)
    for _ in range(200):
        items = rng.integers(1, 30, rng.integers(0, 9)).tolist()
        room = int(rng.integers(0, 60))
        counts = np.bincount(items, minlength=64) if items else np.zeros(64, int)
        got = P.fullest(counts, room)
        best = max(sum(c) for r in range(len(items) + 1) for c in itertools.combinations(items, r) if sum(c) <= room)
        assert sum(got) == best and (np.bincount(got, minlength=64) <= counts).all()


def best_fit_decreasing(lengths, capacity):
    free, bins = defaultdict(int), 0
    for n in sorted(lengths, reverse=True):
        room = min((r for r, k in free.items() if k and r >= n), default=None)
        if room is None:
            bins, room = bins + 1, capacity
        else:
            free[room] -= 1
        free[room - n] += 1
    return bins


def test_plan_fills_sequences():
    for seed in range(6):
        rng = np.random.default_rng(seed)
        lengths = np.minimum(rng.exponential(300, 400).astype(int) + 1, 1024)
        plan = P.minimum_slack_plan(np.bincount(lengths, minlength=1025))
        ranks = np.zeros(len(lengths), int)
        for n in np.unique(lengths):
            ranks[lengths == n] = np.arange((lengths == n).sum())
        sequence, offset = plan.place(lengths, ranks)
        gapless(zip(sequence.tolist(), offset.tolist(), lengths.tolist()))
        assert len(np.unique(sequence)) == plan.sequences <= best_fit_decreasing(lengths, 1024)


def gapless(places, capacity=1024):
    by = defaultdict(list)
    for sequence, offset, length in places:
        by[sequence].append((offset, length))
    for rows in by.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_and_packing(spark):
    texts = [*ODD, *(f"text {'again ' * i}" for i in range(300))]
    docs = table(spark, texts, extra=True)
    own = library(BYTE)
    want = set()
    for i, t in enumerate(texts):
        n = len(own.encode(t or "", add_special_tokens=False).ids) + 1
        first = n % 1024 or 1024
        cuts = [0, *range(first, n + 1, 1024)]
        want |= {(i, k, a, b - a) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    rows = P.pack(P.token_pieces(docs, BYTE)).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"]) for r in rows} == want and len(rows) == len(want)
    gapless((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    assert P.pack(P.token_pieces(table(spark, []), BYTE)).count() == 0


def test_repeated_rows_and_null_keys_keep_their_places(spark):
    docs = table(spark, ["same text"] * 3).selectExpr("cast(if(doc_id = 2, null, 7) as long) doc_id", "text")
    rows = P.pack(P.token_pieces(docs, BYTE)).collect()
    assert len(rows) == 3 and gapless((r["sequence_id"], r["offset"], r["length"]) for r in rows) == 1


def test_columns_with_clashing_names(spark):
    """Columns called like results are replaced, those called like inner ones stay."""
    pieces = P.token_pieces(table(spark, [f"text {'again ' * i}" for i in range(40)]), BYTE)
    others = ["group", "n", "before", "rank", "__group", "__n", "__before", "__rank", "c0"]
    extra = pieces.select("*", *[F.lit(name).alias(name) for name in others], F.lit("old").alias("sequence_id"), F.lit("old").alias("Offset"))
    plain = lambda rows: gapless((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    rows = P.pack(extra).collect()
    assert len(rows) == 40 and plain(rows) == plain(P.pack(pieces).collect())
    assert all(r[name] == name for r in rows for name in others)
