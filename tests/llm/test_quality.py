import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.helpers import ODD, table
from wardenlake.llm import quality as Q
from wardenlake.llm.common import arrow_bytes

GOOD = [f"The plain sentence number {i} says a thing. Then it ends well." for i in range(30)]
BAD = [f"BUY!! NOW!! CHEAP!! {i}!! DEAL!!" for i in range(30)]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_separates_and_takes_odd_rows(spark):
    docs = table(spark, [*GOOD, *BAD])
    marks = labels(spark, [(i, int(i < 30), 0) for i in range(60)] + [(None, 1, 0), (3, None, 0), (999, 1, 0)])
    model = Q.train(docs, marks, F.lit(True))
    asked = table(spark, ["The other sentence says a thing. It ends.", "CHEAP!! BUY!! DEAL!!", *ODD], extra=True)
    rows = {r["doc_id"]: r for r in Q.score(asked, model).collect()}
    assert rows[0]["predicted"] == 1 and rows[1]["predicted"] == 0 and len(rows) == 2 + len(ODD)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows.values())
    assert rows[2]["score"] == rows[3]["score"] and rows[10]["score"] == rows[11]["score"]


def test_one_class_and_no_labels(spark):
    docs = table(spark, GOOD)
    assert Q.score(docs, Q.train(docs, labels(spark, [(i, 1, 0) for i in range(9)]), F.lit(True))).where("predicted = 1").count() == 30
    none = Q.train(docs, labels(spark, []), F.lit(True))
    assert {r["score"] for r in Q.score(docs, none).collect()} == {0.5}
    assert Q.score(table(spark, []), none).count() == 0


def test_features_are_sets_of_whole_texts():
    data, offsets = arrow_bytes(pa.array(["a b a b a b", "a b", ""]))
    one, two, three = Q.distinct_rows(*Q.features(data, offsets))
    assert set(two) <= set(one) and len(set(one)) == len(one) and len(three) == 0


def test_dual_coordinate_descent_finds_the_margin():
    weight = Q.dual_coordinate_descent(np.array([0, 1, 2, 4]), np.array([0, 1, 0, 1]), np.array([1.0, 1.0, 0.8, 0.6]), np.array([1.0, -1.0, 1.0]), np.full(3, 100.0), 2, rounds=2000)
    assert weight @ [1, 0] >= 0.99 and weight @ [0, 1] <= -0.99 and weight @ [0.8, 0.6] >= 0.99


def test_held_out_accuracy(spark):
    from wardenlake.llm.queries import QUERIES

    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = QUERIES["op10_quality_classifier"](spark, "/root/testdata/sf0.01").where("held_out").join(marks, "doc_id")
    assert out.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.95


def plain_model(sets, positive):
    """Ratios, weights and curve by sums over dictionaries and a slow ascent of the dual problem."""
    seen = [Counter(f for own, label in zip(sets, positive) if label == side for f in own) for side in (0, 1)]
    total = [Q.BUCKETS + sum(c.values()) for c in seen]
    ratio = {f: math.log((seen[1][f] + 1) / total[1]) - math.log((seen[0][f] + 1) / total[0]) for f in {*seen[0], *seen[1]}}
    place = {f: i for i, f in enumerate(sorted(ratio))}
    x = np.zeros((len(sets), len(place)))
    for i, own in enumerate(sets):
        for f in own:
            x[i, place[f]] = ratio[f]
    x /= np.sqrt((x**2).sum(axis=1, keepdims=True))
    sign, share = np.where(positive, 1.0, -1.0), np.mean(positive)
    signed = x * sign[:, None]
    gram, alpha, cost = signed @ signed.T, np.zeros(len(sets)), np.where(positive, 0.5 / share, 0.5 / (1 - share))
    for _ in range(50_000):
        alpha = np.clip(alpha + (1 - gram @ alpha) / np.linalg.norm(gram, 2), 0, cost)
    return ratio, {f: w for f, w in zip(sorted(ratio), signed.T @ alpha)}


def test_margins_against_a_plain_version(spark):
    """The trained model orders new texts as the exact solution does, with nearly its margins, and scores are the curve over them."""
    rng = random.Random(2)
    pool = [[f"calm{i}" for i in range(40)], [f"loud{i}" for i in range(40)], [f"both{i}" for i in range(40)]]
    text = lambda good: " ".join(rng.choice(pool[2] if rng.random() < 0.6 else pool[good] if rng.random() < 0.7 else pool[1 - good]) for _ in range(25))
    texts = [text(i % 2) for i in range(80)]
    asked = [text(i % 2) for i in range(40)]
    model = Q.train(table(spark, texts), labels(spark, [(i, int(i % 2 == 0), 0) for i in range(80)]), F.lit(True))
    sets = lambda rows: [set(r.tolist()) for r in Q.distinct_rows(*Q.features(*arrow_bytes(pa.array(rows))))]
    ratio, weight = plain_model(sets(texts), [i % 2 == 0 for i in range(80)])
    got = {r["doc_id"]: r["score"] for r in Q.score(table(spark, asked), model).collect()}
    margins = []
    for i, own in enumerate(sets(asked)):
        known = [f for f in own if f in ratio]
        margins.append(sum(weight[f] * ratio[f] for f in known) / math.sqrt(sum(ratio[f] ** 2 for f in known)))
        assert abs(math.log(got[i] / (1 - got[i])) - (model.slope * margins[i] + model.shift)) < 0.05 * model.slope
    assert np.corrcoef(margins, [math.log(got[i] / (1 - got[i])) for i in range(40)])[0, 1] > 0.999
