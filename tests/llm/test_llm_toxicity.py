import zlib
from itertools import combinations
from random import Random

import numpy as np

from newsloom.llm import toxicity


def all_maximal(scores):
    """By the definition: take the best segment (the shortest, first one), then go on to both sides."""
    best, n = None, len(scores)
    for a, b in combinations(range(n + 1), 2):
        s = sum(scores[a:b])
        if s > 1e-12 and (best is None or s > best[2] + 1e-12 or abs(s - best[2]) <= 1e-12 and b - a < best[1] - best[0]):
            best = (a, b, s)
    if best is None:
        return []
    a, b, s = best
    right = [(x + b, y + b, z) for x, y, z in all_maximal(scores[b:])]
    return [*all_maximal(scores[:a]), best, *right]


def test_segments_against_the_definition():
    r = Random(7)
    for _ in range(400):
        n = r.randint(1, 14)
        at = sorted(r.sample(range(n), r.randint(1, n)))
        gains = [r.choice([0.7, 1.3, 2.9]) for _ in at]
        scores = [-0.61] * n
        for i, g in zip(at, gains):
            scores[i] = g
        got = toxicity.segments(np.array(at), np.array(gains), n, 0.61)
        want = all_maximal(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_words_are_learnt_and_scored_alike(spark):
    assert toxicity.tokens_of("हिन्दी मूर्ख, ÉTÉ e\u0301te\u0301") == ["हिन्दी", "मूर्ख", "été", "e\u0301te\u0301"]
    rows = [(i, f"{'मूर्ख ' * 3 if i % 2 else ''}हिन्दी शब्द {i} " * 5, i % 2) for i in range(400)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert "मूर्ख" in model.scores.terms and "हिन्दी" not in model.scores.terms
    assert model.score("हिन्दी मूर्ख मूर्ख शब्द") > 0.9 > 0.1 > model.score("हिन्दी शब्द")


def test_held_out_rows_decide_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == docs.count() and all(r["held_out"] == out(i) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(), 1 - labels.toxic).otherwise(labels.toxic))
    again = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, flipped).collect()}
    assert all(abs(again[i] - r["score"]) < 1e-9 for i, r in got.items())


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    seen = toxicity.toxicity(docs, labels).where("held_out").join(labels, "doc_id").groupBy(
        "toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in seen}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n.get((1, 0), 0)) and n[1, 1] >= 0.9 * (n[1, 1] + n.get((0, 1), 0))


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (4, 1), (5, None), (None, 1), (4, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity(none, labels).collect() == []
    assert len(toxicity.toxicity(odd, labels.where("false")).collect()) == odd.count()
