import hashlib
from random import Random

import numpy as np
import pytest

from newsloom.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, v string"


def by_hand(rows, clusters, rounds):
    """Every distance in Python integers."""
    kept = []
    for vec_id, v, *_ in rows:
        if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v):
            kept.append((vec_id, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    order = sorted(kept, key=lambda k: (k[0] is None, hashlib.sha256(f"2:{k[0]}".encode()).hexdigest(), k[1]))
    means = [v for _, v in order[:clusters]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min(range(len(means)), key=lambda c: (far(v, means[c]), c))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v), []).append(v)
        means = [[sum(x) // len(groups[c]) for x in zip(*groups[c])] if c in groups else m for c, m in enumerate(means)]
    got = [(i, c, far(v, means[c])) for i, v in kept for c in (nearest(v),)]
    total = {c: sum(d for _, x, d in got if x == c) for c in range(len(means))}
    names = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means]
    return sorted(((i, c, d, total[c], sum(total.values()), names[c]) for i, c, d in got), key=str)


def vectors(r, n):
    rows = [(i, [r.uniform(-2, 2) for _ in range(64)], 0, "x", "y") for i in range(n)]
    rows += [(i + 1000, rows[i % 5][1], 0, "x", "y") for i in range(25)] + rows[:4]
    # Vectors half way between two others, for ties.
    rows += [(2000 + i, [(a + b) / 2 for a, b in zip(rows[i][1], rows[i + 1][1])], 0, None, None) for i in range(10)]
    nan, inf = float("nan"), float("inf")
    return rows + [(3000, None, 0, "", ""), (3001, [], 0, "", ""), (3002, [1.0] * 63, 0, "", ""), (3003, [1.0] * 65, 0, "", ""),
                   (3004, [nan] + [1.0] * 63, 0, "", ""), (3005, [None] + [1.0] * 63, 0, "", ""),
                   (3006, [-inf] + [1.0] * 63, 0, "", ""), (None, [0.5] * 64, 0, "", "")]


@pytest.mark.parametrize("n, clusters", [(120, 12), (6, 40)])
def test_against_every_distance(spark, n, clusters):
    rows = vectors(Random(n), n)
    got = centroids.cluster(spark.createDataFrame(rows, SCHEMA).repartition(5), clusters, 3)
    assert sorted(map(tuple, got.collect()), key=str) == by_hand(rows, clusters, 3)


def test_tournament_finds_the_nearest():
    r = np.random.default_rng(1)
    means = r.integers(-3, 4, (9, 5))
    means[7] = means[2]
    x = r.integers(-4, 5, (3000, 5))
    far = ((x[:, None, :] - means[None]) ** 2).sum(axis=2)
    held = centroids.Bisectors(means.tolist(), 5)
    best = held.nearest(x)
    assert (best == far.argmin(axis=1)).all() and (held.distance(x, best) == far.min(axis=1)).all()
    assert (np.sort(far, axis=1)[:, 0] == np.sort(far, axis=1)[:, 1]).sum() > 100


def test_no_rows_and_too_large(spark):
    none = spark.createDataFrame([(1, None, 0, "", "")], SCHEMA)
    assert centroids.cluster(none).collect() == [] and centroids.cluster(none.where("false")).collect() == []
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [1e9] * 64, 0, "", "")], SCHEMA)).collect()
