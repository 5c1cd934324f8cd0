import re
from random import Random

import numpy as np
import pytest

from newsloom.llm import jaccard
from newsloom.llm.components import components
from tests.llm.conftest import prose


def by_hand(rows, n, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append((i, {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets)


def near_copies(r, groups, n_words):
    """Groups of copies with few and with many changed words, around and below the threshold."""
    rows = []
    for g in range(groups):
        base = prose(g + 1, r.choice(n_words)).split()
        for _ in range(r.randint(1, 14)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = prose(r.randint(1, 10**6), 1)
            if r.random() < 0.2:
                w = w[:r.randint(1, len(w))]
            rows.append(" ".join(w).title() if r.random() < 0.2 else " ".join(w))
    r.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80), (1, 50)])
def test_against_all_pairs(spark, n, percent):
    rows = near_copies(Random(n), 22, [1, 2, 4, 8, 12, 20, 40, 90, 200, 400])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, jaccard.similar(docs, n, percent).collect()))
    assert got == by_hand(rows, n, percent)


def test_one_large_group(spark):
    rows = near_copies(Random(50), 1, [120])
    r, base = Random(51), prose(77, 120).split()
    for i in range(300):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = prose(r.randint(1, 10**6), 1)
        rows.append((1000 + i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.similar(docs).collect())) == by_hand(rows, 3, 90)


@pytest.mark.parametrize("fan", [2, 5])
def test_tree_levels_against_all_pairs(spark, monkeypatch, fan):
    """With few children to a node: blocks re-rooted by rarest hashes, inner nodes on several levels."""
    monkeypatch.setattr(jaccard, "FAN", fan)
    r = Random(60 + fan)
    shared = prose(500, 90)
    rows = near_copies(r, 8, [12, 40, 90, 200])
    rows += [(10_000 + i, shared + " " + prose(900 + i // 2, 9 + i // 6) + f" extra{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.similar(docs).collect())) == by_hand(rows, 3, 90)


def test_leaf_pairs_find_what_all_pairs_find(spark, monkeypatch):
    """Trees of three levels: every pair of leaves that may link is found, and once only."""
    monkeypatch.setattr(jaccard, "FAN", 2)
    r = np.random.default_rng(3)
    rows = []
    for i in range(60):
        n = int(r.integers(20, 40))
        values = np.r_[np.arange(18), r.integers(-2**62, 2**62, n - 18, dtype=np.int64)].view(np.uint64)
        bits = jaccard.bitmaps(values, np.array([n]))[0]
        spare = n - sum(int(b).bit_count() for b in bits.view(np.uint64))
        rows += [(key, i // 2, i, *map(int, bits), n, n, spare, i // 2, i // 2) for key in (5, 6 + i % 2)]
    under = spark.createDataFrame(rows, "key long, label long, leaf long, " + ", ".join(
        f"{x} {'int' if x in ('fewest', 'most', 'spare') else 'long'}" for x in jaccard.NODE))
    got = [tuple(sorted(((p.la, p.fa), (p.lb, p.fb)))) for p in jaccard._leaf_pairs(under, 60).collect()]
    flat = under.where("key = 5")
    want = flat.alias("a").join(flat.alias("b"), jaccard.F.expr(
        "a.key = b.key AND a.label < b.label") & jaccard._may_link("a", "b", 60)).select(
        "a.label", "a.leaf", "b.label", "b.leaf").collect()
    assert len(got) == len(set(got)) > 20
    assert set(got) == {tuple(sorted(((p[0], p[1]), (p[2], p[3])))) for p in want}


def test_shared_passage_of_many_unlinked_documents(spark, monkeypatch):
    """Documents that share no more than one long passage do not meet pair by pair."""
    shared = prose(600, 200)
    rows = [(i, shared + " " + " ".join(f"w{i}x{k}" for k in range(24))) for i in range(600)]
    rows += [(5000, rows[0][1] + " end"), (5001, rows[1][1])]
    under = []
    walk = jaccard._leaf_pairs
    monkeypatch.setattr(jaccard, "_leaf_pairs", lambda u, p: under.append(u) or walk(u, p))
    got = {r.doc_id: r.component_id for r in jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(600)} | {5000: 0, 5001: 1}
    met = under[0].groupBy("key").count().selectExpr("sum(count * count)").first()[0] or 0
    assert met < 600 * 600 / 20


def test_linked_sets_share_a_block():
    r = np.random.default_rng(1)
    for percent in (80, 90):
        for n in [*range(1, 120), 300, 1000]:
            lost = jaccard.loss(n, percent)
            for extra in (0, lost // 2, lost):
                base = r.integers(-2**62, 2**62, n, dtype=np.int64)
                other = np.r_[base[:n - (lost - extra) // 2], r.integers(-2**62, 2**62, extra + (lost - extra) // 2, dtype=np.int64)]
                both = len(np.intersect1d(base, other))
                if not lost or 100 * both < percent * (len(base) + len(other) - both):
                    continue
                values = np.r_[base, other].view(np.uint64)
                a, b = jaccard.block_keys(values, np.array([len(base), len(other)]), percent)
                assert np.intersect1d(a, b).size, (percent, n, extra)


def test_chance_to_miss_a_pair():
    for percent in (80, 85, 90, 95):
        assert max(jaccard.miss(n, percent) for n in [*range(1, 1000), 3000, 10**5, 10**7]) < 1e-11, percent


def test_one_doc_id_with_several_texts(spark):
    a, b = prose(1, 60), prose(2, 60)
    rows = [(3, a), (7, a), (7, b), (5, b), (7, None), (9, prose(3, 60)), (9, prose(4, 60)), (10, prose(4, 60)), (11, prose(9, 50))]
    got = sorted(map(tuple, jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == sorted([(3, 58, 3), (7, 58, 3), (7, 58, 3), (5, 58, 3), (7, 0, 3), (9, 58, 9), (9, 58, 9),
                          (10, 58, 9), (11, 48, 11)])


def test_bounds_keep_linked_pairs(spark):
    """No pair that links is dropped by bitmaps and sizes."""
    r = np.random.default_rng(2)
    rows = []
    for n in (10, 60, 400, 3000):
        base = r.integers(-2**62, 2**62, n, dtype=np.int64)
        other = np.r_[base[: n - n // 25], r.integers(-2**62, 2**62, n // 30, dtype=np.int64)]
        both = n - n // 25
        assert 100 * both >= 90 * (n + len(other) - both)
        for s in (base, other):
            bits = jaccard.bitmaps(s.view(np.uint64), np.array([len(s)]))[0]
            rows.append((n, len(s), *map(int, bits)))
    bits = ", ".join(f"{b} long" for b in jaccard.BITS)
    t = spark.createDataFrame(rows, f"g int, n int, {bits}").selectExpr(
        "g", *jaccard.BITS, "n AS fewest", "n AS most", "n - " + " - ".join(f"bit_count({b})" for b in jaccard.BITS) + " AS spare")
    both = t.alias("a").join(t.alias("b"), jaccard.F.expr("a.g = b.g")).where(jaccard._may_link("a", "b", 90))
    assert both.count() == 16


def test_components(spark):
    links = [(i + 1, i) for i in range(200)] + [(1000 + i, 1000) for i in range(1, 300)] + [(5000, 4000), (4000, 5000), (7, 7)]
    got = {r["id"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)} | {4000: 4000, 5000: 4000}
    assert got == want


def test_odd_rows(odd, none):
    got = sorted(map(tuple, jaccard.similar(odd, 3, 90).collect()), key=str)
    assert len(got) == odd.count()
    assert [r for r in got if r[0] in (1, 2, 3, 9)] == [(i, 0, i) for i in (1, 2, 3, 9)]
    assert {r[2] for r in got if r[0] in (4, 7)} == {4}
    assert [r for r in got if r[0] is None] == [(None, 38, None)]
    assert jaccard.similar(none, 3, 90).collect() == []


def test_hashes_of_one_component_bring_no_keys(spark):
    """op10: copies in one component need not meet, whatever their number; a partner elsewhere is found."""
    rng = Random(4)
    word = lambda: f"w{rng.randrange(10**9)}"
    base = [word() for _ in range(60)]
    near = [[f"x{i}", *base[1:]] for i in range(40)]
    other = [*base[:-1], "y"]
    texts = [" ".join(ws) for ws in [*near, other, [word() for _ in range(60)]]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    label = [0] * 40 + [40, 41]
    ids = spark.createDataFrame(list(enumerate(label)), "id long, label long")
    alone = ids.where("id < 40")
    assert jaccard._by_rarest(alone, docs, 3, 90).count() == 0
    keys = {}
    for r in jaccard._by_rarest(ids, docs, 3, 90).collect():
        keys.setdefault(r["key"], set()).add(r["id"])
    assert keys and all(len({label[i] for i in x}) > 1 for x in keys.values())
    assert set(range(41)) == set().union(*keys.values())
