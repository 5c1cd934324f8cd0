import gc
from collections import Counter
from random import Random
from weakref import finalize

import numpy as np

from newsloom.llm import decontaminate as d
from tests.llm.conftest import prose

ITEMS = [(i, f"{prose(i, 25)}. {prose(500 + i, 8)}.") for i in range(60)]


def test_wand_returns_all_above_the_threshold():
    r = Random(4)
    shared = [prose(900 + i, 1) for i in range(40)]
    index = d.Index([(i, " ".join(r.sample(shared, 15) + [prose(i, 4)])) for i in range(80)])
    for _ in range(200):
        found = sorted(r.sample(range(len(index.items)), r.randint(1, 60)))
        sums = Counter()
        for t in found:
            for i, g in zip(index.items[t].tolist(), index.impacts[t].tolist()):
                sums[i] += g
        for least in (0.2, 0.4, 0.5, 0.7):
            got = index.wand(found, index.live_blocks(np.array(found), least), least)
            assert {i for i, _ in got} == {i for i, s in sums.items() if s >= least + 1e-12}


def test_planted_items(spark):
    docs = [(i, prose(1000 + i, 300)) for i in range(30)]
    docs[3] = (3, docs[3][1] + " " + ITEMS[7][1].upper() + " " + prose(1, 40)[:100])
    docs[4] = (4, ITEMS[8][1].replace(".", "") + " " + docs[4][1])
    docs[5] = (5, prose(9, 25) + " " + docs[5][1])  # a question without its answer
    docs[6] = (6, docs[6][1] + f" {ITEMS[7][1]} {ITEMS[1][1]}")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS + [(None, "x"), (98, None), (99, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in d.contaminated(table, items).collect()}
    assert got == {(3, 7), (4, 8), (6, 7), (6, 1)}


def test_several_indexes_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(d, "INDEX_ITEMS", 20)
    table = spark.createDataFrame([(i, t) for i, t in ITEMS[:10]], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert len(d.indexes(items)) == 3
    assert {(r["doc_id"], r["item_id"]) for r in d.contaminated(table, items).collect()} == {(i, i) for i in range(10)}


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert d.contaminated(odd, items).collect() == [] and d.contaminated(none, items).collect() == []
    assert d.contaminated(odd, items.where("false")).collect() == []


def test_several_indexes_give_the_same_scores(spark, monkeypatch):
    """Also for items in part and of unequal length, whose scores lie on both sides of the threshold."""
    r = Random(8)
    common = [prose(700 + i, 1) for i in range(12)]
    texts = [" ".join(r.sample(common, 6) + prose(i, r.randint(4, 60)).split()) + f". {prose(300 + i, 3)}." for i in range(60)]
    rows = []
    for i, t in enumerate(texts):
        ws = t.split()
        rows.append((i, f"{prose(2000 + i, 80)} {' '.join(ws[:r.randint(len(ws) // 3, len(ws))])} {' '.join(ws[-4:])} {prose(3000 + i, 80)}"))
    items = spark.createDataFrame([*enumerate(texts), (None, "x"), (98, None), (99, "")], "item_id long, text string")
    table = spark.createDataFrame(rows, "doc_id long, text string")
    one = sorted(map(tuple, d.contaminated(table, items).collect()))
    monkeypatch.setattr(d, "INDEX_ITEMS", 10)
    assert len(d.indexes(items)) == 7
    assert sorted(map(tuple, d.contaminated(table, items).collect())) == one
    assert 20 < len(one) < 60 and any(x[2] < 0.95 for x in one)


def test_one_index_is_alive_at_a_time(spark, monkeypatch):
    alive, most, init = set(), [], d.Index.__init__

    def watched(index, *given):
        gc.collect()
        init(index, *given)
        alive.add(len(most))
        finalize(index, alive.discard, len(most))
        most.append(len(alive))

    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [(i, t) for i, t in ITEMS[:10]] + [(100, prose(100, 60)), (101, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(d, "INDEX_ITEMS", 20)
    monkeypatch.setattr(d.Index, "__init__", watched)
    assert {(r["doc_id"], r["item_id"]) for r in d.contaminated(table, items).collect()} == {(i, i) for i in range(10)}
    assert {r["doc_id"] for r in d.clean(table, items).collect()} == {100, 101}
    assert most == [1] * 6
