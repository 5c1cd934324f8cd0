import re

from tools.check import connect

from newsloom.llm import mixing
from newsloom.llm.registry_sql import MIX_TARGETS

SF_DIR = "/root/testdata/sf0.001"


def targets(sizes):
    """Water-filling on whole numbers: reshare until nobody is above the cap."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest, open_ = total - sum(3 * sizes[s] for s in full), [s for s in names if s not in full]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return share | {s: 3 * sizes[s] for s in full}
        full |= over


def test_targets_and_taken(spark):
    docs = [(i, s, "w " * n) for i, (s, n) in enumerate(
        [("a", 5), ("b", 40), ("c", 3), (None, 7), ("", 20)] * 6 + [("d", 1), ("e", 0), ("f", 900)])]
    table = spark.createDataFrame(docs, "doc_id long, source string, text string")
    got = mixing.mix(table).collect()
    sizes = {}
    for _, s, t in docs:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = targets(sizes)
    assert len(got) == len(docs)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["taken"] // max(1, r["size"]) >= int(round(r["target"]) // max(1, r["source_size"]))
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(table.repartition(5)).collect()))


def test_given_table_against_sql(spark):
    got = {r["source"]: (r["source_size"], round(r["target"], 6)) for r in mixing.mix(
        spark.read.parquet(f"{SF_DIR}/documents.parquet")).collect()}
    rows = connect(SF_DIR).execute(MIX_TARGETS).fetchall()
    assert got == {s: (n, round(t, 6)) for s, n, t in rows}


def test_odd_rows(odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count()
    assert {r["size"] for r in got if r["doc_id"] in (1, 2, 3, 9)} == {0}
    assert sum(r["taken"] for r in got) == sum(r["size"] for r in got)
    assert mixing.mix(none).collect() == [] and re.match(r"\d", str(mixing.SEED))
