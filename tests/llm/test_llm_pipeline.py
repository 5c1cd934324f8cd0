import re

import corpus_pipeline
from newsloom.llm import decontaminate, pii
from newsloom.llm.registry import QUERIES
from newsloom.llm.registry_sql import ORACLES
from tests.llm.test_llm_jaccard import by_hand
from tests.llm.test_llm_mixing import targets
from tools.check import connect

SF_DIR = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = {r[0] for r in connect(SF_DIR).execute(
        f"SELECT doc_id FROM ({ORACLES['op1_quality_rules']}) WHERE kept").fetchall()}
    good = corpus_pipeline.keep_good(spark, docs, SF_DIR)
    rows = {r["doc_id"]: r for r in good.collect()}
    assert set(rows) == kept and good.columns == docs.columns

    one = corpus_pipeline.keep_one_of_each(spark, good, SF_DIR)
    want = {i for i, _, c in by_hand([(i, r["text"]) for i, r in rows.items()], 5, 80) if i == c}
    assert {r["doc_id"] for r in one.collect()} == want and one.columns == docs.columns

    clean = corpus_pipeline.drop_contaminated(spark, one, SF_DIR)
    items = [" ".join(decontaminate.terms(r["text"])) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    spelled = {i: " ".join(decontaminate.terms(rows[i]["text"])) for i in want}
    want = {i for i in want if not any(f" {x} " in f" {spelled[i]} " for x in items)}
    assert {r["doc_id"] for r in clean.collect()} == want

    masked = {r["doc_id"]: r for r in corpus_pipeline.mask_pii(spark, clean, SF_DIR).collect()}
    assert set(masked) == want
    for i, r in masked.items():
        assert r["text"] == pii.mask(rows[i]["text"], pii.find_spans(rows[i]["text"]))
        assert r["n_chars"] == len(r["text"]) and not re.search(r"[a-z0-9]@[a-z0-9]+\.[a-z]", r["text"])

    got = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r["doc_id"] for r in got} == want
    sizes, taken = {}, {}
    for r in got:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", masked[r["doc_id"]]["text"]))
        assert r["size"] == n and r["taken"] <= 3 * n
        sizes[r["source"]] = sizes.get(r["source"], 0) + n
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    wanted = targets(sizes)
    assert all(abs(taken[s] - wanted[s]) <= 0.5 + 1e-6 for s in sizes)


def test_odd_rows(spark, odd, none):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, SF_DIR)
        assert got.columns == odd.columns, name
        assert {r["kept"] for r in got.collect()} <= {"no"}, name
        assert stage(spark, none, SF_DIR).collect() == []
    one = corpus_pipeline.keep_one_of_each(spark, odd, SF_DIR).collect()
    assert sorted(str(r["doc_id"]) for r in one) == sorted(["1", "2", "3", "4", "5", "8", "9", "None"])


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_duplicates", "decontamination", "pii", "mixing"]
    assert {int(n.split("_")[0][2:]) for n in QUERIES} == set(range(1, 14))
