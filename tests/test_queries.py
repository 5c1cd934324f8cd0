"""Every registered query against its SQL on the smallest tables, plus what the plans must show."""

import re
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from newsloom.functions.chunking import split_recursive  # noqa: E402
from tools.check import compare, connect  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"

if not Path(SF_DIR).exists():
    pytest.skip("no test tables", allow_module_level=True)


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(
    n for n in entry.queries() if n in entry.oracle_sql() or not re.match(r"op\d+_|pipeline$", n)))
def test_query_matches_its_sql(spark, con, name):
    assert compare(spark, con, name, SF_DIR)[2] is None


def test_only_the_recursive_splitter_has_no_sql():
    own = {n for n in entry.queries() if not re.match(r"op\d+_|pipeline$", n)}
    assert own - set(entry.oracle_sql()) == {"chunk_recursive"}


def test_recursive_chunks_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    want = {str(r["doc_id"]): split_recursive(r["text"]) for r in docs}
    got = {}
    for r in entry.queries()["chunk_recursive"](spark, SF_DIR).collect():
        assert 0 <= r["chunk_index"] < r["total_chunks"]
        got.setdefault(r["url"].rsplit("/", 1)[1], {})[r["chunk_index"]] = r["text"]
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {
        k: v for k, v in want.items() if v}


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "chunk_id" in df.columns


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["retrieve", "cosine_topk_grid", "kb_lookup", "new_articles_anti"])
def test_no_cross_joins(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_scans_read_only_what_is_asked(spark):
    plan = plan_of(entry.queries()["recency_window"](spark, SF_DIR))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in plan
    plan = plan_of(entry.queries()["validate_label"](spark, SF_DIR))
    assert "html" not in plan and "ReadSchema: struct<conv_id:bigint,turn:bigint,role:string,text:string>" in plan


def test_retrieval_windows_share_one_exchange(spark):
    """Top-k, dedup and the recency rules all run on the questions' partitioning."""
    q = spark.range(4).select(
        F.col("id").alias("q_id"), F.array(F.lit(1.0).cast("float")).alias("embedding"),
        F.lit(12).alias("hours"))
    c = spark.range(4).select(
        F.col("id").alias("chunk_id"), F.lit("u").alias("url"), F.lit("d").alias("date"),
        F.current_timestamp().alias("published_at"), F.array(F.lit(1.0).cast("float")).alias("embedding"))
    from newsloom.operators.retrieval import retrieve

    assert plan_of(retrieve(q, c)).count("Exchange hashpartitioning") <= 2
