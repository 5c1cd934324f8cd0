import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.operators import (
    context, history, ingest, lookup, retrieval, routing, similarity, skew, title_search, upsert,
)
from newsloom.sources import answer_log, articles as article_source, feeds

AS_OF = dt.datetime(2024, 1, 31)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# --- similarity ------------------------------------------------------------------------------


def vectors(spark, m, id_name):
    data = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    return spark.createDataFrame(data, f"{id_name} bigint, embedding array<float>").repartition(5)


def brute(q, c, k, min_score):
    out = []
    c64, q64 = c.astype(np.float32).astype(float), q.astype(np.float32).astype(float)
    for i, v in enumerate(q64):
        n = np.sqrt((v @ v) * (c64 * c64).sum(1))
        with np.errstate(all="ignore"):
            s = np.floor((c64 @ v) / n * 1e6 + 0.5) / 1e6
        order = sorted((j for j in range(len(s)) if s[j] == s[j]), key=lambda j: (-s[j], j))
        best = [j for j in order if min_score is None or s[j] >= min_score]
        out += [(i, j, float(s[j])) for j in (best if k is None else best[:k])]
    return sorted(out)


@pytest.mark.parametrize("strategy", ["broadcast", "grid"])
@pytest.mark.parametrize("k,min_score", [(3, None), (3, 0.6), (None, 0.8)])
def test_search_equals_brute_force(spark, strategy, k, min_score):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 8))
    c = centres[rng.integers(0, 6, 300)] + 0.3 * rng.normal(size=(300, 8))
    c[:100] = c[0]  # a third of the chunks are copies, so ties decide by id
    c[200] = 0.0  # similar to nothing
    q = np.vstack([c[rng.integers(0, 300, 25)], np.zeros((1, 8)), centres])
    hits = similarity.similarity_topk(
        vectors(spark, q, "q_id"), vectors(spark, c, "chunk_id"), k=k, min_score=min_score,
        strategy=strategy, pivots=7, block_rows=16,
    )
    got = sorted((r["q_id"], r["chunk_id"], r["score"]) for r in hits.collect())
    assert got == brute(q, c, k, min_score)


def test_many_questions_take_the_grid(spark):
    m = np.eye(6)
    q, c = vectors(spark, m, "q_id"), vectors(spark, m, "chunk_id")
    plan = similarity.similarity_topk(q, c, k=1, max_questions=5)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan
    plan = similarity.similarity_topk(q, c, k=1, max_questions=6)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" not in plan and "MapInArrow" in plan
    with pytest.raises(ValueError):
        similarity.similarity_topk(q, c, k=1, max_questions=5, strategy="broadcast")


def test_empty_sides(spark):
    some, none = vectors(spark, np.eye(3), "q_id"), vectors(spark, np.eye(3), "q_id").where("q_id < 0")
    chunks = some.withColumnRenamed("q_id", "chunk_id")
    for strategy in ("broadcast", "grid"):
        for q, c in ((none, chunks), (some, chunks.where("chunk_id < 0"))):
            assert similarity.similarity_topk(q, c, strategy=strategy).count() == 0


def test_search_sends_few_rows_to_the_shuffle(spark):
    m = np.eye(4)
    df = similarity.similarity_topk(vectors(spark, m, "q_id"), vectors(spark, m, "chunk_id"), k=2)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_grid_hands_on_few_hits_and_copies(spark, monkeypatch):
    """Up to k hits for each question and block of chunks, however many cells the block has."""
    rng = np.random.default_rng(3)
    c, q = rng.normal(size=(1000, 8)), rng.normal(size=(100, 8))
    c[:400] = c[0]
    q[:50] = c[0]
    handed = []
    monkeypatch.setattr(similarity, "_top", lambda hits, *a: handed.append(hits) or hits)
    similarity.similarity_topk(
        vectors(spark, q, "q_id"), vectors(spark, c, "chunk_id"), k=5, strategy="grid", pivots=64, block_rows=64)
    got = sorted((r["q_id"], r["chunk_id"], r["score"]) for r in handed[0].collect())
    assert got == brute(q, c, 5, None)


def test_blocks_grow_with_the_tables():
    for n in (50_000, 500_000, 1_000_000):
        q_blocks, c_blocks = similarity._block_counts(n, n, 20, 4096, 24)
        assert q_blocks <= 32 and c_blocks <= 4
        assert q_blocks * c_blocks >= min(24, n // 4096)


def test_what_the_grid_sends_grows_as_the_tables():
    """F5 to F8: as many pairs of blocks for a small table as for a large one, so copies sent per row
    do not rise with the table."""
    copies = [similarity._block_counts(n, n, 20, 4096, 24) for n in (10_000, 100_000, 200_000)]
    assert copies == [(24, 1)] * 3
    q_blocks, c_blocks = similarity._block_counts(615_000, 615_000, 20, 4096, 24)
    assert q_blocks <= 24 and c_blocks <= 3


def test_grid_keeps_pairs_apart_and_scans_in_slabs(spark, monkeypatch):
    """a task of its own for each pair of blocks, however small, and slabs give the same hits."""
    rng = np.random.default_rng(8)
    c, q = rng.normal(size=(200, 6)), rng.normal(size=(50, 6))
    c[60:120] = c[5]
    monkeypatch.setattr(similarity, "_SLAB", 13)
    monkeypatch.setattr(similarity, "_top", lambda hits, *a: hits)
    hits = similarity.similarity_topk(
        vectors(spark, q, "q_id"), vectors(spark, c, "chunk_id"), k=5, strategy="grid")
    assert hits.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    assert sorted((r["q_id"], r["chunk_id"], r["score"]) for r in hits.collect()) == brute(q, c, 5, None)


@pytest.mark.parametrize("k,min_score", [(3, None), (3, 0.6), (None, -1)])
def test_large_search_shuffles_no_vectors(spark, monkeypatch, k, min_score):
    """beyond a number of bytes blocks of questions are broadcast, and hits without ``k`` are handed
    out while a block of chunks is scanned."""
    rng = np.random.default_rng(12)
    c, q = rng.normal(size=(300, 6)), rng.normal(size=(70, 6))
    c[40:90], c[7], q[3] = c[5], 0, 0
    monkeypatch.setattr(similarity, "MOST_SENT", 0)
    monkeypatch.setattr(similarity, "_SLAB", 64)
    monkeypatch.setattr(similarity, "_HELD", 50)
    none = spark.createDataFrame([(900, None), (901, [])], "chunk_id bigint, embedding array<float>")
    hits = similarity.similarity_topk(
        vectors(spark, q, "q_id"), vectors(spark, c, "chunk_id").unionAll(none), k=k, min_score=min_score,
        strategy="grid", pivots=7, block_rows=4)
    plan = hits._jdf.queryExecution().toString()
    assert "CoGroups" not in plan and plan.count("Exchange hashpartitioning") <= 1
    got = sorted((r["q_id"], r["chunk_id"], r["score"]) for r in hits.collect())
    assert got == brute(q, c, k, min_score)


def test_search_stores_no_texts(spark, monkeypatch, tmp_path):
    """embeddings are computed once, into a table of what the search compares."""
    from newsloom.plans import inputs

    stored, settle = [], inputs.settle
    for module in (inputs, similarity):
        monkeypatch.setattr(module, "settle", lambda df: stored.append(settle(df)) or stored[-1], raising=False)
    data = [(i, f"word{i} and more of it. " * 60, "s") for i in range(8)]
    spark.createDataFrame(data, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    chunks = inputs.text_chunks(spark, str(tmp_path))
    q = chunks.select(F.col("chunk_id").alias("q_id"), "embedding")
    assert similarity.similarity_topk(q, chunks, k=1, payload=["url"], strategy="grid").count() == chunks.count() == 16
    assert sorted(df.columns for df in stored) == [["chunk_id", "url", "embedding"], ["q_id", "_vec", "_row"]]


def test_rounds_of_a_large_search():
    """hits and chunks read again do not rise as questions times chunks over a fixed block."""
    assert similarity._round_counts(600_000, 256, 4096, 24) == (19, 2)
    assert similarity._round_counts(600_000, 16_384, 4096, 24)[0] == 147  # 64 MB a block


def test_all_hits_of_a_block_are_handed_out_in_parts():
    import pyarrow as pa

    m = np.random.default_rng(2).normal(size=(2500, 4)).astype(np.float32)
    best = similarity._BestHits(m[:600], None, -1, "chunk_id", pivots=16)
    parts = [best.drain().num_rows for _ in best.steps(pa.table({"chunk_id": range(2500)}), m)]
    assert sum(parts) == 600 * 2500 and len(parts) > 1 and best.drain() is None


@pytest.mark.parametrize("shape", [(3, 8), (5, 7), (1, 1), (0, 4), (64, 2048), (9, 2045)])
@pytest.mark.parametrize("share", [0, 0.001, 0.3, 1])
def test_true_cells(shape, share):
    able = np.random.default_rng(1).random(shape) < share
    rows_, columns = similarity._true_cells(able)
    assert [rows_.tolist(), columns.tolist()] == [x.tolist() for x in np.nonzero(able)]


@pytest.mark.parametrize("k", [4, None])
def test_kernel_over_cells_copies_and_odd_vectors(k):
    import pyarrow as pa

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(5, 6))
    c = (centres[rng.integers(0, 5, 9000)] + 0.02 * rng.normal(size=(9000, 6))).astype(np.float32)
    c[::7] = c[3]
    c[11], c[12, 2], c[13, 1] = 0, np.nan, np.inf
    q = np.vstack([c[:20], centres.astype(np.float32), np.full((1, 6), np.nan, np.float32)])
    ids = rng.permutation(9000)
    for min_score in (None, 0.999):
        if k is None and min_score is None:
            continue
        best = similarity._BestHits(q, k, min_score, "chunk_id", pivots=16)
        best.scan(pa.table({"chunk_id": ids[:6000]}), c[:6000])
        best.scan(pa.table({"chunk_id": ids[6000:]}), c[6000:])
        found = best.drain()
        got = sorted(zip(found["_q"].to_pylist(), found["chunk_id"].to_pylist(), found["score"].to_pylist()))
        by_id = np.argsort(ids)
        assert got == brute(q, c[by_id], k, min_score)


# --- retrieval -------------------------------------------------------------------------------


def hit_table(spark, data):
    schema = ("q_id bigint, chunk_id string, url string, date string, published_at timestamp, "
              "score double, rank int, hours int")
    return spark.createDataFrame(data, schema)


def ago(hours):
    return AS_OF - dt.timedelta(hours=hours)


def test_every_exit_of_the_recency_rules(spark):
    hits = hit_table(spark, [
        # 1: no window -> five best
        *[(1, f"a{i}", f"u{i}", None, ago(999), 0.9 - i / 100, i + 1, None) for i in range(7)],
        # 2: some inside -> only those, newest first, on the edge included
        (2, "b1", "u1", "d1", ago(13), 0.9, 1, 12), (2, "b2", "u2", "d2", ago(12), 0.8, 2, 12),
        (2, "b3", "u3", "d3", ago(1), 0.7, 3, 12), (2, "b4", "u4", None, None, 0.6, 4, 12),
        # 3: dated but none inside -> the newest with a warning
        (3, "c1", "u1", "d1", ago(50), 0.9, 1, 12), (3, "c2", "u2", None, ago(20), 0.8, 2, 12),
        (3, "c3", "u3", None, None, 0.7, 3, 12),
        # 4: nothing dated -> the best by score
        *[(4, f"e{i}", f"u{i}", None, None, 0.9 - i / 100, i + 1, 12) for i in range(6)],
        # 5: more than five inside, equal dates go by score
        *[(5, f"f{i}", f"u{i}", None, ago(2), 0.9 - i / 100, i + 1, 12) for i in range(6)],
    ])
    got = retrieval.select_hits(hits, F.lit(AS_OF))
    by_q = {}
    for r in sorted(got.collect(), key=lambda r: (r["q_id"], r["rank"])):
        by_q.setdefault(r["q_id"], []).append(r)
    assert [r["chunk_id"] for r in by_q[1]] == ["a0", "a1", "a2", "a3", "a4"]
    assert [r["chunk_id"] for r in by_q[2]] == ["b3", "b2"]
    assert [(r["chunk_id"], r["recency_warning"]) for r in by_q[3]] == [
        ("c2", "Không có tin trong 12 giờ qua. Tin gần nhất: N/A")]
    assert [r["chunk_id"] for r in by_q[4]] == ["e0", "e1", "e2", "e3", "e4"]
    assert [r["chunk_id"] for r in by_q[5]] == ["f0", "f1", "f2", "f3", "f4"]
    assert [r["rank"] for r in by_q[5]] == [1, 2, 3, 4, 5]
    assert all(r["recency_warning"] is None for q in (1, 2, 4, 5) for r in by_q[q])


def test_dedup_by_url_keeps_best_and_urlless(spark):
    hits = hit_table(spark, [
        (1, "a", "u", None, None, 0.9, 1, None), (1, "b", "u", None, None, 0.8, 2, None),
        (1, "c", None, None, None, 0.7, 3, None), (1, "d", "", None, None, 0.6, 4, None),
        (2, "b", "u", None, None, 0.9, 1, None),
    ])
    assert rows(retrieval.dedup_by_url(hits, ["rank"]), "q_id", "chunk_id") == [
        (1, "a"), (1, "c"), (1, "d"), (2, "b")]


def test_threshold_and_recency_status(spark):
    q = spark.createDataFrame(
        [(i, [1.0, 0.0], 12) for i in (1, 2, 3)] + [(4, [0.0, -1.0], 12)],
        "q_id bigint, embedding array<float>, hours int")
    chunks = spark.createDataFrame(
        [("x", "u", "d", ago(5), [1.0, 0.1]), ("y", "v", "d", ago(50), [0.0, 1.0])],
        "chunk_id string, url string, date string, published_at timestamp, embedding array<float>")
    hits = retrieval.retrieve(q, chunks, as_of=AS_OF)
    assert rows(hits, "q_id", "chunk_id", "rank") == [(i, "x", 1) for i in (1, 2, 3)]
    old = retrieval.recency_status(q, hits, F.lit(AS_OF + dt.timedelta(hours=10)))
    assert rows(old, "q_id", "docs_found_count", "recency_status") == [
        (1, 1, "OLD"), (2, 1, "OLD"), (3, 1, "OLD"), (4, 0, "NOT_FOUND")]
    new = retrieval.recency_status(q.where("q_id = 1"), hits, F.lit(AS_OF))
    assert rows(new, "recency_status") == [("RECENT",)]


def test_distance_mode_filters_after_top_k(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0], None)], "q_id bigint, embedding array<float>, hours int")
    chunks = spark.createDataFrame(
        [("near", "a", None, None, [1.0, 0.0]), ("mid", "b", None, None, [0.4, 0.9165151]),
         ("far", "c", None, None, [-1.0, 0.0])],
        "chunk_id string, url string, date string, published_at timestamp, embedding array<float>")
    got = retrieval.retrieve(q, chunks, k=2, as_of=AS_OF, score_mode="distance")
    assert rows(got, "chunk_id", "score") == [("mid", 0.6)]
    with pytest.raises(ValueError):
        retrieval.retrieve(q, chunks, score_mode="other")


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_text_joins_either_way(spark, broadcast_rows):
    hits = spark.createDataFrame([(i, "hot" if i % 3 else f"c{i}") for i in range(60)],
                                 "q_id bigint, chunk_id string")
    chunks = hits.select("chunk_id").distinct().withColumn("text", F.upper("chunk_id"))
    got = retrieval.with_text(hits, chunks, "text", broadcast_rows=broadcast_rows)
    assert rows(got, "q_id", "text") == sorted(
        ((i, "HOT" if i % 3 else f"C{i}") for i in range(60)), key=repr)


# --- skew ------------------------------------------------------------------------------------


@pytest.mark.parametrize("how, limit", [("inner", 0), ("left", 0), ("left", 100)])
def test_salted_join_equals_join(spark, how, limit):
    left = spark.createDataFrame(
        [(i, None if i % 10 == 0 else "hot" if i % 3 else f"k{i % 7}") for i in range(300)],
        "id bigint, k string")
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3), ("unused", 4)], "k string, v int")
    plain = rows(left.join(right, "k", how), "id", "k", "v")
    assert rows(skew.salted_join(left, right, ["k"], salt_by=["id"], how=how), "id", "k", "v") == plain
    salted = skew.salted_join(
        left, right, ["k"], salt_by=["id"], how=how, min_rows=50, broadcast_rows=limit)
    assert rows(salted, "id", "k", "v") == plain
    hot = skew.hot_keys(left, ["k"], min_rows=50)
    assert rows(hot, "k", "_salts") == [("hot", 4)]
    assert skew.hot_keys(left, ["k"]) is None


def test_first_per_key_prunes_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").alias("seq"))
    first = skew.first_per_key(df, ["k"], ["seq"])
    assert rows(first, "k", "seq") == [(0, 0), (1, 1)]
    assert first._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2


# --- ingest ----------------------------------------------------------------------------------


def test_feed_items(spark):
    xml = """<?xml version="1.0"?><rss><channel>
      <item><title>t1</title><guid isPermaLink="false">123</guid><link>http://b/1</link></item>
      <item><title>t2</title><link>http://b/2</link></item>
      <item><guid>http://b/3</guid></item>
      <item><guid/><link>http://b/4</link></item>
      <item><guid> http://b/5</guid></item>
      <item><link>ftp://b/6</link></item></channel></rss>"""
    rdf = "<rdf><channel><title>c</title></channel><item><link>https://r/1</link></item></rdf>"
    docs = spark.createDataFrame(
        [("f", xml), ("r", rdf), ("bad", "<rss><chan"), ("none", None)], schemas.FEED_XML)
    assert rows(feeds.feed_items(docs), "feed_url", "pos", "url") == [
        ("f", 1, "http://b/2"), ("f", 2, "http://b/3"), ("r", 0, "https://r/1")]
    listed = spark.createDataFrame([("x",), ("",), (None,), (" ",)], schemas.FEEDS)
    assert rows(feeds.active_feeds(listed), "feed_url") == [("x",)]


def test_arrival_order_and_null_urls(spark):
    batch = spark.createDataFrame(
        [("u1", 1), ("u2", 2), ("u1", 3), (None, 4), (None, 5)], "url string, seq bigint")
    stored = spark.createDataFrame([("u2",), ("u2",)], "url string")
    assert rows(ingest.new_articles(batch, stored), "url", "seq") == [("u1", 1), (None, 4)]
    with_null = stored.union(spark.createDataFrame([(None,)], "url string"))
    assert rows(ingest.new_articles(batch, with_null), "url", "seq") == [("u1", 1)]
    counts = ingest.merge_counts(stored, ingest.new_articles(batch, stored)).first()
    assert (counts["new_count"], counts["total"]) == (2, 4)


def test_ingest_stats_counts_repeats_and_failures(spark):
    items = spark.createDataFrame(
        [("f", "a"), ("f", "a"), ("f", "b"), ("f", "gone"), ("g", "a"), ("h", "b")],
        "feed_url string, url string")
    pages = spark.createDataFrame([("a", "text"), ("b", None)], "url string, content string")
    assert rows(ingest.ingest_stats(items, pages), "feed_url", "succeeded", "failed") == [
        ("f", 2, 2), ("g", 1, 0), ("h", 0, 1)]


def test_json_articles(spark, tmp_path):
    def read(name, body):
        (tmp_path / name).write_text(body, encoding="utf-8")
        return rows(article_source.read_articles_json(spark, str(tmp_path / name)), "url", "content")

    good = '[{"title": "t", "date": "d", "content": "nội\\ndung", "url": "u"}, {"url": "v"}]'
    assert read("good.json", good) == [("u", "nội\ndung"), ("v", None)]
    for name, body in (("cut", good[:-9]), ("object", '{"title": 1}'), ("scalar", "3"), ("empty", "")):
        assert read(name, body) == []
    assert rows(article_source.read_articles_json(spark, str(tmp_path / "missing")), "url") == []
    texts = spark.createDataFrame(
        [(1, good), (2, good[:-9]), (3, '{"url": "x"}'), (4, "3"), (5, None)], "id int, j string")
    assert rows(article_source.parse_articles_json(texts, "j", "id"), "id", "pos", "url") == [
        (1, 0, "u"), (1, 1, "v")]


def test_newest_first_and_page_files(spark, tmp_path):
    data = [("a", "t", "1/1/2024, 10:00", "c", 1), ("b", "t", "bad", "c", 2),
            ("c", "t", "2/1/2024, 10:00", "c", 3), ("d", "t", "1/1/2024, 10:00", "c", 4)]
    table = spark.createDataFrame(data, schemas.ARTICLES)
    assert [r["url"] for r in article_source.newest_first(table).collect()] == ["c", "a", "d", "b"]
    article_source.write_articles(table, str(tmp_path / "out"), "json")
    assert spark.read.json(str(tmp_path / "out")).count() == 4
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.html").write_text("<title>x</title>\nline", encoding="utf-8")
    assert rows(article_source.read_page_files(spark, str(tmp_path / "p")), "html") == [
        ("<title>x</title>\nline",)]


def test_chunks_of_articles(spark):
    table = spark.createDataFrame(
        [("u", "t", "1/2/2024, 10:00 (GMT+7)", "x" * 2000, 1), ("v", "t", "", "", 2),
         ("w", "t", None, None, 3), ("z", "t", None, "short", 4)], schemas.ARTICLES)
    chunks = ingest.chunk_articles(ingest.clean_articles(table))
    assert rows(chunks, "url", "chunk_index", "total_chunks", F.length("text")) == [
        ("u", 0, 3, 800), ("u", 1, 3, 800), ("u", 2, 3, 700), ("z", 0, 1, 5)]
    assert chunks.schema.names == schemas.CHUNKS.names
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2  # NFC and the splitter, once each
    assert "Exchange" not in plan


# --- merges ----------------------------------------------------------------------------------


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "chunk_id string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "chunk_id string, v int")
    once = upsert.upsert(old, new)
    want = [("a", 1), ("b", 2), ("c", 2)]
    assert rows(once, "chunk_id", "v") == want
    assert rows(upsert.upsert(once, new), "chunk_id", "v") == want


def test_latest_per_group(spark):
    df = spark.createDataFrame(
        [("u", 0, 0), ("u", 1, 0), ("u", 0, 1), ("v", 5, 0), (None, 7, 0), ("", 8, 1)],
        "url string, i int, batch_id bigint")
    assert rows(upsert.latest_per_group(df, "url", "i"), "url", "i", "batch_id") == sorted(
        [("u", 0, 1), ("v", 5, 0), (None, 7, 0), ("", 8, 1)], key=repr)


# --- lookup and routing ----------------------------------------------------------------------


def test_kb_lookup(spark):
    kb = spark.createDataFrame([
        ("en", "Ronaldo", "http://en/r", "One. Two.", None, 1),
        ("en", "World Cup", "http://en/w", "Cup.", None, 1),
        ("vi", "Đội bóng", "http://vi/d", "Hai.", None, 1),
        ("en", "Đội bóng", "http://en/d", "English.", None, 1),
        ("en", "Lịch sử", "http://en/l", "History.", None, 1),
        ("en", "Mercury", None, None, "World cup", 2), ("en", "Mercury", None, None, "Ronaldo", 1),
        ("en", "Ghost", None, None, "missing page", 1),
    ], schemas.KB)
    q = spark.createDataFrame([
        (1, " ronaldo "), (2, "đội  bóng"), (3, "lịch sử"), (4, "MERCURY"), (5, "nothing"),
        (6, "ghost"), (7, "Ronaldo")], schemas.QUESTIONS)
    foot = "\n\n📖 Source: "
    assert rows(lookup.kb_lookup(q, kb), "q_id", "lang", "wiki_content") == [
        (1, "en", f"One. Two.{foot}http://en/r"), (2, "vi", f"Hai.{foot}http://vi/d"),
        (3, "en", f"History.{foot}http://en/l"), (4, "en", "One. Two."),
        (7, "en", f"One. Two.{foot}http://en/r")]


SEARCHED = [
    ("en", "The World Cup", "http://en/w", "Cup.", None, 3),
    ("en", "World Cup Final", "http://en/f", "Final.", None, 4),
    ("en", "Cup, the world", "http://en/z", "Later.", None, 9),
    ("en", "Ronaldo", "http://en/r", "One. Two.", None, 1),
    ("vi", "Đội bóng", "http://vi/d", "Hai.", None, 1),
    ("en", "El Fenomeno", None, None, "Ronaldo", 2),
    ("en", "!!", "http://en/x", "No word.", None, 1),
]


def test_title_search(spark):
    kb = spark.createDataFrame(SEARCHED, schemas.KB)
    q = spark.createDataFrame([
        (1, "Who won the cup of the world?"), (2, "final, of: the WORLD cup"), (3, "đá bóng đội nào"),
        (4, "cup"), (5, None), (6, " ?! "), (7, "who won the cup OF the world?"), (8, "fenomeno: el"),
        (9, "x " * 20_000 + "ronaldo")], schemas.QUESTIONS)
    found = title_search.search_titles(q, kb)
    assert rows(found, "q_id", "lang", "title", "alias_of", "matched") == [
        (1, "en", "The World Cup", None, 3), (2, "en", "The World Cup", None, 3), (3, "vi", "Đội bóng", None, 2),
        (7, "en", "The World Cup", None, 3), (8, "en", "El Fenomeno", "Ronaldo", 2), (9, "en", "Ronaldo", None, 1)]
    some = rows(title_search.search_titles(q, kb, cover_percent=60), "q_id", "title", "matched")
    assert (2, "The World Cup", 3) in some and (1, "The World Cup", 3) in some and len(some) == 6
    assert title_search.search_titles(q, kb.where("false")).count() == 0
    assert title_search.search_titles(q.where("false"), kb).count() == 0
    with pytest.raises(ValueError):
        title_search.search_titles(q, kb, cover_percent=0)


@pytest.mark.parametrize("cover, most", [(100, 128), (75, 600)])
def test_title_search_writes_few_candidates(spark, monkeypatch, cover, most):
    """titles that share a question's rare word but not the others are dropped before they are written."""
    written, settle = [], title_search.settle
    monkeypatch.setattr(title_search, "settle", lambda df: written.append(settle(df)) or written[-1])
    # 4000 titles of a rare word that one question has and three less rare ones that none has; one title of two
    # words for each question.
    words = [(f"rare{i % 64} a{i % 20} b{i % 21} c{i % 23}", f"u{i}") for i in range(4000)]
    words += [(f"only rare{i}", f"own{i}") for i in range(64)]
    kb = spark.createDataFrame([("en", t, u, "text", None, i) for i, (t, u) in enumerate(words)], schemas.KB)
    q = spark.createDataFrame([(i, f"is there only rare{i}") for i in range(64)], schemas.QUESTIONS)
    got = rows(title_search.search_titles(q, kb, cover_percent=cover), "q_id", "url", "matched")
    assert got == sorted(((i, f"own{i}", 2) for i in range(64)), key=repr)
    candidates = [df.count() for df in written if {"search", "entry"} <= set(df.columns)]
    assert len(candidates) == 1 and candidates[0] <= most


def test_title_search_against_all_pairs(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    kb = [("en", " ".join(rnd.sample(words, rnd.randint(1, 5))), f"u{i}", "t", None, i) for i in range(80)]
    asked = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 8)))) for i in range(120)]
    for cover in (100, 70, 50):
        best = {}
        for i, text in asked:
            said = set(text.split())
            hits = [(-len(said & set(t.split())), pos, u, t) for _, t, u, _, _, pos in kb
                    if 100 * len(said & set(t.split())) >= cover * len(set(t.split()))]
            firsts = {}  # titles of the same words are one, under the first
            for h in sorted(hits, key=lambda h: h[1]):
                firsts.setdefault(frozenset(h[3].split()), h)
            if firsts:
                best[i] = min(firsts.values())[3]
        got = title_search.search_titles(
            spark.createDataFrame(asked, schemas.QUESTIONS), spark.createDataFrame(kb, schemas.KB), cover_percent=cover)
        assert {r["q_id"]: r["title"] for r in got.collect()} == best


def test_kb_lookup_with_search(spark):
    kb = spark.createDataFrame(SEARCHED, schemas.KB)
    q = spark.createDataFrame([
        (1, "who is ronaldo"), (2, "RONALDO"), (3, "el fenomeno, who?"), (4, "đội bóng world the cup"), (5, "none")],
        schemas.QUESTIONS)
    foot = "\n\n📖 Source: "
    assert rows(lookup.kb_lookup(q, kb, search=True), "q_id", "lang", "wiki_content") == [
        (1, "en", f"One. Two.{foot}http://en/r"), (2, "en", f"One. Two.{foot}http://en/r"), (3, "en", "One. Two."),
        (4, "vi", f"Hai.{foot}http://vi/d")]
    assert rows(lookup.kb_lookup(q, kb), "q_id") == [(2,)]


def test_routing(spark):
    q = spark.createDataFrame([(1, "  hi "), (2, " "), (3, None)], schemas.QUESTIONS)
    state = routing.init_state(q).collect()
    assert [(r["q_id"], r["question"], r["hours"]) for r in state] == [(1, "hi", 12)]
    cases = spark.createDataFrame(
        [("off_topic", "w", 3), ("sports_wiki", "w", 0), ("sports_news", None, 2),
         ("sports_news", "", 0)], "t string, w string, n int")
    got = cases.select(
        routing.answer_source(F.col("t"), F.col("w"), F.col("n")).alias("a"),
        routing.route_after_classify(F.col("t")).alias("r")).collect()
    assert [r["a"] for r in got] == ["decline", "lookup", "documents", "none"]
    assert [r["r"] for r in got] == [
        "generate_answer", "wikipedia_search", "retrieve_initial", "retrieve_initial"]
    status = spark.createDataFrame([("RECENT",), ("OLD",), ("NOT_FOUND",)], "s string")
    assert [r[0] for r in status.select(routing.route_after_recency(F.col("s"))).collect()] == [
        "generate_answer", "generate_answer", "wikipedia_search"]


def test_context_is_ordered(spark):
    hits = spark.createDataFrame(
        [(1, 2, "B", "b"), (1, 1, "A", "a"), (2, 1, "C", "c")],
        "q_id bigint, rank int, title string, text string",
    ).withColumns({"url": F.lit("u"), "date": F.lit("d"),
                   "recency_warning": F.lit(None).cast("string")})
    got = dict(rows(context.render_context(hits), "q_id", "context"))
    assert got[1].split("\n\n")[0].startswith("[1] Nguồn: A\n    URL: u\n    Ngày: d\n    Nội dung: a")
    assert [b[:3] for b in got[1].split("\n\n")] == ["[1]", "[2]"]


# --- history and log -------------------------------------------------------------------------


def test_history_of_turns_numbered_by_time(spark):
    """Blocks are cut by rows and not by turn numbers, for NULL keys too; no block is larger than asked."""
    data = [(c, 1_700_000_000_000 + i * 977_000, "user", f"{c}-{i}") for c in (1, None) for i in range(50)]
    turns = spark.createDataFrame(data, schemas.TURNS).repartition(5)
    got = history.running_history(turns, block=4).collect()
    assert sorted((str(r["conv_id"]), r["position"], r["text"]) for r in got) == sorted(
        (str(c), i + 1, f"{c}-{i}") for c in (1, None) for i in range(50))
    assert history.running_history(turns.where("false")).count() == 0


@pytest.mark.parametrize("block", [4, 100])
def test_history_over_block_borders_and_gaps(spark, block):
    rnd = random.Random(3)
    data = [(c, t, "user", f"{c}-{t}") for c in (1, 2, 3)
            for t in sorted(rnd.sample(range(200), 60 if c == 1 else 9))]
    turns = spark.createDataFrame(data, schemas.TURNS).repartition(4)
    got = {(r["conv_id"], r["turn"]): r for r in
           history.history_last_n(turns, 3, block=block).collect()}
    sizes = {(r["conv_id"], r["turn"]): r for r in
             history.running_history(turns, block=block).collect()}
    for conv in (1, 2, 3):
        said = sorted(t for c, t, *_ in data if c == conv)
        for i, t in enumerate(said):
            before = [f"{conv}-{x}" for x in said[max(0, i - 3):i]]
            assert [m["text"] for m in got[(conv, t)]["history"]] == before
            assert sizes[(conv, t)]["position"] == i + 1
            assert sizes[(conv, t)]["history_chars"] == sum(len(f"{conv}-{x}") for x in said[:i + 1])
    assert len(got) == len(sizes) == len(data)
    with pytest.raises(ValueError):
        history.history_last_n(turns, block + 1, block=block)


def test_answer_log_round_trip(spark, tmp_path):
    answers = spark.createDataFrame(
        [("q?", 1.23456, "OLD", 0, [], 2, "đáp")],
        "question string, elapsed_seconds double, recency_status string, crawl_count int, "
        "crawl_history array<string>, docs_found_count int, final_answer string")
    path = str(tmp_path / "log")
    for _ in range(2):
        answer_log.append_log(answer_log.log_records(answers, F.lit(AS_OF)), path)
    got = answer_log.read_log(spark, path).collect()
    assert len(got) == 2 and got[0]["elapsed_seconds"] == 1.235
    assert [(m["role"], m["text"]) for m in got[0]["messages"]] == [("human", "q?"), ("ai", "đáp")]


@pytest.mark.parametrize("broadcast_rows", [0, 100])
def test_resolve_versions(spark, broadcast_rows):
    df = spark.createDataFrame(
        [("a", 0, "x"), ("a", 2, "z"), ("a", 1, "y"), ("b", 0, "b"), (None, 0, "n"), (None, 1, "m")],
        "k string, batch_id bigint, v string")
    got = upsert.resolve_versions(df, "k", broadcast_rows=broadcast_rows)
    assert rows(got, "k", "v") == sorted([("a", "z"), ("b", "b"), (None, "m")], key=repr)
    unique = df.where("k = 'b'")
    assert upsert.resolve_versions(unique, "k") is unique


@pytest.mark.parametrize("broadcast_rows", [0, 100])
def test_only_keys(spark, broadcast_rows):
    big = spark.createDataFrame([(i, i % 3) for i in range(30)], "id bigint, k bigint")
    wanted = spark.createDataFrame([(1,), (1,), (9,)], "k bigint")
    got = skew.only_keys(big, wanted, ["k"], broadcast_rows=broadcast_rows)
    assert rows(got, "id") == sorted(((i,) for i in range(30) if i % 3 == 1), key=repr)


def test_upsert_with_repeated_and_missing_keys(spark):
    old = spark.createDataFrame([("a", 1), (None, 2), (None, 2)], "k string, v int")
    new = spark.createDataFrame([("a", 3), ("a", 4), ("b", 5), ("b", 6), (None, 7)], "k string, v int")
    want = None
    for parts in (1, 3, 7):
        for limit in (0, 100):
            got = sorted(map(str, upsert.upsert(old, new.repartition(parts), "k", limit).collect()))
            assert len(got) == 5 and sum("None" in r for r in got) == 3
            want = want or got
            assert got == want


def test_a_batch_is_replaced_by_no_rows(spark, tmp_path):
    from pyspark.sql import types as T

    from newsloom.sources.store import BatchStore

    schema = T.StructType([T.StructField("k", T.StringType())])
    store = BatchStore(spark, str(tmp_path / "s"), schema, "k")
    rows = spark.createDataFrame([("a",), ("b",)], schema)
    assert store.append(rows, 1) == 2 and store.append(rows, 2) == 2
    assert store.append(rows.where("false"), 1) == 0
    assert store.versions().where("batch_id = 1").count() == 0 and store.versions().count() == 2
