import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.functions.chunking import chunk_fixed
from newsloom.functions.embedding import embed, generate
from newsloom.functions.rendering import NOT_FOUND_TEXT, NOTHING_FOUND_TEXT
from newsloom.plans.answer import answer_questions, retrieve_context
from newsloom.plans.ingest import NewsTables, articles_from_feeds, ingest_batch
from newsloom.scratch import new_dir, settle, shared_dir
from newsloom.sources.store import BatchStore
from newsloom.streaming.dedup import dedup_stream
from newsloom.streaming.ingest import ingest_stream
from newsloom.streaming.sessions import SessionMemory

ARTICLES = [
    ("u1", "One", "1/1/2024, 10:00", "alpha " * 200, 1),
    ("u2", "Two", "2/1/2024, 10:00", "beta gamma", 2),
    ("u1", "One again", "1/1/2024, 10:00", "other", 3),
    ("u3", "Blank", "", " \n ", 4),
]


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def words(factory_log=None):
    def factory():
        def predict(texts: np.ndarray) -> np.ndarray:
            vocabulary = ["alpha", "beta", "gamma"]
            return np.array([[t.count(w) for w in vocabulary] for t in texts], dtype=np.float32)
        return predict
    return factory


# --- ingest ----------------------------------------------------------------------------------


def snapshot(tables):
    return (rows(tables.articles.current(), "url", "title"), rows(tables.clean.current(), "url"),
            rows(tables.chunks.current(), "chunk_id", "text", "embedding"))


def test_ingest_twice_and_permuted(spark, tmp_path):
    batch = spark.createDataFrame(ARTICLES, schemas.ARTICLES)
    tables = NewsTables.at(spark, str(tmp_path / "a"))
    first = ingest_batch(batch, tables, 0, embedder=words())
    assert first == {"articles": 3, "clean": 2, "chunks": 3}
    before = snapshot(tables)
    assert before[0] == [("u1", "One"), ("u2", "Two"), ("u3", "Blank")]
    assert ingest_batch(batch, tables, 0, embedder=words()) == first  # the same batch again
    assert snapshot(tables) == before
    again = ingest_batch(batch, tables, 1, embedder=words())  # the same articles as a new batch
    assert again == {"articles": 0, "clean": 0, "chunks": 0}
    assert snapshot(tables) == before
    other = NewsTables.at(spark, str(tmp_path / "b"))
    ingest_batch(spark.createDataFrame(ARTICLES[::-1], schemas.ARTICLES), other, 0, embedder=words())
    assert snapshot(other) == before


def test_newer_versions_replace_and_compact(spark, tmp_path):
    tables = NewsTables.at(spark, str(tmp_path / "a"))
    long, short = [("u1", "t", "", "alpha " * 300, 1)], [("u1", "t", "", "beta", 1)]
    ingest_batch(spark.createDataFrame(long, schemas.ARTICLES), tables, 0)
    ingest_batch(spark.createDataFrame(short, schemas.ARTICLES), tables, 1, on_conflict="latest")
    assert len(rows(tables.chunks.current(), "text")) == 3  # leftovers stay by default
    assert rows(tables.chunks.current(replace_by="url"), "text") == [("beta",)]
    packed = tables.chunks.compact(str(tmp_path / "packed"))
    assert rows(packed.current(), "chunk_id") == rows(tables.chunks.current(), "chunk_id")
    with pytest.raises(ValueError):
        ingest_batch(tables.articles.current(), tables, 2, on_conflict="other")


def test_store_before_first_write(spark, tmp_path):
    store = BatchStore(spark, str(tmp_path / "none"), schemas.CHUNKS, "chunk_id")
    assert store.current().count() == 0
    assert store.append(store.current(), 0) == 0
    assert store.current().count() == 0


def test_articles_from_feeds(spark):
    xml = "<rss><channel>" + "".join(
        f"<item><link>http://a/{i}</link></item>" for i in (1, 1, 2, 9)) + "</channel></rss>"
    feed = spark.createDataFrame([("f", xml), ("g", xml)], schemas.FEED_XML)
    pages = spark.createDataFrame(
        [(3, "http://a/1", "<title>late</title><p>later</p>"),
         (1, "http://a/1", '<title>first</title><span class="date">1/1/2024</span><p>body</p>'),
         (2, "http://a/2", "<title>empty</title>"), (4, "http://a/4", "<p>not linked</p>")],
        schemas.PAGES)
    got = articles_from_feeds(feed, pages)
    assert rows(got, "url", "title", "date", "seq") == [("http://a/1", "first", "1/1/2024", 1)]


# --- hooks -----------------------------------------------------------------------------------


def test_injected_models(spark):
    df = spark.createDataFrame([(i, "alpha " * i) for i in range(40)] + [(99, None)], "i int, t string")
    got = dict(rows(df.select("i", embed(F.col("t"), words()).alias("e")), "i", "e"))
    assert got[7] == [7.0, 0.0, 0.0] and got[99] == [0.0, 0.0, 0.0]

    def echo():
        return lambda texts: np.array([f"{len(texts) <= 16}:{t.strip()[:5]}" for t in texts])

    said = {r[0] for r in df.select(generate(F.col("t"), echo)).collect()}
    assert said == {"True:alpha", "True:"}


# --- answers ---------------------------------------------------------------------------------


def test_answers_take_every_branch(spark):
    chunks = spark.createDataFrame(
        [("c1", "u1", "News", "d", dt.datetime(2024, 1, 30, 20), 0, 1, "alpha alpha"),
         ("c2", "u2", "Old", "d2", dt.datetime(2023, 1, 1), 0, 1, "beta")],
        schemas.CHUNKS).withColumn("embedding", embed(F.col("text"), words()))
    kb = spark.createDataFrame([("en", "Gamma", "http://w/g", "About gamma.", None, 1)], schemas.KB)
    q = spark.createDataFrame([
        (1, "alpha hôm nay"), (2, "beta hôm nay"), (3, "gamma"), (4, "wiki nothing"),
        (5, "pizza"), (6, "phở pizza"), (7, "   "), (8, "unknown words")], schemas.QUESTIONS)
    rules = [("off_topic", "pizza"), ("sports_wiki", "wiki")]
    got = {r["q_id"]: r for r in answer_questions(
        q, chunks, kb, as_of=dt.datetime(2024, 1, 31), rules=rules, embedder=words()).collect()}
    assert {i: (r["answer_source"], r["recency_status"], r["docs_found_count"])
            for i, r in got.items()} == {
        1: ("documents", "RECENT", 1), 2: ("documents", "OLD", 1), 3: ("lookup", "NOT_FOUND", 1),
        4: ("none", "NOT_FOUND", 0), 5: ("decline", "NOT_FOUND", 0),
        6: ("decline", "NOT_FOUND", 0), 8: ("none", "NOT_FOUND", 0)}
    assert "Nội dung: alpha alpha" in got[1]["final_answer"] and got[1]["hours"] == 24
    assert "Không có tin trong 24 giờ qua" in got[2]["context"] and "LƯU Ý" in got[2]["prompt"]
    assert got[3]["final_answer"] == "About gamma.\n\n📖 Source: http://w/g"
    assert got[4]["final_answer"] == NOTHING_FOUND_TEXT and got[4]["prompt"] is None
    assert got[5]["final_answer"].startswith("Sorry") and got[6]["final_answer"].startswith("Xin lỗi")

    asked = q.where("q_id in (1, 5)").select(
        "q_id", embed(F.col("question"), words()).alias("embedding"), F.lit(24).alias("hours"))
    told = dict(rows(retrieve_context(asked, chunks, as_of=dt.datetime(2024, 1, 31)), "q_id", "context"))
    assert told[1].startswith("[1] Nguồn: News") and told[5] == NOT_FOUND_TEXT

    def label():
        return lambda texts: np.array([" Off_Topic" if "alpha" in t else "?" for t in texts])

    def shout():
        return lambda texts: np.array([t.upper() for t in texts])

    modelled = {r["q_id"]: r for r in answer_questions(
        q, chunks, kb, as_of=dt.datetime(2024, 1, 31), classifier=label, embedder=words(),
        answerer=shout).collect()}
    assert modelled[1]["answer_source"] == "decline"
    assert modelled[2]["final_answer"] == modelled[2]["prompt"].upper()


# --- streams ---------------------------------------------------------------------------------


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    landing = str(tmp_path / "landing")
    splitter = chunk_fixed(F.col("content"))

    def land(data):
        spark.createDataFrame(data, schemas.ARTICLES).coalesce(1).write.mode("append").parquet(landing)

    def run(tables):
        stream = (spark.readStream.schema(schemas.ARTICLES).option("maxFilesPerTrigger", 1)
                  .parquet(landing))
        ingest_stream(stream, tables, str(tmp_path / "progress"), splitter=splitter).awaitTermination()

    live = NewsTables.at(spark, str(tmp_path / "live"))
    land(ARTICLES[:2])
    run(live)
    land(ARTICLES[2:])
    run(live)  # goes on where the first run stopped
    batch = NewsTables.at(spark, str(tmp_path / "batch"))
    ingest_batch(spark.createDataFrame(ARTICLES, schemas.ARTICLES), batch, 0, splitter=splitter)
    assert snapshot(live) == snapshot(batch)
    assert sorted(r[0] for r in live.articles.versions().select("batch_id").distinct().collect()) == [0, 1]


@pytest.mark.parametrize("salts", [1, 4])
def test_dedup_stream(spark, tmp_path, salts):
    data = [(i % 20 if i % 3 else 0, dt.datetime(2024, 1, 1, i % 24), i) for i in range(300)]
    schema = "k bigint, ts timestamp, v bigint"
    spark.createDataFrame(data, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = dedup_stream(stream, ["k"], "ts", salts=salts)
    run = (out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
           .trigger(availableNow=True).start(str(tmp_path / "out")))
    run.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.columns == ["k", "ts", "v"]
    assert sorted(r["k"] for r in got.collect()) == sorted({k for k, *_ in data})


def test_session_memory(spark, tmp_path):
    memory = SessionMemory(spark, str(tmp_path / "m"), n=3)
    said = [(1, t, "user", f"1-{t}") for t in range(7)] + [(2, t, "user", f"2-{t}") for t in (0, 5)]
    batches = [said[:2] + said[7:8], said[2:3], said[3:7] + said[8:]]
    for i, data in enumerate(batches):
        memory.take(spark.createDataFrame(data, schemas.TURNS), i)
    memory.take(spark.createDataFrame(batches[2], schemas.TURNS), 2)  # replayed
    got = {(r["conv_id"], r["turn"]): [m["text"] for m in r["history"]]
           for r in memory.seen.versions().collect()}
    assert len(got) == memory.seen.versions().count() == 9
    assert got[(1, 0)] == [] and got[(1, 2)] == ["1-0", "1-1"]
    assert got[(1, 6)] == ["1-3", "1-4", "1-5"] and got[(2, 5)] == ["2-0"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_session_memory_with_late_turns(spark, tmp_path, seed):
    """In whatever order turns arrive, every history ends as it is over the whole table."""
    from newsloom.operators.history import history_last_n

    rnd = random.Random(seed)
    said = [(c, t, "user", f"{c}-{t}") for c in (1, 2, 3) for t in range(12)]
    rnd.shuffle(said)
    said = [(1, t, "user", f"1-{t}") for t in (0, 1, 2, 4, 5, 6)] + [x for x in said if x[0] != 1 or x[1] not in range(7)] + [
        (1, 3, "user", "1-3")]
    memory = SessionMemory(spark, str(tmp_path / "m"), n=2)
    cuts = [0, 6, *sorted(rnd.sample(range(7, len(said) - 1), 3)), len(said) - 1, len(said)]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        memory.take(spark.createDataFrame(said[a:b], schemas.TURNS), i)
    memory.take(spark.createDataFrame(said[-1:], schemas.TURNS), len(cuts) - 2)  # replayed
    memory.take(spark.createDataFrame([(2, 5, "user", "again")], schemas.TURNS), 90)
    said = [x if x[:2] != (2, 5) else (2, 5, "user", "again") for x in said]
    whole = history_last_n(spark.createDataFrame(said, schemas.TURNS), 2)
    shape = lambda df: sorted((r["conv_id"], r["turn"], r["text"], [m["text"] for m in r["history"]]) for r in df.collect())
    assert shape(memory.histories()) == shape(whole)


def test_scratch_follows_the_cluster_setting(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_dir(spark) == configured.rstrip("/")
    assert new_dir(spark, "x") != new_dir(spark, "x")
    assert settle(spark.range(3)).count() == 3


def test_late_rows_are_kept(spark, tmp_path):
    from newsloom.streaming.dedup import dedup_to_store

    for i, rows in enumerate([[("a", "2024-06-01"), (None, "2024-06-01")], [("a", "2024-06-02"), ("b", "2020-01-01"), ("b", "2019-01-01")]]):
        spark.createDataFrame(rows, "k string, ts string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    dedup_to_store(stream, ["k"], ["ts"], str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("k", "ts").collect()
    assert sorted(map(tuple, got), key=str) == [("a", "2024-06-01"), ("b", "2019-01-01"), (None, "2024-06-01")]


def test_articles_of_a_failed_batch_are_taken_again(spark, tmp_path):


    tables = NewsTables.at(spark, str(tmp_path / "t"))
    articles = spark.createDataFrame([("u1", "t", "01/02/2024", "body " * 30, 1)], schemas.ARTICLES)
    failing = chunk_fixed(F.raise_error(F.lit("no splitter today")).cast("string"))
    with pytest.raises(Exception, match="no splitter today"):
        ingest_batch(articles, tables, 1, splitter=failing)
    assert ingest_batch(articles, tables, 2)["articles"] == 1
    assert ingest_batch(articles, tables, 3) == {"articles": 0, "clean": 0, "chunks": 0}
    assert tables.chunks.current().count() > 0


def test_landings_are_written_and_read_by_many_tasks(spark, tmp_path, monkeypatch):
    from newsloom.plans import registry

    spark.range(40).selectExpr(
        "id AS doc_id", "concat('text ', id) AS text", "'en' AS lang", "'src1' AS source", "6L AS n_chars"
    ).write.parquet(str(tmp_path / "d/documents.parquet"))
    spark.range(40).selectExpr(
        "id AS event_id", "timestamp_seconds(1700000000 + id)::timestamp_ntz AS ts", "id % 3 AS user_id",
        "'x' AS event_type", "1.0D AS value").write.parquet(str(tmp_path / "d/events.parquet"))
    spark.range(40).selectExpr(
        "id % 10 AS conv_id", "id div 10 + 1 AS turn", "'user' AS role", "concat('t', id) AS text"
    ).write.parquet(str(tmp_path / "d/conversations.parquet"))
    for name, rows in (("stream_ingest", 40), ("stream_dedup_late", 40), ("stream_sessions", 40)):
        monkeypatch.setattr(registry, "new_dir", lambda s, kind, name=name: str(tmp_path / name))
        assert registry.QUERIES[name](spark, str(tmp_path / "d")).count() == rows
        assert len(list((tmp_path / name / "landing").glob("part-*.parquet"))) > 4
        # One micro-batch for each landing.
        assert len(list((tmp_path / name / "progress/commits").glob("[0-9]*"))) == 2
