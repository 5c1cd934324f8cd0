"""Explicit schemas of every table the package reads or writes."""

from pyspark.sql import types as T

STRING, INT, BIGINT = T.StringType(), T.IntegerType(), T.LongType()
DOUBLE, TIMESTAMP = T.DoubleType(), T.TimestampType()


def _table(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


MESSAGES = T.ArrayType(_table(role=STRING, text=STRING))

FEEDS = _table(feed_url=STRING)
FEED_XML = _table(feed_url=STRING, xml=STRING)
FEED_ITEMS = _table(feed_url=STRING, pos=INT, title=STRING, guid=STRING, link=STRING, url=STRING)
PAGES = _table(page_id=BIGINT, url=STRING, html=STRING)
ARTICLE_RECORD = _table(title=STRING, date=STRING, content=STRING, url=STRING)
ARTICLES = _table(url=STRING, title=STRING, date=STRING, content=STRING, seq=BIGINT)
CHUNKS = _table(
    chunk_id=STRING, url=STRING, title=STRING, date=STRING, published_at=TIMESTAMP,
    chunk_index=INT, total_chunks=INT, text=STRING,
)
EMBEDDED_CHUNKS = T.StructType(
    [*CHUNKS.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]
)
QUESTIONS = _table(q_id=BIGINT, question=STRING)
KB = _table(lang=STRING, title=STRING, url=STRING, text=STRING, alias_of=STRING, pos=INT)
TURNS = _table(conv_id=BIGINT, turn=BIGINT, role=STRING, text=STRING)
TURNS_WITH_HISTORY = T.StructType([*TURNS.fields, T.StructField("history", MESSAGES)])
ANSWER_LOG = _table(
    ts=TIMESTAMP, question=STRING, elapsed_seconds=DOUBLE, recency_status=STRING,
    crawl_count=INT, crawl_history=T.ArrayType(STRING), docs_found_count=INT,
    final_answer=STRING, messages=MESSAGES,
)
COMMITS = _table(batch=BIGINT)
