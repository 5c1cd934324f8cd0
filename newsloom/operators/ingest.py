"""From feed items and pages to new, clean, chunked articles."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import chunking, html, ids, text
from newsloom.functions.dates import parse_utc
from newsloom.operators.skew import first_per_key, only_keys, salted_join


def extract_pages(pages: DataFrame) -> DataFrame:
    """``url, title, date, content, seq`` of each page; ``content`` is NULL when nothing usable
    was found, which is what counts as a failed page. Pages arrive in the order of their ids."""
    content = html.main_text(F.col("html"))
    return pages.select(
        "url",
        F.col("page_id").alias("seq"),
        html.title(F.col("html")).alias("title"),
        html.date_text(F.col("html")).alias("date"),
        F.when(~text.is_blank(content), content).alias("content"),
    )


def drop_blank(rows: DataFrame, column: str = "content") -> DataFrame:
    return rows.where(~text.is_blank(F.col(column)))


def _with_url_key(rows: DataFrame) -> DataFrame:
    """Two never-NULL columns that stand for the url, so that NULL urls group and join like any
    other and one partitioning serves both."""
    return rows.withColumns({
        "_no_url": F.col("url").isNull(), "_url": F.coalesce("url", F.lit(""))
    })


def first_articles(articles: DataFrame) -> DataFrame:
    """The first article of each url in arrival order (``seq``); NULL urls are one url."""
    return first_per_key(articles, ["url"], ["seq"])


def new_articles(articles: DataFrame, existing: DataFrame) -> DataFrame:
    """Articles whose url is not stored yet, first arrival per url; NULL equals NULL.

    Stored urls are first reduced to those the batch mentions, then made distinct, so neither
    side of the anti-join repeats a key and its cost follows the batch. Picking the first arrival
    and the anti-join share one shuffle of the articles."""
    keys = ["_no_url", "_url"]
    arrived = _with_url_key(articles)
    known = only_keys(_with_url_key(existing.select("url")), arrived, keys).select(*keys).distinct()
    fresh = first_per_key(arrived, keys, ["seq"]).join(known, keys, "left_anti")
    return fresh.select(*articles.columns)


def clean_articles(articles: DataFrame, *, byline: bool = True) -> DataFrame:
    """Cleaned content; articles whose raw content is blank are skipped."""
    return drop_blank(articles).withColumn("content", text.clean(F.col("content"), byline=byline))


def chunk_articles(articles: DataFrame, splitter: Column | None = None) -> DataFrame:
    """One row per chunk with its article's metadata, position, count and id. ``splitter`` is an
    array-of-text column over ``content``; the recursive splitter is the default. Empty articles
    have no pieces; a filter on the content would only make Spark clean it twice."""
    pieces = chunking.chunk_recursive(F.col("content")) if splitter is None else splitter
    return (
        articles.select("url", "title", "date", pieces.alias("pieces"))
        # Dates and counts are settled per article, so that exploding copies only short columns.
        .select(
            "url", "title", "date", "pieces",
            parse_utc(F.col("date")).alias("published_at"),
            F.size("pieces").alias("total_chunks"),
        )
        .select(
            "url", "title", "date", "published_at", "total_chunks",
            # The outer form keeps Spark from computing the pieces once more as a scan filter.
            F.posexplode_outer("pieces").alias("chunk_index", "text"),
        )
        .where(F.col("text").isNotNull())
        .select(
            ids.chunk_id(F.col("url"), F.col("chunk_index"), F.col("text")).alias("chunk_id"),
            "url", "title", "date", "published_at", "chunk_index", "total_chunks", "text",
        )
    )


def ingest_stats(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Succeeded and failed items per feed. ``pages`` has one row per url and a ``content``
    column; an item fails when its page is missing or has no content. Items are counted per feed
    and url before the join, and a link that very many feeds share is spread by feed."""
    wanted = items.groupBy("feed_url", "url").agg(F.count("*").alias("n"))
    usable = pages.select("url", F.col("content").isNotNull().alias("ok"))
    ok = F.coalesce("ok", F.lit(False))
    return (
        salted_join(wanted, usable, ["url"], salt_by=["feed_url"], how="left")
        .groupBy("feed_url")
        .agg(
            F.sum(F.when(ok, F.col("n")).otherwise(0)).alias("succeeded"),
            F.sum(F.when(ok, 0).otherwise(F.col("n"))).alias("failed"),
        )
    )


def feed_rollup(rows: DataFrame, feed: str = "feed_url") -> DataFrame:
    """Rows per feed and, under a NULL feed, over all feeds."""
    return rows.rollup(feed).agg(F.count("*").alias("inserted"))


def merge_counts(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """One row: how many articles a merge adds and how many it leaves."""
    both = existing.select(F.lit(0).alias("new")).unionAll(fresh.select(F.lit(1).alias("new")))
    return both.agg(
        F.coalesce(F.sum("new"), F.lit(0)).alias("new_count"), F.count("*").alias("total")
    )
