"""The ingest run: feeds and pages to articles, articles to stored, embedded chunks."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.functions.embedding import PredictorFactory, embed
from newsloom.operators import ingest as ops
from newsloom.operators.skew import first_per_key, only_keys
from newsloom.sources.feeds import feed_items
from newsloom.sources.store import BatchStore


def articles_from_feeds(feed_xml: DataFrame, pages: DataFrame) -> DataFrame:
    """Articles of the pages that the feeds link to. A link many feeds repeat is one narrow row
    before it meets the pages, and a page landed several times is reduced to its first landing."""
    links = feed_items(feed_xml).select("url").distinct()
    landed = first_per_key(only_keys(pages, links, ["url"]), ["url"], ["page_id"])
    return ops.drop_blank(ops.extract_pages(landed))


@dataclass
class NewsTables:
    """The tables an ingest run maintains."""

    articles: BatchStore
    clean: BatchStore
    chunks: BatchStore
    commits: BatchStore

    @classmethod
    def at(cls, spark: SparkSession, root: str) -> "NewsTables":
        return cls(
            BatchStore(spark, f"{root}/articles", schemas.ARTICLES, "url"),
            BatchStore(spark, f"{root}/articles_clean", schemas.ARTICLES, "url"),
            BatchStore(spark, f"{root}/chunks", schemas.EMBEDDED_CHUNKS, "chunk_id"),
            BatchStore(spark, f"{root}/commits", schemas.COMMITS, "batch"),
        )

    def known(self, batch_id: int) -> DataFrame:
        """Articles of other batches that were stored to the end. What a failed batch left counts
        as unknown, so its articles are taken again, by itself or by a later batch."""
        done = self.commits.versions().select("batch_id").distinct()
        return self.articles.before(batch_id).join(done, "batch_id", "left_semi")


def ingest_batch(
    articles: DataFrame,
    tables: NewsTables,
    batch_id: int,
    *,
    splitter: Column | None = None,
    embedder: PredictorFactory | None = None,
    byline: bool = True,
    on_conflict: str = "keep",
) -> dict[str, int]:
    """Store one batch and return the row counts written. Only articles with unknown urls flow on
    (``on_conflict='latest'`` takes known ones again as a newer version). Each step reads the
    table the step before wrote, so nothing is computed twice and a lost executor costs one step.
    Running a batch again leaves the tables as they were. ``articles`` is read twice, so settle
    it when it is costly to compute."""
    if on_conflict not in ("keep", "latest"):
        raise ValueError(f"unknown conflict rule {on_conflict!r}")
    if on_conflict == "keep":
        fresh = ops.new_articles(articles, tables.known(batch_id))
    else:
        fresh = ops.first_articles(articles)
    n_articles = tables.articles.append(fresh, batch_id)
    clean = ops.clean_articles(tables.articles.batch(batch_id), byline=byline)
    n_clean = tables.clean.append(clean, batch_id)
    chunks = ops.chunk_articles(tables.clean.batch(batch_id), splitter)
    embedded = chunks.withColumn("embedding", embed(F.col("text"), embedder))
    n_chunks = tables.chunks.append(embedded, batch_id)
    # Written last: a batch without this mark is not known to later ones.
    spark = articles.sparkSession
    tables.commits.append(spark.createDataFrame([(int(batch_id),)], schemas.COMMITS), batch_id)
    return {"articles": n_articles, "clean": n_clean, "chunks": n_chunks}
