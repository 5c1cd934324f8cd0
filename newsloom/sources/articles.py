"""Reading and writing page and article tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom import schemas
from newsloom.functions.dates import parse_local
from newsloom.sources.tables import path_exists


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages from a Parquet table ``(page_id, url, html)``."""
    return spark.read.schema(schemas.PAGES).parquet(path)


def read_page_files(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages from one HTML file each: ``page_id`` is a hash of the file's path, ``url`` what
    the page names as its canonical address, else the path."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    link = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
    named = F.nullif(F.regexp_extract("value", link, 1), F.lit(""))
    file = F.col("_metadata.file_path")
    return files.select(
        F.xxhash64(file).alias("page_id"), F.coalesce(named, file).alias("url"),
        F.col("value").alias("html"))


def read_articles_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Articles from files that each hold one JSON array of records, or with ``lines`` one record a
    line, as ``write_articles`` writes them. A missing file, malformed
    text and a top level that is no array all give no rows."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schemas.ARTICLE_RECORD)
    if lines:
        return spark.read.schema(schemas.ARTICLE_RECORD).json(path)
    files = spark.read.text(path, wholetext=True)
    return parse_articles_json(files, "value").drop("pos")


def parse_articles_json(texts: DataFrame, column: str, *keep: str) -> DataFrame:
    """The same reading for whole texts held in a column, with each record's position."""
    array = F.from_json(column, T.ArrayType(schemas.ARTICLE_RECORD))
    is_array = F.col(column).rlike(r"^\s*\[")
    return (
        texts.where(is_array)
        .select(*keep, F.posexplode_outer(array).alias("pos", "a"))
        .where(F.coalesce("a.title", "a.date", "a.content", "a.url").isNotNull())
        .select(*keep, "pos", "a.*")
    )


def newest_first(articles: DataFrame) -> DataFrame:
    """Total order by the naive date, undated articles last, arrival order on ties. ``seq`` is
    part of the range key, so a date shared by many rows still spreads over partitions."""
    return articles.withColumn("local_ts", parse_local(F.col("date"))).orderBy(
        F.desc_nulls_last("local_ts"), "seq"
    )


def write_articles(articles: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a full, newest-first copy. ``path`` must be new or not be read by ``articles``. JSON has
    one record a line."""
    newest_first(articles).drop("local_ts").write.mode("overwrite").format(fmt).save(path)
