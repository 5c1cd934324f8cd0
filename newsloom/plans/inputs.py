"""The package's entities derived from the driver's tables, whole tables each time."""

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import html
from newsloom.functions.chunking import chunk_fixed
from newsloom.functions.embedding import embed
from newsloom.functions.questions import detect_language
from newsloom.operators.ingest import chunk_articles
from newsloom.scratch import settle
from newsloom.sources.tables import read_table

AS_OF = "2024-01-31 00:00:00"
# Keyword rules for the invented languages of the driver's text.
RULES = (
    ("off_topic", r"(?i)(^|[^\p{L}])(der|die|und)([^\p{L}]|$)"),
    ("sports_wiki", r"(?i)(^|[^\p{L}])(que|les|le)([^\p{L}]|$)"),
)
PHRASES = (" tháng này", " tuần này", " hôm nay", " trong 3 giờ", " last 36h", "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def stamp(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an article; the dates include days, hours and zones that do not parse."""
    n = F.col("doc_id")
    zone = (
        F.when(n % 4 == 0, " (GMT+7)").when(n % 4 == 1, " (GMT-3)").when(n % 4 == 2, "")
        .otherwise(" (GMT+5:30)")
    )
    date = F.concat(
        F.lit("Thứ Hai, "), (1 + n % 31).cast("string"), F.lit("/"), (1 + n % 12).cast("string"),
        F.lit("/2024, "), (n % 25).cast("string"), F.lit(":"),
        F.lpad((n % 60).cast("string"), 2, "0"), zone,
    )
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("https://"), "source", F.lit(".example.com/"), n.cast("string")).alias("url"),
        F.concat(F.lit("Doc "), n.cast("string")).alias("title"),
        date.alias("date"),
        F.col("text").alias("content"),
        n.alias("seq"),
    )


def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_articles(articles(spark, sf_dir), chunk_fixed(F.col("content")))


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those chunks with embeddings. The search stores what it compares, without the texts."""
    return fixed_chunks(spark, sf_dir).withColumn("embedding", embed(F.col("text")))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn as a question, with a time phrase added."""
    turns = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    phrase = F.element_at(
        F.array(*[F.lit(p) for p in PHRASES]),
        ((F.col("conv_id") + F.col("turn")) % len(PHRASES) + 1).cast("int"),
    )
    return turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("q_id"),
        F.concat("text", phrase).alias("question"),
    )


def kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as an encyclopedia page under its title, and under an ambiguous name."""
    pages = table(spark, sf_dir, "pages").select(
        "page_id", "url",
        html.title(F.col("html")).alias("title"),
        html.main_text(F.col("html")).alias("text"),
    )
    # French pages are filed as English, so their titles are found by falling back.
    lang = F.when(F.col("url").contains("/fr/"), "en").otherwise(detect_language(F.col("title")))
    page = pages.select(
        lang.alias("lang"), "title", "url", "text",
        F.lit(None).cast("string").alias("alias_of"), F.col("page_id").cast("int").alias("pos"),
    )
    alias = page.select(
        "lang", F.concat(F.lit("About "), "title").alias("title"),
        F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("text"),
        F.col("title").alias("alias_of"), "pos",
    )
    return settle(page.unionByName(alias))


def kb_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn, every page title and every ambiguous name as a question."""
    titles = table(spark, sf_dir, "pages").select(
        "page_id", html.title(F.col("html")).alias("title")
    )
    asked = questions(spark, sf_dir)
    direct = titles.select(
        (-2 * F.col("page_id") - 1).alias("q_id"),
        F.translate("title", ascii_lowercase, ascii_uppercase).alias("question"),
    )
    ambiguous = titles.select(
        (-2 * F.col("page_id") - 2).alias("q_id"),
        F.concat(F.lit(" about  "), "title").alias("question"),
    )
    return settle(asked.unionByName(direct).unionByName(ambiguous))


def search_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn, and every page title with its words in reverse inside a question."""
    titles = table(spark, sf_dir, "pages").select("page_id", html.title(F.col("html")).alias("title"))
    turned = F.array_join(F.reverse(F.split("title", " ")), " ")
    inside = titles.select(
        (-F.col("page_id") - 1).alias("q_id"),
        F.concat(F.lit("Who knows, "), turned, F.lit("? Tell me, please")).alias("question"))
    return settle(questions(spark, sf_dir).unionByName(inside))


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a chunk; some without url, some undated."""
    v = F.col("vec_id")
    published = F.when(
        v % 7 != 0,
        F.lit("2024-01-01 00:00:00").cast("timestamp")
        + F.make_dt_interval(hours=((v * 37) % 720).cast("int")),
    )
    return table(spark, sf_dir, "embeddings").select(
        v.alias("chunk_id"),
        F.when(v % 11 != 0, F.concat(F.lit("u"), (v % 100).cast("string"))).alias("url"),
        F.concat(F.lit("Item "), v.cast("string")).alias("title"),
        stamp(published).alias("date"),
        published.alias("published_at"),
        F.concat(F.lit("label "), F.col("label").cast("string")).alias("text"),
        "embedding",
    )


def vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a question, with windows of different length and none."""
    v = F.col("vec_id") % 5
    hours = F.when(v == 1, 12).when(v == 2, 168).when(v == 3, 720).when(v == 4, 2)
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("q_id"), "embedding", hours.cast("int").alias("hours")
    )


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feed document per page, linking to it in usable and unusable ways."""
    pages = table(spark, sf_dir, "pages")

    def esc(c: Column) -> Column:
        return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))

    url = esc(F.col("url"))
    item_title = F.concat(F.lit("<title>"), esc(html.title(F.col("html"))), F.lit("</title>"))
    xml = F.concat(
        F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>Feed</title>'),
        F.lit("<item>"), item_title, F.lit('<guid isPermaLink="false">'), url,
        F.lit("</guid><link>http://other.example.com/</link></item>"),
        F.lit("<item>"), item_title, F.lit("<guid>id-"), F.col("page_id").cast("string"),
        F.lit("</guid><link>"), url, F.lit("</link></item>"),
        F.lit("<item>"), item_title, F.lit("<link>"), url, F.lit("</link></item>"),
        F.lit("<item>"), item_title, F.lit("<guid/><link>"), url, F.lit("</link></item>"),
        F.lit("<item><link>"), url, F.lit("missing</link></item></channel></rss>"),
    )
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    return pages.select(F.concat(F.lit("feed:"), host).alias("feed_url"), xml.alias("xml"))
