"""From raw documents to a training mixture, in five stages.

Each stage is (spark, docs, sf_dir) -> DataFrame and gets what the stage before it kept, reread from
Parquet. All but the last return the columns of ``documents``; the last one says how many words of
each document the mixture takes.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.llm import decontaminate, jaccard, mixing, pii, quality
from newsloom.llm.common import table
from newsloom.scratch import settle

NEAR_WORDS, NEAR_PERCENT = 5, 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; those without words go."""
    # The row travels as a whole, so that no column of its own is taken for one of the verdict's.
    rows = docs.select(F.struct("*").alias("row"), "text", "lang")
    return quality.assess(rows).where("kept").select("row.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies. Rows of one doc_id count
    as one document, of which one row stays; a document without doc_id is kept, as nothing can
    refer to it."""
    found = jaccard.similar(docs, NEAR_WORDS, NEAR_PERCENT)
    heads = found.where("doc_id = component_id").select("doc_id").distinct()
    nth = F.row_number().over(
        Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), F.xxhash64("source")))
    kept = docs.join(heads, "doc_id", "left_semi").select(docs["*"], nth.alias("_nth_of_doc"))
    return kept.where("_nth_of_doc = 1").select(docs.columns).union(docs.where("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind."""
    return docs.withColumn("text", pii.masked(F.col("text"))).withColumn(
        "n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target and the words taken, for every document."""
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("pii", mask_pii),
    ("mixing", mix_sources),
]

# Masking and the seeded order of the mixture are not expressible in SQL; tests hold the pipeline
# against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
