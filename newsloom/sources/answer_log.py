"""The log of answered questions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import schemas


def log_records(answers: DataFrame, as_of: Column) -> DataFrame:
    """One record per answered question. ``messages`` are the messages the turn adds, question
    and answer; earlier ones are in the records and turns before it and are not repeated."""

    def message(role: str, text: str) -> Column:
        return F.struct(F.lit(role).alias("role"), F.col(text).alias("text"))

    return answers.select(
        as_of.alias("ts"),
        "question",
        F.round("elapsed_seconds", 3).alias("elapsed_seconds"),
        "recency_status",
        "crawl_count",
        "crawl_history",
        F.col("docs_found_count").cast("int").alias("docs_found_count"),
        "final_answer",
        F.array(message("human", "question"), message("ai", "final_answer")).alias("messages"),
    )


def append_log(records: DataFrame, path: str) -> None:
    """Append records as JSON lines."""
    records.select(*schemas.ANSWER_LOG.names).write.mode("append").json(path)


def read_log(spark, path: str) -> DataFrame:
    return spark.read.schema(schemas.ANSWER_LOG).json(path)
