"""The operators as queries over the given tables, with the digests that are checked."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import (
    centroids,
    decontaminate,
    divergence,
    htmltext,
    jaccard,
    licenses,
    mixing,
    pii,
    quality,
    substrings,
    tokens,
    toxicity,
    warc,
)
from newsloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_rules(spark, d):
    return quality.assess(table(spark, d, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "char_distance", "word_distance")


@query
def op2_html_text(spark, d):
    return htmltext.extract(table(spark, d, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op3_find_pii(spark, d):
    return pii.find_pii(table(spark, d, "documents")).select(
        "doc_id", *pii.COUNTS, "n_spans", "base_sha256", "spans")


@query
def op4_decontaminate(spark, d):
    return decontaminate.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query
def op5_mix_sources(spark, d):
    return mixing.mix(table(spark, d, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


@query
def op6_license_scan(spark, d):
    return licenses.scan_licenses(table(spark, d, "documents"), licenses.TEMPLATES + licenses.RIGHTS)


@query
def op7_warc(spark, d):
    return warc.archive(table(spark, d, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op8_toxicity(spark, d):
    return toxicity.toxicity(table(spark, d, "documents"), table(spark, d, "labels")).select(
        "doc_id", "held_out", "score", "predicted")


@query
def op9_token_counts(spark, d):
    return tokens.count_tokens(table(spark, d, "documents")).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op10_jaccard_join(spark, d):
    return jaccard.similar(table(spark, d, "documents"), size=3, percent=90)


@query
def op11_substring_dedup(spark, d):
    return substrings.remove_repeats(table(spark, d, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op12_centroid_clusters(spark, d):
    return centroids.cluster(table(spark, d, "embeddings"))


@query
def op13_source_divergence(spark, d):
    return divergence.divergences(table(spark, d, "documents"))
