"""Token counts through a two-tier lookup on the map side.

A pre-token is a run of text from one space to the next. No piece of the vocabulary has a space mark
after another character, so no merge crosses the border between two pre-tokens and a text's count
is the sum of theirs. The counts of frequent pre-tokens are broadcast; the others are encoded
once per worker and kept in its cache. Nothing is shuffled.
"""

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "▁"
MODEL = "piece_bpe_32k.model"
# Spaces join the word after them; the model itself puts one before the text.
PRE_TOKEN = re.compile(r" *[^ ]+| +$")
# The first tier: so many entries at most, taken from so many documents (a bound on broadcast and
# sample; which entries it holds changes speed only).
TABLE_ENTRIES = 50_000
SAMPLE_DOCS = 2_000
# The second tier: so many entries in a worker, none longer than so many characters.
CACHE_ENTRIES = 200_000
CACHED_CHARS = 48


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def separable(path: str) -> bool:
    """Whether counts may be summed over pre-tokens: no piece joins a space to what stands before it,
    and the text reaches the pieces as it is."""
    p = _processor(path)
    pieces = (p.id_to_piece(i) for i in range(p.get_piece_size()))
    return all(MARK not in piece.lstrip(MARK) for piece in pieces) and "".join(
        p.encode("  a  b ", out_type=str)) == "▁▁▁a▁▁b▁"


class Counts(dict):
    """Token counts by pre-token; unknown ones are encoded and, when short, remembered."""

    def __init__(self, known: dict, path: str):
        super().__init__(known)
        self.tier_one, self.processor = len(known), _processor(path)

    def __missing__(self, pre_token: str) -> int:
        # The model puts a space before what it encodes, but not before nothing.
        n = len(self.processor.encode(pre_token[1:])) if len(pre_token) > 1 else 1
        if len(pre_token) <= CACHED_CHARS:
            if len(self) - self.tier_one >= CACHE_ENTRIES:
                for key in list(self)[self.tier_one:]:
                    del self[key]
            self[pre_token] = n
        return n

    def of(self, text: str) -> int:
        # The model writes spaces as the mark, so a mark in the text is a space too.
        return sum(map(self.__getitem__, PRE_TOKEN.findall(" " + text.replace(MARK, " ")))) if text else 0


def frequent(docs: DataFrame, path: str) -> dict:
    """Counts of the most frequent pre-tokens in a bounded sample of ``docs``."""
    rows = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(1, rows))
    seen: Counter = Counter()
    sample = docs.select(F.col("text")).where("text IS NOT NULL").sample(share, seed=9)
    for row in sample.limit(SAMPLE_DOCS).toLocalIterator():
        seen.update(x for x in PRE_TOKEN.findall(" " + row["text"]) if len(x) <= CACHED_CHARS)
    counts = Counts({}, path)
    return {x: counts[x] for x, _ in seen.most_common(TABLE_ENTRIES)}


_worker: dict = {}


def counter(spark: SparkSession, docs: DataFrame, path: str | None = None) -> Column:
    """A column expression for the number of tokens of ``text``; 0 for NULL and the empty text.
    ``path`` is the model's file, present on every machine."""
    path = path or model_path()
    if not separable(path):
        raise ValueError(f"{path}: counts of pre-tokens do not add up to those of texts")
    table = spark.sparkContext.broadcast(frequent(docs, path))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if (path, table) not in _worker:
            _worker.clear()
            _worker[path, table] = Counts(table.value, path)
        counts = _worker[path, table]
        for texts in batches:
            yield pd.Series([counts.of(t) if t else 0 for t in texts], dtype="int64")

    return count(F.col("text"))


def count_tokens(docs: DataFrame, limit: int = 4096, path: str | None = None) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (n_tokens > limit); columns
    of these names are replaced. NULL counts as the empty text. Row by row: repeated rows each get
    their counts, no rows give none."""
    return docs.withColumns({
        "n_bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"),
        "n_tokens": counter(docs.sparkSession, docs, path),
    }).withColumn("over_limit", F.col("n_tokens") > limit)
