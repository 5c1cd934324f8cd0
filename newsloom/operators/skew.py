"""Joins and per-key picks that hold when one key owns a large share of the rows."""

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.scratch import settle

MOST_SALTS = 65_536
HOT_ROWS = 100_000
BROADCAST_ROWS = 200_000


def first_per_key(
    df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]
) -> DataFrame:
    """The first row of each key in ``order``. Spark turns the row_number filter into a group
    limit on both sides of the shuffle, so a hot key sends one row per task. NULL is a key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def only_keys(
    big: DataFrame, wanted: DataFrame, keys: Sequence[str], *, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Rows of ``big`` whose keys occur in ``wanted``. Counts the wanted keys first: few are
    broadcast, so ``big`` is filtered where it is scanned and only what is left is shuffled
    later; many are joined by shuffle, where adaptive execution splits a hot key of ``big``."""
    distinct = wanted.select(*keys).distinct()
    if distinct.count() <= broadcast_rows:
        distinct = F.broadcast(distinct)
    return big.join(distinct, list(keys), "left_semi")


def hot_keys(df: DataFrame, keys: Sequence[str], *, min_rows: int = HOT_ROWS) -> DataFrame | None:
    """The keys with more than ``min_rows`` rows and in how many parts (``_salts``) their rows must be
    cut to hold no more than that each; None without any. There is at most one such key for
    every ``min_rows`` rows of the table. Counts are combined before the shuffle."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > min_rows)
    parts = F.least(F.ceil(F.col("_n") / min_rows), F.lit(MOST_SALTS)).cast("int")
    hot = settle(counts.select(*keys, parts.alias("_salts")))
    return None if hot.isEmpty() else hot


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    *,
    salt_by: Sequence[str],
    how: str = "inner",
    broadcast_rows: int = BROADCAST_ROWS,
    **hot_options,
) -> DataFrame:
    """Join a side that may have hot keys (``left``, an inner or left join) to a side with unique
    keys. Counts the left keys first: without hot ones it is a plain join. Otherwise rows of a
    hot key are cut in as many parts as its count asks for, by the hash of ``salt_by``, and the
    matching right rows are copied once per part. Rows with a NULL key match nothing and are spread too."""
    hot = hot_keys(left, keys, **hot_options)
    if hot is None:
        return left.join(right, list(keys), how)
    if hot.count() <= broadcast_rows:
        hot = F.broadcast(hot)
    no_key = reduce(or_, [F.col(k).isNull() for k in keys])
    spread = left.join(hot, list(keys), "left").withColumn("_salt", F.pmod(
        F.xxhash64(*salt_by), F.when(no_key, MOST_SALTS).otherwise(F.coalesce("_salts", F.lit(1)))
    ).cast("int"))
    copies = right.join(hot, list(keys), "left").withColumn("_salt", F.explode(
        F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
    joined = spread.drop("_salts").join(copies.drop("_salts"), [*keys, "_salt"], how)
    return joined.drop("_salt")
