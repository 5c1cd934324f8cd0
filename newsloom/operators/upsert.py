"""Keyed merges: newest version of a chunk, messages merged by id."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import is_blank
from newsloom.operators.skew import BROADCAST_ROWS, first_per_key, salted_join
from newsloom.scratch import settle


def latest_per_key(rows: DataFrame, key: str, version: str = "batch_id") -> DataFrame:
    """The row with the highest ``version`` of each key; of several, one that their values alone
    decide, however the rows are spread."""
    return first_per_key(rows, [key], [F.desc(version), F.xxhash64(*rows.columns)])


def resolve_versions(
    rows: DataFrame, key: str, version: str = "batch_id", broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """The row with the highest ``version`` of each key, for tables where few keys repeat. Which
    ones do is settled from the key column alone; only their rows are ranked, and when there are
    none the table is read as it lies."""
    repeated = settle(
        rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
        .select(F.col(key).alias("_repeated"))
    )
    n = repeated.count()
    if n == 0:
        return rows
    if n <= broadcast_rows:
        repeated = F.broadcast(repeated)
    same = F.col(key).eqNullSafe(F.col("_repeated"))
    single = rows.join(repeated, same, "left_anti")
    return single.unionByName(latest_per_key(rows.join(repeated, same, "left_semi"), key, version))


def latest_per_group(
    rows: DataFrame, group: str, row_id: str, version: str = "batch_id"
) -> DataFrame:
    """All rows of each group's newest version. Rows without group have no newer version to yield
    to. The newest versions come from a narrow aggregate, combined before the shuffle, and a
    group with very many rows is spread by ``row_id``."""
    has_group = ~is_blank(F.col(group).cast("string"))
    newest = rows.where(has_group).groupBy(group).agg(F.max(version).alias(version))
    kept = salted_join(rows.where(has_group), newest, [group, version], salt_by=[row_id])
    return kept.select(*rows.columns).unionByName(rows.where(~has_group))


def upsert(
    existing: DataFrame, new: DataFrame, key: str = "chunk_id", broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Existing rows replaced by new rows of the same key, other new rows added. Running it
    again with the same input changes nothing. Of new rows with one key, the values decide which
    stays. Rows without key are told apart from nothing, so all of them stay. New rows are computed
    once and only those of repeated keys are ranked. Only keys of ``new`` go to the existing rows:
    few are broadcast and the stored side is not shuffled."""
    new = settle(new)
    counted = settle(new.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_new_key")).agg(
        F.count("*").alias("_n")))

    def few(keys: DataFrame) -> DataFrame:
        return F.broadcast(keys) if keys.count() <= broadcast_rows else keys

    same = F.col(key) == F.col("_new_key")
    kept = existing.join(few(counted.select("_new_key")), same, "left_anti")
    repeated = counted.where("_n > 1").select("_new_key")
    if repeated.isEmpty():
        return kept.unionByName(new)
    repeated = few(repeated)
    first = first_per_key(new.join(repeated, same, "left_semi"), [key], [F.xxhash64(*new.columns)])
    return kept.unionByName(new.join(repeated, same, "left_anti")).unionByName(first)


def merge_messages(history: DataFrame, new: DataFrame, key: str = "message_id") -> DataFrame:
    """Append messages to a history; a message whose id is there already replaces the old one;
    messages without id are all kept."""
    return upsert(history, new, key)
