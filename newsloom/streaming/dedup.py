"""Dropping repeated keys of a stream: against a table of all keys, or with bounded state."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from newsloom.operators.skew import first_per_key
from newsloom.sources.store import BatchStore


def dedup_to_store(
    stream: DataFrame, keys: Sequence[str], order: Sequence[str], path: str, checkpoint: str
) -> StreamingQuery:
    """Keep the first row of each key that ever arrives, whatever its time, in the table at
    ``path`` (rows with their ``batch_id``). Each micro-batch is reduced to one row per key, the
    first in ``order``, and compared with the keys of the batches before it; a batch that runs again
    replaces itself. NULL is a key. Runs until all that is there now has been read."""
    spark, schema = stream.sparkSession, T.StructType(stream.schema.fields)
    store = BatchStore(spark, path, schema, keys[0])

    def keep_new(rows: DataFrame, batch_id: int) -> None:
        seen = store.before(batch_id).select(*(F.col(k).alias(f"_seen_{k}") for k in keys))
        same = [F.col(k).eqNullSafe(F.col(f"_seen_{k}")) for k in keys]
        condition = same[0]
        for s in same[1:]:
            condition = condition & s
        store.append(first_per_key(rows, keys, order).join(seen, condition, "left_anti"), batch_id)

    return stream.writeStream.foreachBatch(keep_new).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_stream(
    stream: DataFrame,
    keys: Sequence[str],
    time: str,
    *,
    delay: str = "7 days",
    salts: int = 16,
) -> DataFrame:
    """One row per key within ``delay`` of the first sighting, with state for that long only; rows
    later than that are lost (``dedup_to_store`` loses none). Repeats are first dropped per key
    and salt, so copies of one hot key are thinned in parallel before they meet. The salt is the
    number of the task that read the row: it differs between equal copies, and a task that runs
    again after a failure gives its rows the same one."""
    marked = stream.withWatermark(time, delay)
    if salts > 1:
        marked = (
            marked.withColumn("_salt", F.spark_partition_id() % salts)
            .dropDuplicatesWithinWatermark([*keys, "_salt"])
            .drop("_salt")
        )
    return marked.dropDuplicatesWithinWatermark(list(keys))
