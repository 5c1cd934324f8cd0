"""Message history per conversation.

One conversation may hold a large share of all turns, so nothing here orders a whole conversation
in one task. Turns are sorted by range over all tasks and cut into blocks of consecutive rows; block
totals are cut into blocks again, so that no window sees more than ``block`` rows of turns or of
totals, whatever the turn numbers are (running numbers or times). ``turn`` is unique within
its conversation.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.scratch import settle

BLOCK = 4096
# Rows of one sorted partition are numbered in the lower bits, partitions in the upper ones.
PARTITION_BITS = 33


def running_totals(
    turns: DataFrame,
    values: dict[str, Column],
    *,
    key: str = "conv_id",
    order: str = "turn",
    block: int = BLOCK,
) -> DataFrame:
    """Add, per name in ``values``, the sum of that column over the key's rows up to this one. A NULL
    key is a key like any other.

    A prefix sum in two levels: rows within blocks, blocks within groups of ``block`` blocks, and
    groups, of which a key with a billion rows has some sixty.
    """
    ordered = turns.repartitionByRange(F.col(key), F.col(order)).sortWithinPartitions(key, order)
    placed = settle(ordered.withColumns({
        "_at": F.monotonically_increasing_id(), **{f"_v_{n}": v for n, v in values.items()}}))
    part = F.shiftright("_at", PARTITION_BITS)
    row = F.col("_at") - F.shiftleft(part, PARTITION_BITS)
    # Blocks count on from partition to partition: so many a partition has at most, its last one shorter.
    most = placed.agg(F.max(row)).first()[0] or 0
    cut = placed.withColumn("_block", part * (most // block + 1) + F.floor(row / block)).drop("_at")
    # A constant stands for a missing key, and a flag tells the two apart.
    same = F.col(key).isNull()
    cut = cut.withColumns({"_no_key": same, "_key": F.coalesce(key, F.lit(0).cast(turns.schema[key].dataType))})
    totals = settle(cut.groupBy("_no_key", "_key", "_block").agg(
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values]
    ).withColumn("_group", F.floor(F.col("_block") / block)))
    up_to = (Window.unboundedPreceding, -1)
    groups = totals.groupBy("_no_key", "_key", "_group").agg(*[F.sum(f"_t_{n}").alias(f"_t_{n}") for n in values])
    over_groups = Window.partitionBy("_no_key", "_key").orderBy("_group").rowsBetween(*up_to)
    groups = groups.select("_no_key", "_key", "_group", *[
        F.coalesce(F.sum(f"_t_{n}").over(over_groups), F.lit(0)).alias(f"_g_{n}") for n in values])
    over_blocks = Window.partitionBy("_no_key", "_key", "_group").orderBy("_block").rowsBetween(*up_to)
    offsets = totals.join(groups, ["_no_key", "_key", "_group"]).select("_no_key", "_key", "_block", *[
        (F.col(f"_g_{n}") + F.coalesce(F.sum(f"_t_{n}").over(over_blocks), F.lit(0))).alias(f"_o_{n}")
        for n in values])
    within = (
        Window.partitionBy("_no_key", "_key", "_block").orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return cut.join(offsets, ["_no_key", "_key", "_block"]).select(
        *turns.columns,
        *[(F.col(f"_o_{n}") + F.sum(f"_v_{n}").over(within)).alias(n) for n in values],
    )


def running_history(turns: DataFrame, **kwargs) -> DataFrame:
    """Size of the history each turn sees, itself included: messages and characters so far.

    The history of turn ``t`` is the rows of its conversation with ``position <= t.position``;
    those rows exist once, so storage stays linear in the conversation's length.
    """
    totals = {"position": F.lit(1), "history_chars": F.length(F.col("text"))}
    return running_totals(turns, totals, **kwargs)


def history_last_n(
    turns: DataFrame, n: int, *, key: str = "conv_id", order: str = "turn", block: int = BLOCK
) -> DataFrame:
    """Add ``history``: the up to ``n`` messages before each turn as ``array<struct<role,text>>``.

    Rows are placed in blocks of consecutive positions; the last ``n`` of a block are also sent to
    the next one, so each block can answer for itself.
    """
    if not 0 < n <= block:
        raise ValueError("n must be between 1 and the block size")
    placed = running_totals(turns, {"_pos": F.lit(1)}, key=key, order=order, block=block)
    at = F.col("_pos") - 1
    home = F.floor(at / F.lit(block))
    edge = at % F.lit(block) >= block - n
    spread = placed.withColumn("_home", home).withColumn(
        "_part",
        F.explode(
            F.when(edge, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))
        ),
    )
    w = Window.partitionBy(key, "_part").orderBy("_pos").rowsBetween(-n, -1)
    history = F.collect_list(F.struct("role", "text")).over(w)
    return (
        spread.withColumn("history", history)
        .where(F.col("_part") == F.col("_home"))
        .select(*turns.columns, "history")
    )
