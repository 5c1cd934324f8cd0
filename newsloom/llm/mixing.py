"""Mixing sources to target weights by capped water-filling, with seeded repetitions.

All sources together are to give as many words as the corpus holds, shared by weight. A source stops
at MAX_EPOCHS times its own size; what it cannot take is shared again among the others by weight,
until no target is above its cap. A source's target is then laid over its documents in a seeded
order, again and again: every document is taken whole as often as the target covers the source, and
the rest of the target is taken once more from the front of the order, cutting the one document at
its end, so that a source gives exactly its target, rounded.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.llm.common import words
from newsloom.scratch import settle

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
SEED = 20
# A source's documents lie in so many slices of the seeded order; running totals are taken within a
# slice and over the slices' sums, so no task gets a whole source.
SLICE_BITS = 12


def _ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank``, from 0 in code-point order of the source, NULL last: range
    partitions are numbered in place and shifted by the counts of those before."""
    parts = sources.repartitionByRange(
        F.col("source").isNull().asc(), F.col("source").asc()
    ).sortWithinPartitions(F.col("source").isNull().asc(), F.col("source").asc())
    ids = settle(parts.withColumn("id", F.monotonically_increasing_id()))
    part, pos = F.shiftright("id", 33), F.col("id").bitwiseAND((1 << 33) - 1)
    counts = ids.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # As many rows as the sort had partitions.
    return ids.withColumn("part", part).join(F.broadcast(before), "part").select(
        *sources.columns, (F.col("before") + pos).alias("rank"))


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS, weights=WEIGHTS) -> DataFrame:
    """``sources`` (source, source_size) with ``weight`` and ``target``. The rounds run on sums of
    the sources only; each caps every source whose share is above its cap."""
    turn = F.col("rank") % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))
    ranked = settle(_ranked(sources).withColumn("weight", weight.cast("long")))
    cap = F.col("source_size") * max_epochs
    total, level = ranked.agg(F.sum("source_size")).first()[0] or 0, 0.0
    while True:
        capped = cap.cast("double") < F.lit(level) * F.col("weight")
        open_weight, closed = ranked.agg(
            F.sum(F.when(~capped, F.col("weight"))), F.sum(F.when(capped, cap))).first()
        raised = (total - (closed or 0)) / open_weight if open_weight else level
        if raised <= level:
            break
        level = raised
    target = F.when(capped, cap.cast("double")).otherwise(
        F.least(F.lit(level) * F.col("weight"), cap.cast("double")))
    return ranked.withColumn("target", target)


def mix(docs: DataFrame, max_epochs: int = MAX_EPOCHS, weights=WEIGHTS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, text): doc_id, source, size (words), source_size,
    target (its source's) and taken (words the mix takes of it, repeats counted; at most max_epochs
    times its size).

    A NULL or empty text has size 0 and is taken 0 times; NULL is a source of its own, the last in
    order. Rows with the same doc_id are taken one by one; where they also have the same size and
    source, which of them is cut is not defined, but their sum is. Sources without words have
    target 0. No rows give no rows. Other columns are ignored.
    """
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    sized = settle(docs.select(
        "doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"),
    ).withColumns({"_order": order, "_slice": F.shiftright(order, 64 - SLICE_BITS)}))
    # A constant stands for a missing source, and a flag tells it from that text.
    keys = {"_missing": F.col("source").isNull(), "_source": F.coalesce("source", F.lit(""))}
    slices = settle(sized.groupBy("source", "_slice").agg(F.sum("size").alias("slice_size")))
    sources = slices.groupBy("source").agg(F.sum("slice_size").alias("source_size"))
    filled = water_fill(sources, max_epochs, weights).withColumns(keys).drop("source", "rank", "weight")
    placed = slices.withColumns(keys).withColumn("before", F.coalesce(F.sum("slice_size").over(
        Window.partitionBy("_missing", "_source").orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = settle(placed.join(filled, ["_missing", "_source"]).drop("source", "slice_size"))
    rows = sized.withColumns(keys).join(placed, ["_missing", "_source", "_slice"])
    within = F.sum("size").over(
        Window.partitionBy("_missing", "_source", "_slice").orderBy("_order", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    start = F.col("before") + within - F.col("size")
    aim = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("cast(round(target) AS bigint) div source_size")).otherwise(0)
    left = aim - whole * F.col("source_size") - start
    return rows.withColumn(
        "taken", whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    ).select("doc_id", "source", "size", "source_size", "target", F.col("taken").cast("long"))
