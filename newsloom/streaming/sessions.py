"""Live session memory: each new turn sees the last messages of its conversation."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom import schemas
from newsloom.operators.history import history_last_n, running_totals
from newsloom.operators.skew import first_per_key, only_keys
from newsloom.operators.upsert import latest_per_group
from newsloom.scratch import settle
from newsloom.sources.store import BatchStore


class SessionMemory:
    """``seen`` holds every turn with its history, a later version of which replaces the earlier one;
    ``tails`` the last ``n`` turns of each conversation as of each batch that touched it.

    A batch whose turns all follow what is stored needs the tails only. A turn that comes late, after
    turns with higher numbers, changes the history of up to ``n`` stored ones: their places are found from the
    numbers alone, and only the turns around the late ones are read and written again."""

    def __init__(self, spark: SparkSession, root: str, n: int = 8):
        self.n = n
        self.seen = BatchStore(spark, f"{root}/seen", schemas.TURNS_WITH_HISTORY, "turn")
        self.tails = BatchStore(spark, f"{root}/tails", schemas.TURNS, "turn")

    def histories(self) -> DataFrame:
        """Every turn once, with its history as of the last batch."""
        return first_per_key(
            self.seen.versions(), ["conv_id", "turn"], [F.desc("batch_id")]).drop("batch_id")

    def take(self, turns: DataFrame, batch_id: int) -> None:
        """Add a batch of turns. The last ``n`` per conversation are picked by a row_number
        filter, which Spark applies before the shuffle as well, and the histories by blocks, so
        one long conversation does not end up in one task. A turn that is stored already is
        replaced by its new text. Batches must be taken in order; one that runs again replaces itself."""
        turns = settle(turns.select(*schemas.TURNS.names))
        tails = only_keys(self.tails.before(batch_id), turns, ["conv_id"])
        old = settle(latest_per_group(tails, "conv_id", "turn").drop("batch_id"))
        newest = old.groupBy("conv_id").agg(F.max("turn").alias("_newest"))
        late = settle(turns.join(newest, "conv_id").where("turn <= _newest").select("conv_id").distinct())
        no_late = late.isEmpty()
        on_time = turns if no_late else turns.join(late, "conv_id", "left_anti")
        new = on_time.withColumn("_new", F.lit(True))
        both = old.withColumn("_new", F.lit(False)).unionByName(new)
        written = history_last_n(both, self.n).where("_new")
        if not no_late:
            around = self._around(only_keys(turns, late, ["conv_id"]), late, batch_id)
            written = written.drop("_new").unionByName(
                history_last_n(around, self.n).where("_write").drop("_write"))
        self.seen.append(written, batch_id)
        # A tail takes the new text of a turn it holds.
        tail = old.join(turns.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti").unionByName(turns)
        last = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
        self.tails.append(tail.withColumn("_rn", F.row_number().over(last)).where(F.col("_rn") <= self.n), batch_id)

    def _around(self, turns: DataFrame, late: DataFrame, batch_id: int) -> DataFrame:
        """The new turns of conversations with late ones, and the stored turns up to ``n`` places before
        and after each; ``_write`` marks those whose history is to be written."""
        names = ["conv_id", "turn"]
        stored = only_keys(self.seen.before(batch_id), late, ["conv_id"])
        # Places come from the numbers alone; the same turn may be stored by several batches.
        numbers = stored.select(*names).distinct().join(turns.select(*names), names, "left_anti")
        placed = settle(running_totals(
            numbers.withColumn("_new", F.lit(False)).unionByName(
                turns.select(*names).withColumn("_new", F.lit(True))), {"_pos": F.lit(1)}))
        near = placed.where("_new").select("conv_id", F.explode(
            F.sequence(F.col("_pos") - self.n, F.col("_pos") + self.n)).alias("_pos"), F.col("_pos").alias("_of"))
        # A turn sees a new one if that stands no more than n places before it.
        write = near.groupBy("conv_id", "_pos").agg(F.min("_of").alias("_first")).select(
            "conv_id", "_pos", (F.col("_first") <= F.col("_pos")).alias("_write"))
        wanted = settle(placed.join(write, ["conv_id", "_pos"]).select(*names, "_new", "_write"))
        texts = first_per_key(only_keys(stored, wanted.where("NOT _new"), names), names, [F.desc("batch_id")])
        return texts.select(*schemas.TURNS.names).unionByName(turns).join(
            wanted.select(*names, "_write"), names)

    def start(self, turns: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
        writer = turns.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint)
        writer = (
            writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
        )
        return writer.start()
