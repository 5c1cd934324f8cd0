"""A keyed table kept as an append-only Parquet directory with one partition per batch.

An ingest run writes only its own batch, so its cost follows the new data, and running a batch
again replaces that batch instead of adding to it. Readers resolve rows that several batches
share; ``compact`` writes the resolved table elsewhere when the overlap has grown.
"""

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.operators.upsert import latest_per_group, resolve_versions
from newsloom.sources.tables import path_exists


class BatchStore:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str):
        self.spark = spark
        self.path = path
        self.schema = schema
        self.key = key

    def append(self, rows: DataFrame, batch_id: int) -> int:
        """Write a batch and return its row count, counted during the write. What the batch held
        before is replaced, also by no rows."""
        seen = Observation()
        counted = rows.select(*self.schema.names).observe(seen, F.count(F.lit(1)).alias("n"))
        counted.write.mode("overwrite").parquet(f"{self.path}/batch_id={int(batch_id)}")
        return int(seen.get["n"])

    def versions(self) -> DataFrame:
        """Every stored row with its ``batch_id``; empty before the first write."""
        schema = T.StructType([*self.schema.fields, T.StructField("batch_id", T.LongType())])
        if not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def before(self, batch_id: int) -> DataFrame:
        """Rows of other batches only: what a repeated run of ``batch_id`` must compare with."""
        return self.versions().where(F.col("batch_id") != F.lit(int(batch_id)))

    def batch(self, batch_id: int) -> DataFrame:
        """Rows of one batch, read back from the table."""
        return self.versions().where(F.col("batch_id") == F.lit(int(batch_id))).drop("batch_id")

    def current(self, replace_by: str | None = None) -> DataFrame:
        """The newest row of each key. ``replace_by='url'`` also drops rows left over from an
        older, longer version of the same article."""
        rows = self.versions()
        if replace_by:
            rows = latest_per_group(rows, replace_by, self.key)
        return resolve_versions(rows, self.key).drop("batch_id")

    def compact(self, path: str) -> "BatchStore":
        """Write the current rows as the single batch 0 of a new store."""
        target = BatchStore(self.spark, path, self.schema, self.key)
        target.append(self.current(), 0)
        return target
