"""Reading Parquet tables."""

from pyspark.sql import DataFrame, SparkSession

# A table of at most this many scan splits is small enough to shuffle without a second thought.
SMALL_SPLITS = 32


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table, spread over idle cores when it is so small that its scan would use only a few.
    Larger tables are scanned as they lie, without a shuffle."""
    df = spark.read.parquet(path)
    cores = min(spark.sparkContext.defaultParallelism, SMALL_SPLITS)
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
