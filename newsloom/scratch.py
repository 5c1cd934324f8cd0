"""Where intermediate tables live, and how a plan's lineage is cut."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir`` or the context's checkpoint folder.
    Where neither is set, a local folder, but only if all work runs on this machine, as in tests."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    checkpoints = spark.sparkContext._jsc.sc().getCheckpointDir()
    if checkpoints.isDefined():
        return checkpoints.get().rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _local
    if _local is None:
        _local = tempfile.mkdtemp(prefix="newsloom-")
    return _local


def new_dir(spark: SparkSession, name: str) -> str:
    """A path nobody else uses, below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into a table in the shared folder and read that from then on, even
    after executors are lost. Later uses prune columns and know the table's size."""
    path = new_dir(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
