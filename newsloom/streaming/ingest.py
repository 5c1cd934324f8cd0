"""Incremental ingest: landed articles flow into the tables micro-batch by micro-batch."""

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from newsloom.plans.ingest import NewsTables, ingest_batch


def ingest_stream(
    articles: DataFrame,
    tables: NewsTables,
    checkpoint: str,
    *,
    every: str | None = None,
    **options,
) -> StreamingQuery:
    """Start ingesting a stream of articles. Without ``every`` the run takes what has landed and
    stops, which suits an external scheduler; ``every='1 hour'`` keeps it running. A micro-batch
    replayed after a failure rewrites its own partition, so each article is stored once."""

    def store(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, tables, batch_id, **options)

    writer = articles.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()
