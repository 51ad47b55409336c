"""Incremental ingest: new documents become line windows and postings as they arrive.

The stream is stateless up to its sink; every micro-batch is written under its own id, so a batch that is repeated after a failure
replaces itself. Inverse document frequencies are global, so scores are computed when a query is asked, from the postings of
all batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verilume.operators.chunking import line_windows
from verilume.operators.retrieval import lengths, postings


def document_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def start_indexing(stream: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write the chunks, postings and document lengths of every micro-batch under `out`."""

    def index(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        line_windows(batch).write.mode("overwrite").parquet(f"{out}/chunks/batch={batch_id}")
        index = postings(batch)
        index.write.mode("overwrite").parquet(f"{out}/postings/batch={batch_id}")
        lengths(index).write.mode("overwrite").parquet(f"{out}/lengths/batch={batch_id}")
        batch.unpersist()

    writer = stream.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def progress(events: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts by event type and time window of a stream (or table) of events; later events than `late` are left out of a stream."""
    at = events.withWatermark("ts", late) if events.isStreaming else events
    return at.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
