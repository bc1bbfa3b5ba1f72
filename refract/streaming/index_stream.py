"""Micro-batch adapter for the vector-index upsert.

The reference has no streaming; its only state is the vector index, which
each run upserts into.  :func:`start_index_upsert` applies the batch upsert
(:func:`refract.operators.index.upsert`) to every micro-batch of a
Structured Streaming source with ``foreachBatch``: micro-batch ``e`` reads
index version ``e`` and writes version ``e + 1`` next to it.  Versions are
keyed by the epoch id, so a replayed epoch after a failure rewrites the same
version (idempotent), and the version being read is never overwritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from refract.operators import bucketed_index as B
from refract.operators import index as X
from refract.operators.index import version_path


def upsert_batch(batch: DataFrame, epoch_id: int, base: str) -> None:
    spark = batch.sparkSession
    existing = None
    if epoch_id > 0:
        # Epoch e - 1 wrote this version.  The explicit schema reads an empty
        # version (written by an empty batch) as no rows; any other failure
        # fails the epoch, which is replayed, instead of silently starting
        # the index over from this batch alone.
        existing = spark.read.schema(batch.schema).parquet(version_path(base, epoch_id))
    merged = X.upsert(existing, batch)
    (merged.write.mode("overwrite").partitionBy("index_name", "namespace")
     .parquet(version_path(base, epoch_id + 1)))


def start_index_upsert(records: DataFrame, base: str, checkpoint: str,
                       available_now: bool = True) -> StreamingQuery:
    """Run the upsert over a streaming DataFrame of index records
    (``index_name, namespace, id, embedding, metadata, batch_ord``)."""
    w = (records.writeStream
         .foreachBatch(lambda df, e: upsert_batch(df, e, base))
         .option("checkpointLocation", checkpoint))
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def upsert_bucketed(batch: DataFrame, epoch_id: int, base: str) -> None:
    """Micro-batch ``e`` makes version ``e + 1`` of a bucketed index: it writes
    its own rows and a manifest.  A replayed epoch writes the same two again."""
    ix = B.open_index(batch.sparkSession, base, batch.schema, epoch_id)
    B.upsert(ix, batch, version=epoch_id + 1)


def start_bucketed_upsert(records: DataFrame, base: str, checkpoint: str,
                          available_now: bool = True) -> StreamingQuery:
    """:func:`start_index_upsert` into a bucketed index
    (:mod:`refract.operators.bucketed_index`)."""
    w = (records.writeStream
         .foreachBatch(lambda df, e: upsert_bucketed(df, e, base))
         .option("checkpointLocation", checkpoint))
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def latest_version(base: str, query: StreamingQuery) -> str:
    """Path of the newest version written by ``query``."""
    last = query.lastProgress
    epoch = last["batchId"] if last else 0
    return version_path(base, epoch + 1)
