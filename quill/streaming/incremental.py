"""Incremental ingest: documents that arrive are chunked and appended, each chunk once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.config import RetrievalConfig
from quill.functions.tokens import TokenCounter, WhitespaceCounter
from quill.operators.chunking import chunk_papers, one_section
from quill.operators.store import CHUNK_KEY, insert_ignore
from quill.plans.ingest import with_identity
from quill.sources import tables


def chunk_texts(docs: DataFrame, config: RetrievalConfig, counter: Callable[[], TokenCounter] = WhitespaceCounter) -> DataFrame:
    """Chunks of docs (paper_id, title, text), each text one section, Body."""
    return with_identity(chunk_papers(one_section(docs), config.chunk_tokens, config.chunk_overlap_pct, config.contextual_headers, config.embedding_model, counter), config)


def ingest_stream(stream: DataFrame, path: str, checkpoint: str, config: RetrievalConfig, counter: Callable[[], TokenCounter] = WhitespaceCounter, horizon: str | None = None):
    """Start a query that appends the chunks of a stream of docs to the Parquet table at path.

    A batch is one folder of the table, named by its number and moved there whole, so a batch that
    runs again adds nothing; chunks that earlier batches brought are left out. Without horizon the
    table is asked for them: of it only this chunking's keys are read, and of those only the batch's papers'.
    With horizon (as '30 days') the query keeps the keys of chunks as state, dealt by key and restored
    from its checkpoint, until they have not been seen for the horizon; the table is not read at all, and a
    chunk that comes again later than that is appended again.
    """
    if horizon is not None:
        seen = chunk_texts(stream, config, counter).withColumn("_seen", F.current_timestamp()).withWatermark("_seen", horizon)
        fresh = seen.dropDuplicatesWithinWatermark(list(CHUNK_KEY)).drop("_seen")

        def append(batch: DataFrame, number: int) -> None:
            tables.append_batch(batch, path, str(number))

        return fresh.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if tables.exists(spark, f"{path}/batch={number}"):
            return
        new = chunk_texts(batch, config, counter)
        if tables.exists(spark, path):
            stored = spark.read.parquet(path).where(F.col("chunk_config_sha256") == config.chunking_sha256()).select(*CHUNK_KEY)
            new = insert_ignore(stored.join(batch.select("paper_id").distinct(), "paper_id", "left_semi"), new, CHUNK_KEY)
        else:
            new = insert_ignore(new.limit(0), new, CHUNK_KEY)
        tables.append_batch(new, path, str(number))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
