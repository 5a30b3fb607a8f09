"""Chunks that arrive as files are added to a replace session by a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quayside.operators.replace import TableReplacer
from quayside.sources.tabular import FILE, FILE_SEQ, ROW_NO


def stream_chunks(replacer: TableReplacer, session_id: str, folder: str, schema: T.StructType,
                  checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Append every micro-batch of ``folder`` as one chunk of the session.

    The batch number is the chunk number and a chunk replaces itself, so a batch that is replayed
    after a failure adds nothing.
    """
    def add(batch: DataFrame, batch_id: int) -> None:
        replacer.append_chunk(session_id, batch, chunk=batch_id + 1)

    stream = (replacer.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
              .parquet(folder))
    located = stream.select("*", F.col("_metadata.file_name").alias(FILE), F.lit(0).alias(FILE_SEQ),
                            (F.col("_metadata.row_index") + 1).alias(ROW_NO))
    return (located.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
