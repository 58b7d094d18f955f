"""Postings of files that arrive as a stream (appends; deletions need a snapshot, see ``operators.incremental``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.tokens import tokenize
from ..operators import chunking
from ..plans.ship import ship


def stream_postings(files: DataFrame, target: str, checkpoint: str, size: int = chunking.MAX_CHUNK_SIZE) -> StreamingQuery:
    """Writes ``(file_path, chunk_in_file, term, tf)`` of each micro-batch of ``files (file_path, kind, text)``.

    A batch writes a folder of its own, named by its number, so a batch that
    is run again after a failure replaces what it wrote before: each file's
    postings are there exactly once. Runs over what is available, then stops.
    """

    ship(files.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        chunks = chunking.chunk_files(batch, size)
        tokens = F.concat(tokenize(F.col("text")), tokenize(F.col("file_path")))
        rows = chunks.select("file_path", "chunk_in_file", F.explode(tokens).alias("term"))
        rows = rows.groupBy("file_path", "chunk_in_file", "term").agg(F.count(F.lit(1)).alias("tf"))
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
