"""Recovery of a stream of blobs: micro-batches, each scanned on its own.

Strictly, nothing is carried from chunk to chunk, so a member that runs over a
cut is two spans; the state that would carry a tail is not kept. A blob that
comes whole gives what the batch scan gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from ..operators.signatures import ScanOptions, signatures
from ..sources.blobs import CHUNK_MB, chunks

BLOBS = "blob_id long, content binary"


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Blobs from Parquet files (blob_id, content) as they arrive below path."""
    return spark.readStream.schema(BLOBS).parquet(path)


def scanned(stream: DataFrame, options: ScanOptions = ScanOptions(), chunk_mb: float = CHUNK_MB) -> DataFrame:
    """The signatures of a stream of blobs, offsets counted from each chunk's start. A map, so it needs no watermark."""
    return signatures(chunks(stream, chunk_mb), options)


def written(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer of a streaming table as Parquet, exactly once by its checkpoint, ending when what is there is done."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True)
