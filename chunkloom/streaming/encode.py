"""Late chunking of streams: every step up to the chunk rows is local to a document, so a stream needs no state and no watermark."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from chunkloom.api import LateChunker
from chunkloom.sources.tables import place


def read(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files at a path, a file or a folder, with the schema that they have now."""
    schema = spark.read.parquet(path).schema
    head, _, name = path.rstrip("/").rpartition("/")
    folder = os.path.isdir(path.removeprefix("file://"))
    return spark.readStream.schema(schema).parquet(path) if folder else spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(head)


def encode(stream: DataFrame, chunker: LateChunker, out: str, checkpoint: str, **how) -> StreamingQuery:
    """Appends the chunks of a stream of documents to Parquet files, each document exactly once."""
    return chunker.encode(stream, **how).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def encode_once(spark: SparkSession, path: str, chunker: LateChunker, **how) -> DataFrame:
    """Runs all that is there through the stream and returns the chunks."""
    at = place(spark, "stream")
    q = encode(read(spark, path), chunker, f"{at}/out", f"{at}/checkpoint", **how)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.schema(chunker.encode(spark.read.parquet(path), **how).schema).parquet(f"{at}/out")
