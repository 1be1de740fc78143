"""The same operations on streams: all but the fork, time and count work read by read, so they take a stream as it is."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..reads import Reads
from ..sources.fastq import binary_rows, to_reads


def stream_fastq(spark: SparkSession, folder: str, mode: str = "single", files_at_once: int = 100) -> Reads:
    """Reads of the files that come into a folder; indices count within each file."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_at_once).load(folder)
    return to_reads(binary_rows(files, mode), mode)


def start(reads: Reads, function, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Give each micro-batch as Reads, with its number, to a function, which may write it."""

    def each(df: DataFrame, number: int) -> None:
        function(replace(reads, df=df), number)

    out = reads.df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
