"""FASTQ sources.

Records are numbered by their order in a file, which only reading it in order tells, so a file is one partition and many
files are read side by side. Local and mounted paths go through a Python data source that streams; a path with a scheme
(of a store that only Spark reads) comes through Spark's own binary files, whole, up to 2 GB each; mates of two files meet
in one row.

Bytes become characters one to one (ISO-8859-1), so offsets are those of bytes. Plain and gzip files are told apart by
their first bytes. An empty file has no reads.
"""

from __future__ import annotations

import glob
import gzip
import io
import os
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import FastqError
from ..reads import Reads

BATCH = 4096
ONE = "name1 string, seq1 string, qual1 string, idx bigint, origin string"
TWO = f"{ONE}, name2 string, seq2 string, qual2 string, idx2 bigint"
Record = tuple[str, str, str]


def parse(lines: Iterator[bytes], origin: str) -> Iterator[Record]:
    """Name (all of the header after @), bytes and qualities of each record."""
    lines, n = (x.rstrip(b"\r\n") for x in lines), 0
    while True:
        four = list(islice(lines, 4))
        if not any(four):
            if any(lines):
                raise FastqError(f"record {n} in {origin}: blank lines within the file")
            return
        if len(four) < 4 or four[0][:1] != b"@" or four[2][:1] != b"+" or len(four[1]) != len(four[3]):
            raise FastqError(f"record {n} in {origin} is no FASTQ record")
        yield four[0][1:].decode("latin-1"), four[1].decode("latin-1"), four[3].decode("latin-1")
        n += 1


def opened(raw: io.BufferedIOBase) -> io.BufferedIOBase:
    return gzip.GzipFile(fileobj=raw) if raw.peek(2)[:2] == b"\x1f\x8b" else raw


def singles(records: Iterator[Record], origin: str) -> Iterator[tuple]:
    for i, r in enumerate(records):
        yield (*r, i, origin)


def interleaved(records: Iterator[Record], origin: str) -> Iterator[tuple]:
    """Records 2k and 2k + 1 are mates, each with an index of its own."""
    for i, one in enumerate(records):
        two = next(records, None)
        if two is None:
            raise FastqError(f"record {2 * i} in {origin} has no mate")
        yield (*one, 2 * i, origin, *two, 2 * i + 1)


def paired(first: Iterator[Record], second: Iterator[Record], origin: str) -> Iterator[tuple]:
    """Mates at equal places of two files; what the second file has beyond the first is passed over."""
    for i, one in enumerate(first):
        two = next(second, None)
        if two is None:
            raise FastqError(f"record {i} in {origin} has no mate")
        yield (*one, i, origin, *two, i)


def batches(rows: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, BATCH)):
        kinds = [pa.int64() if n.startswith("idx") else pa.string() for n in names]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names)


def _names(mode: str) -> list[str]:
    return [x.split()[0] for x in (ONE if mode == "single" else TWO).split(", ")]


class _Files(InputPartition):
    def __init__(self, first: str, second: str | None):
        super().__init__(first)
        self.first, self.second = first, second


class FastqReader(DataSourceReader):
    def __init__(self, options: dict):
        self.mode, self.options = options.get("mode", "single"), options

    def partitions(self) -> list[InputPartition]:
        def files(path: str) -> list[str]:
            got = sorted(glob.glob(os.path.join(path, "*") if os.path.isdir(path) else path))
            if not got:
                raise FastqError(f"no file at {path}")
            return got

        first = files(self.options["path"])
        second = files(self.options["path2"]) if self.mode == "paired" else [None] * len(first)
        if len(first) != len(second):
            raise FastqError("as many first as second files are needed")
        return [_Files(a, b) for a, b in zip(first, second, strict=True)]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        with open(partition.first, "rb") as a:
            one = parse(opened(a), partition.first)
            if partition.second is None:
                rows = singles(one, partition.first) if self.mode == "single" else interleaved(one, partition.first)
                yield from batches(rows, _names(self.mode))
            else:
                with open(partition.second, "rb") as b:
                    yield from batches(paired(one, parse(opened(b), partition.second), partition.first), _names(self.mode))


class FastqSource(DataSource):
    """``spark.read.format("fastq")`` with options path, mode (single, interleaved, paired) and path2."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return ONE if self.options.get("mode", "single") == "single" else TWO

    def reader(self, schema) -> DataSourceReader:
        return FastqReader(dict(self.options))

    def writer(self, schema, overwrite: bool):
        from .sink import FastqWriter

        return FastqWriter()


def to_reads(df: DataFrame, mode: str) -> Reads:
    more = {} if mode == "single" else {"name2": "name2", "seq2": "seq2", "qual2": "qual2", "idx2": "idx2"}
    return Reads.from_dataframe(df, "idx", df["origin"], name1="name1", seq1="seq1", qual1="qual1", **more)


def binary_rows(files: DataFrame, mode: str) -> DataFrame:
    """Rows of Spark's binary files (path, content; of mates also content2); also of a stream of them."""
    if mode == "paired" and "content2" not in files.columns:
        raise FastqError("mates in two files are not read from one stream")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda data, path: parse(opened(io.BufferedReader(io.BytesIO(data))), path)
        for batch in parts:
            for row in batch.to_pylist():
                one = read(row["content"], row["path"])
                if mode == "paired":
                    rows = paired(one, read(row["content2"], row["path"]), row["path"])
                else:
                    rows = (singles if mode == "single" else interleaved)(one, row["path"])
                yield from batches(rows, _names(mode))

    columns = ["path", "content", *["content2"] * (mode == "paired")]
    return files.select(*columns).mapInArrow(run, ONE if mode == "single" else TWO)


def _mates(spark: SparkSession, path: str, path2: str) -> DataFrame:
    """The contents of first and second files, in order of their names."""
    first, second = (spark.read.format("binaryFile").load(p) for p in (path, path2))
    named = [[r.path for r in f.select("path").orderBy("path").collect()] for f in (first, second)]  # names alone
    if len(named[0]) != len(named[1]):
        raise FastqError("as many first as second files are needed")
    both = spark.createDataFrame(list(zip(*named, strict=True)), "path string, path2 string")
    second = second.select(F.col("path").alias("path2"), F.col("content").alias("content2"))
    return first.select("path", "content").join(both, "path").join(second, "path2")


def load(spark: SparkSession, path: str, mode: str, path2: str | None = None) -> Reads:
    if "://" in path and mode == "paired":
        return to_reads(binary_rows(_mates(spark, path, path2), mode), mode)
    if "://" in path:
        return to_reads(binary_rows(spark.read.format("binaryFile").load(path), mode), mode)
    spark.dataSource.register(FastqSource)
    got = spark.read.format("fastq").option("mode", mode).option("path", path)
    return to_reads((got.option("path2", path2) if path2 else got).load(), mode)


def from_bytes(spark: SparkSession, data: bytes, mode: str) -> Reads:
    records = parse(opened(io.BufferedReader(io.BytesIO(data))), "bytes")
    rows = list((singles if mode == "single" else interleaved)(records, "bytes"))
    return to_reads(spark.createDataFrame(rows, ONE if mode == "single" else TWO), mode)
