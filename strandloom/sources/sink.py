"""FASTQ sinks: each read goes to the file that its template names.

One file per path, in order of index and mate. Reads are dealt out by path and written by one task each to a file beside
the target; a path with a scheme is written through Spark's own files, to any store that Spark reaches; the job's commit moves all of them into place, so a task that is run again, or a job that fails, leaves no
half-written file. A path that ends in .gz is compressed. Several paths are written side by side; one path is one task, as
the file has one order.
"""

from __future__ import annotations

import gzip
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from ..errors import FastqError, ReadNameError
from ..functions.selector import sel
from ..functions.template import Text, template
from ..names import Label


def record_text(name, seq, qual):
    """A record's four lines."""
    return F.concat(F.lit("@"), name, F.lit("\n"), seq, F.lit("\n+\n"), qual, F.lit("\n"))


def records(reads, selector, paths: tuple[str, ...]) -> DataFrame:
    """path, idx, mate and record of the selected reads."""
    c = reads._c
    node, parts = sel(selector), [template(p) for p in paths]
    chosen = c.selected(node)
    checks = [x for p in parts for x in c.checks(p)]
    df = reads._guarded(chosen, checks)
    df = df if chosen is None else df.where(chosen)
    rows = []
    for mate, p in enumerate(parts, 1):
        for kind in (f"name{mate}", f"seq{mate}"):
            if kind not in reads.schema.types:
                raise ReadNameError(f"{kind} is not in the reads")
        seq = c.strand(f"seq{mate}")
        text = record_text(c.text(Label(f"name{mate}", "*")), seq.str, F.coalesce(seq.qual, F.repeat(F.lit("I"), F.length(seq.str))))
        rows.append(F.struct(c.filled(p).alias("path"), reads._first_idx().alias("idx"), F.lit(mate).alias("mate"), text.alias("record")))
    return df.select(F.inline(F.array(*rows)))


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class FastqWriter(DataSourceArrowWriter):
    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files: list[tuple[str, str]] = []
        now, out = None, None
        try:
            for batch in iterator:
                for path, text in zip(batch["path"].to_pylist(), batch["record"].to_pylist(), strict=True):
                    if path != now:
                        if out:
                            out.close()
                        if not path:
                            raise FastqError("a read's path is empty")
                        now, part = path, f"{path}.{uuid.uuid4().hex}.part"
                        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
                        out = gzip.open(part, "wb") if path.endswith(".gz") else open(part, "wb")
                        files.append((part, path))
                    out.write(text.encode("latin-1", "replace"))
        except BaseException:
            self._drop(files)
            raise
        finally:
            if out:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            for part, path in m.files if m else ():
                os.replace(part, path)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            self._drop(m.files if m else ())

    @staticmethod
    def _drop(files) -> None:
        for part, _ in files:
            if os.path.exists(part):
                os.remove(part)


def is_remote(path: str) -> bool:
    """Whether a path template names a store by its scheme; that is told by its first literal text."""
    first = template(path)[:1]
    return bool(first) and isinstance(first[0], Text) and "://" in first[0].text


def write(rows: DataFrame, tasks: int | None = None, remote: bool = False) -> None:
    """Write path, idx, mate and record: by the data source, or, of a remote store, by Spark's own writer."""
    if not remote:
        dealt(rows, tasks).write.format("fastq").mode("append").save()
        return
    for packed in (False, True):
        _write_remote(rows.where(F.endswith("path", F.lit(".gz")) == packed), packed, tasks)


def dealt(rows: DataFrame, tasks: int | None) -> DataFrame:
    """Rows of a path together and in order."""
    from .fastq import FastqSource

    rows.sparkSession.dataSource.register(FastqSource)
    out = rows.repartition("path") if tasks is None else rows.repartition(tasks, "path")
    return out.sortWithinPartitions("path", "idx", "mate")


def _write_remote(rows: DataFrame, packed: bool, tasks: int | None) -> None:
    """Each path's records as one text file of a folder beside the first path, moved to the path when all are written. The
    folder's own parts are named by the path, so the driver lists them and holds no records. Characters beyond ASCII are
    written as UTF-8."""
    if rows.isEmpty():
        return
    spark = rows.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    first = rows.agg(F.min("path")).first()[0]
    staging = jvm.org.apache.hadoop.fs.Path(f"{first.rsplit('/', 1)[0]}/_writing-{uuid.uuid4().hex}")
    files = staging.getFileSystem(conf)
    try:
        text = dealt(rows, tasks).select("path", F.expr("substr(record, 1, length(record) - 1)").alias("value"))
        text.write.partitionBy("path").option("compression", "gzip" if packed else "none").text(staging.toString())
        for folder in files.listStatus(staging):
            name = folder.getPath().getName()
            if not name.startswith("path="):
                continue
            target = jvm.org.apache.hadoop.fs.Path(unquote(name[5:]))
            parts = [x.getPath() for x in files.listStatus(folder.getPath())]
            if len(parts) != 1:
                raise FastqError(f"{target.toString()} was written in {len(parts)} parts")
            files.mkdirs(target.getParent())
            files.delete(target, False)
            if not files.rename(parts[0], target):
                raise FastqError(f"{target.toString()} could not be written")
    finally:
        files.delete(staging, True)
