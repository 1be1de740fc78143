"""Helpers that the training-data operators share.

Every operator reads only the id and text columns it is told of, through :func:`documents`, so
extra columns of any name never clash with its own.
"""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: ASCII space and the control characters 09 to 0D.
BLANKS = r"[\x20\x09-\x0D]+"


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``text`` alone; a null text counts as empty."""
    return df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once a row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count_upto(values: Column, key: Column) -> Column:
    """How many of some ascending values are not above the key, by halving."""
    size = F.size(values)
    span = F.struct(F.lit(0).alias("lo"), size.alias("hi"))

    def half(s: Column, _: Column) -> Column:
        mid = F.floor((s.lo + s.hi) / 2).cast("int")
        under = (s.lo < s.hi) & (F.get(values, mid) <= key)
        return F.struct(F.when(under, mid + 1).otherwise(s.lo).alias("lo"), F.when((s.lo < s.hi) & ~under, mid).otherwise(s.hi).alias("hi"))

    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(size + 1)).cast("int")), span, half, lambda s: s.lo)


def words(text: Column) -> Column:
    """The maximal runs of other than ASCII white space, as an array."""
    return F.array_remove(F.split(text, BLANKS), "")


def shingle_hashes(tokens: Column, width: int) -> Column:
    """64-bit hashes of all runs of ``width`` tokens, in order; fewer tokens make one run, none makes none."""
    return let(
        F.transform(tokens, lambda w: F.xxhash64(w)),
        lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>"))
        .when(F.size(h) < width, F.array(F.xxhash64(h)))
        .otherwise(F.transform(F.sequence(F.lit(1), F.size(h) - (width - 1)), lambda i: F.xxhash64(F.slice(h, i, width)))),
    )


#: Spark's setting by which a finished query's shuffle files go at once.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set here only where the cluster names none (as in tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext.getCheckpointDir()
        if held:
            return held
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "/tmp/strandloom-checkpoints"
        spark.sparkContext.setCheckpointDir(found)
    return found


def save(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends there, and a lost executor costs no more
    than its own tasks. The folder goes when the session's Python ends, or at :func:`discard`."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    spark, held = df.sparkSession, df.sparkSession.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")  # what this one write shuffled is not read again
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN, held) if held is not None else spark.conf.unset(CLEAN)
    _written[path] = df.sparkSession
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._strandloom_path = path
    return back


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let the session hand whole texts to Python by so many rows at most, where it would take more. This stays set, as it
    counts when a plan runs and not when it is made; it changes no result. Of 10,000 texts (Spark's own number) the JVM and
    the worker each hold several copies outside the heap, and the JVM does not give that memory back."""
    if not 0 < int(spark.conf.get(BATCH, "10000")) <= rows:
        spark.conf.set(BATCH, rows)


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows for what runs inside."""
    held = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH, held) if held is not None else spark.conf.unset(BATCH)


@cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library gives memory back by itself
        return None


def give_back() -> None:
    """Freed memory back to the system, so that a worker that waits for its next task holds what it needs and no more."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame | None) -> None:
    """Delete the table behind a frame that :func:`save` returned; nothing may read it after."""
    path = getattr(df, "_strandloom_path", None)
    if path and _written.pop(path, None) is not None:
        _delete(df.sparkSession, path)


@atexit.register
def _clean() -> None:
    for path, spark in list(_written.items()):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit; the folder is then left to its owner
            return
