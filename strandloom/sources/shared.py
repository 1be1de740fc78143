"""Folders that the driver and all executors see."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import SparkSession

_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, or else the session's checkpoint folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and spark.sparkContext.master.startswith("local"):  # one machine, as in tests
        spark.sparkContext.setCheckpointDir("/tmp/strandloom-checkpoints")
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found.rstrip("/")


def folder(spark: SparkSession, scheme: bool = False) -> str:
    """A new folder there; it goes when the session's Python ends. Without ``scheme``, a path as mounted files have it."""
    path = f"{shared_dir(spark)}/files/{uuid.uuid4().hex}"
    _made[path] = spark
    plain = path.split(":", 1)[1] if path.startswith("file:") else path
    plain = "/" + plain.lstrip("/") if path.startswith("file:") else plain
    return (path if "://" in path else f"file://{plain}") if scheme else plain


@atexit.register
def _clean() -> None:
    for path, spark in _made.items():
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit; the folder is then left to its owner
            return
