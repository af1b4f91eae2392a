"""Where intermediate results live, so that lost executors cost a re-read and not a re-run."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from itertools import chain

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset a temporary folder serves a local session; on a cluster, whose machines do not see
    each other's folders, it is an error.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="terracell-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once with ``checkpoint()``; Spark removes its files when they are no longer used if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, as :mod:`terracell.session` does."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def discard(spark: SparkSession, path: str) -> None:
    """Removes a written table that nothing reads any more."""
    fs, p = _files(spark, path)
    fs.delete(p, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A new path for a table in the session's own folder, which goes when the application ends."""
    home = f"{shared_dir(spark)}/terracell-{spark.sparkContext.applicationId}"
    fs, p = _files(spark, home)
    if fs.mkdirs(p):
        fs.deleteOnExit(p)
    return f"{home}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Through Hadoop, so any store counts."""
    fs, p = _files(spark, path)
    return fs.exists(p)


def write_bytes(spark: SparkSession, path: str, *parts: Iterable[bytes]) -> None:
    """A file from pieces, one in memory at a time; it takes its name when it is complete, replacing an older one."""
    fs, p = _files(spark, path)
    half = p.suffix(f".{uuid.uuid4().hex}.part")
    out = fs.create(half, True)
    try:
        for piece in chain(*parts):
            out.write(bytearray(piece))
    finally:
        out.close()
    fs.delete(p, False)
    if not fs.rename(half, p):
        raise OSError(f"cannot write {path}")


def copy(spark: SparkSession, source: str, target: str, overwrite: bool = False) -> bool:
    """Copies a file as it is, in or between stores; False if the target exists and ``overwrite`` is off."""
    if not overwrite and exists(spark, target):
        return False
    (fs, a), (gs, b) = _files(spark, source), _files(spark, target)
    return spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, gs, b, False, True, spark._jsc.hadoopConfiguration())
