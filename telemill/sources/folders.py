"""Folders and small files on the storage that driver and executors share, by Hadoop's file system API."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a temporary one only on a single machine where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="telemill-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names inside a folder; none if it is not there."""
    fs, p = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    fs, p = _at(spark, path)
    _, target = _at(spark, to)
    fs.mkdirs(target.getParent())
    if not fs.rename(p, target):
        raise OSError(f"{path} could not become {to}")


def copy(spark: SparkSession, path: str, to: str) -> None:
    """Copy a small file."""
    fs, p = _at(spark, path)
    target_fs, target = _at(spark, to)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, target_fs, target, False, spark._jsc.hadoopConfiguration())


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless it is there; false if it is.  Of several at once, one wins."""
    fs, p = _at(spark, path)
    try:
        out = fs.create(p, False)
    except Exception as e:
        if "exist" in str(e).lower():
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def text_of(spark: SparkSession, path: str) -> str | None:
    """A small file's text; none if it is not there."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def modified(spark: SparkSession, path: str) -> tuple[tuple[str, int, int], ...]:
    """Name, size and time of every file under ``path``: changes whenever one of them does."""
    fs, p = _at(spark, path)
    found, files = [], fs.listFiles(p, True)
    while files.hasNext():
        x = files.next()
        found.append((x.getPath().toString(), x.getLen(), x.getModificationTime()))
    return tuple(sorted(found))
