"""Where intermediate tables are written: the shared folder that the cluster names."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: While an intermediate table is written: shuffle files go as soon as the write has ended, and nothing is
#: broadcast for being small just now, only what is marked; the driver would keep such copies until it collects garbage.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.autoBroadcastJoinThreshold": "-1"}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where it is unset, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="telemill-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


@contextmanager
def _writing(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    What the driver kept for the write (plans, task results, copies of
    broadcasts) is only found by its collector, which a small driver that runs
    many writes in a row would not start before its heap is full.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _writing(spark):
        df.write.option("compression", compression).parquet(path)
    if not spark.sparkContext.master.startswith("local["):  # there the driver is the executor and has its memory
        gc.collect()
        spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like :func:`written`, in buckets by ``key``, so that joins on it do not shuffle the table again."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    with _writing(spark):
        df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).saveAsTable(table)
    out = spark.table(table)
    out._written_to, out._table = path, table
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of :func:`written` and :func:`bucketed` that nothing reads any more."""
    for df in tables:
        path, table = getattr(df, "_written_to", None), getattr(df, "_table", None)
        if table:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
        if path:
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
