"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: Rows of a batch that Python gets; Spark's own default is many for rows of whole texts.
BATCH, ROWS, DEFAULT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "2000", "10000"


def reach(spark: SparkSession) -> None:
    """Let Python workers import this package where the driver found it; elsewhere pass it by --py-files.

    Batches of Spark's default size are made smaller, for bounded memory.
    """
    if spark.conf.get(BATCH, DEFAULT_ROWS) == DEFAULT_ROWS:
        spark.conf.set(BATCH, ROWS)
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if home not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (known, home) if x)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``; only where that is unset and all runs on
    this machine, as in tests, a temporary folder is taken and remembered.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loglattice-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, compression: str = "zstd", rows: int = 0) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back; cuts lineage.

    The shuffle files of the write go when it has ended: nothing reads them again.
    ``rows`` is the size of the batches that Python gets meanwhile, for rows of whole texts.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    meanwhile = {CLEANUP: "true"} | ({BATCH: str(rows)} if rows else {})
    before = {key: spark.conf.get(key, "false" if key == CLEANUP else DEFAULT_ROWS) for key in meanwhile}
    for key, value in meanwhile.items():
        spark.conf.set(key, value)
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for df in tables:
        jvm, context = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(context).delete(path, True)


#: What operators keep in a Python worker between tasks.
CACHES: list = []


def kept(make):
    """``make`` with its last result kept in each Python worker, until a task of another operator is ``lean`` there."""
    CACHES.append(lru_cache(1)(make))
    return CACHES[-1]


def forget(own=None) -> None:
    """Empty what operators keep in this process, but for ``own``."""
    for cache in CACHES:
        if cache is not own:
            cache.cache_clear()


def lean(run, own=None):
    """``run``, for mapInArrow: it first forgets what operators other than that of ``own`` keep in the worker, and Arrow returns its free memory at the end."""

    def leaner(batches):
        forget(own)
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return leaner


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
