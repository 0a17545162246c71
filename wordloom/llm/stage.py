"""Tables between the jobs of an operator: written once to the shared folder, read back from there.

The folder is the cluster's ``spark.checkpoint.dir``; every executor sees it, so a lost executor
costs a rerun of its tasks only. Where the session names none (tests), a folder of this machine
is used, which is right only for local masters.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir


def new_path(spark: SparkSession, name: str) -> str:
    """A path of the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/wordloom-{name}-{uuid.uuid4().hex}"


#: Bytes of a batch that goes to a Python worker while a table is written.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs begun here send rows to Python in batches of about BATCH_BYTES at most: a batch is held
    several times over by both sides, so the default of 64 MB takes most of a small executor."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of the shared folder; its lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A table of one or two long columns is broadcast up to this many rows, about 8 MB in memory.
BROADCAST_ROWS = 1 << 17


def joined(df: DataFrame, keys: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """df joined with a written table of one or two long columns: by a broadcast if it is counted to be
    small, so that wide rows of df stay where they are, else by a shuffle of both."""
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, on, how)


def drop(*tables: DataFrame) -> None:
    """Removes tables that ``written`` made and nobody reads any more."""
    for df in tables:
        spark = df.sparkSession
        jvm, files = spark.sparkContext._jvm, df.inputFiles()
        if files:
            folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
