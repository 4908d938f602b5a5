"""Tables in the folder that the cluster shares, and whether a job has finished one."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new path in spark.checkpoint.dir; set here only where it is unset and all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
        root = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """df as Parquet in a new shared folder, read again: computed once, its lineage cut, safe from lost executors."""
    return kept(df, shared_folder(df.sparkSession, kind))


#: Rows that a task sorts at most, about, where dealt() deals them.
TASK_ROWS = 200_000


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """A stored df dealt by keys over as many tasks as its number of rows asks for, so that a task's memory doesn't grow with it."""
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = -(-df.count() // TASK_ROWS)
    return df.repartition(parts, *by) if parts > own else df


#: Bytes of text in a bucket, about.
BUCKET_BYTES = 64 << 20


def bucketed(df: DataFrame, kind: str, by: str, text: str = "text") -> DataFrame:
    """df as a table in a new shared folder in buckets of `by`: what is joined by it alone, or grouped by it and other keys, leaves df's rows where they are."""
    spark = df.sparkSession
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    name = f"{kind}_{uuid.uuid4().hex}"
    df.repartition(parts, by).write.bucketBy(parts, by).option("path", shared_folder(spark, kind)).saveAsTable(name)
    return spark.table(name)


def kept(df: DataFrame, path: str) -> DataFrame:
    """df written to path, unless a job has finished it before; what a killed job left there is replaced."""
    if not finished(df.sparkSession, path):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a job has committed path: Spark's committer puts _SUCCESS there when all of its tasks are done."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


#: Bytes of a batch that a Python worker is sent.
BATCH_BYTES = 2 << 20


@contextmanager
def bounded_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs started within send Python workers batches of at most `most` bytes, or one longer row."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    own = int(before.rstrip("bB"))
    spark.conf.set(name, str(min(most, own) if own > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(name, before)
