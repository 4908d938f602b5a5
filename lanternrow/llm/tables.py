"""Reading of the driver's tables, and the shared folder."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, n: int) -> Column:
    """crc32 of a number as text, modulo n; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new path in spark.checkpoint.dir, which the whole cluster shares; set here only where unset and all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
        root = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch that a Python worker is sent, or one longer row; Spark's own bound is 64 MB.
BATCH_BYTES = 2 << 20


@contextmanager
def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> Iterator[None]:
    """Jobs started within send Python workers batches of at most `most` bytes, so rows of long texts don't add up in JVM and worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    own = int(before.rstrip("bB"))
    spark.conf.set(name, str(min(most, own) if own > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, kind: str, compression: str = "snappy") -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, kind)
    with bounded_batches(df.sparkSession):
        df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more, now rather than at some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Ids up to which a set of dropped rows is broadcast; beyond, the join shuffles.
BROADCAST_IDS = 2_000_000


def without(docs: DataFrame, ids: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """docs without the rows whose doc_id is in ids (one column); null is in ids if it is there. Columns as they are, of any name."""
    gone = stored(ids.distinct().toDF("gone"), "gone")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    left, right = docs.alias("docs"), side.alias("ids")
    return left.join(right, F.col(f"docs.`{doc_id}`").eqNullSafe(F.col("ids.gone")), "left_anti")


def sampled(docs: DataFrame, column: str, most: int, most_bytes: int, doc_id: str = "doc_id") -> list[str]:
    """Texts of `column` of the `most` doc_ids of smallest hash, in that order; one text, the least, for each doc_id.

    Texts that would go beyond most_bytes in all are passed over, so what comes to the driver is
    bounded. Only hashes and sizes are ranked. Null doc_ids aren't drawn, null texts are empty.
    """
    hashed = docs.filter(F.col(doc_id).isNotNull()).select(F.xxhash64(F.col(doc_id).cast("string")).alias("h"), F.coalesce(column, F.lit("")).alias("t"))
    first = hashed.groupBy("h").agg(F.max(F.octet_length("t")).alias("size")).orderBy("h").limit(most).collect()
    taken, total = [], 0
    for r in first:
        if total + r.size <= most_bytes:
            taken.append((r.h,))
            total += r.size
    if not taken:
        return []
    few = F.broadcast(docs.sparkSession.createDataFrame(taken, "h long"))  # `most` rows at the most
    return [r[0] for r in hashed.join(few, "h").groupBy("h").agg(F.min("t").alias("t")).orderBy("h").select("t").collect()]
