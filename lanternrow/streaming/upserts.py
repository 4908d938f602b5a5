"""An upsert log as a stream: each key keeps its first place and its latest version, whatever order lines come in.

New files of a folder are the log's changes: a file stream reads each once. State is a row a key, in
the state store of the stream's checkpoint; what a batch changed is appended under its number, so a
batch that is run again replaces itself, and the table is the last change of each key.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery


class _Versions(StatefulProcessor):
    """State of a key: the order value of its first line, of its latest, and the latest line's fields as JSON."""

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "first long, last long, body string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first, last, body = self.held.get() if self.held.exists() else (None, None, None)
        for pdf in rows:
            low, at = int(pdf["at"].min()), int(pdf["at"].idxmax())
            first = low if first is None else min(first, low)
            # a late line doesn't replace a newer one; of equal ones the first seen stays
            if last is None or int(pdf["at"].loc[at]) > last:
                last, body = int(pdf["at"].loc[at]), pdf["body"].loc[at]
        self.held.update((first, last, body))
        yield pd.DataFrame({"key": [key[0]], "seq": [first], "last": [last], "body": [body]})

    def close(self) -> None:
        pass


#: The state store that keeps state of arbitrary processors.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def upserts(log: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """Changes of a streaming log (key, order: a number, values): key, seq (the first order value), last, body (the latest values as JSON), in update mode."""
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    kind = dict(log.dtypes)[key]
    lines = log.filter(F.col(order).isNotNull()).select(F.col(key).alias("key"), F.col(order).cast("long").alias("at"), F.to_json(F.struct(*values), {"ignoreNullFields": "false"}).alias("body"))
    return lines.groupBy("key").transformWithStateInPandas(statefulProcessor=_Versions(key), outputStructType=f"key {kind}, seq long, last long, body string", outputMode="Update", timeMode="None")


def changes_to(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what is new to path, a folder a batch, and ends when all that was there has been read."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, *by: str) -> DataFrame:
    """The last change of each key of what changes_to() wrote."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*by, "batch")]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*by, "r.*")


def fields(rows: DataFrame, schema: str, body: str = "body") -> DataFrame:
    """rows with the fields of body, which is taken out."""
    return rows.withColumn("__b", F.from_json(body, schema)).select(*(c for c in rows.columns if c != body), "__b.*")
