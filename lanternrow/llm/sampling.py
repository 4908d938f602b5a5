"""A bounded sample of labelled texts for fitting a classifier on the driver."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stored

#: Bytes of text that a sample may have in all.
SAMPLE_BYTES = 96 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column | None, per_class: int, most_bytes: int = SAMPLE_BYTES) -> tuple[list[str], list[int]]:
    """Texts and labels of at most per_class rows of each label 0 and 1, in a fixed order.

    Rows are taken by the smallest hash of doc_id, among labelled rows where `train` (over doc_id)
    holds; those whose text would go beyond most_bytes in all are passed over. Null labels and null
    doc_ids teach nothing; of repeated labels the largest counts, of repeated documents the first
    text in byte order. Null texts count as empty.
    """
    own = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    own = (own.filter(train) if train is not None else own).groupBy("doc_id").agg(F.max("label").alias("label"))
    taken = [own.filter(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for v in (0, 1)]
    rows = [(r.doc_id, r.label) for part in taken for r in part.collect()]
    if not rows:
        return [], []
    kind = dict(docs.dtypes)["doc_id"]
    wanted = docs.sparkSession.createDataFrame(rows, f"doc_id {kind}, label int")
    # at most 2 * per_class rows, so the size of this broadcast is bounded; repeats are settled before anything is collected
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    found = stored(found, "labelled")
    order = lambda k: (zlib.crc32(repr(k).encode()), k)
    kept, total = [], 0
    for doc_id, size in sorted(found.select("doc_id", F.octet_length("text")).collect(), key=lambda r: order(r[0])):
        if total + size <= most_bytes:
            kept.append((doc_id,))
            total += size
    if not kept:
        return [], []
    few = F.broadcast(docs.sparkSession.createDataFrame(kept, f"doc_id {kind}"))
    pairs = {r.doc_id: (r.text, r.label) for r in found.join(few, "doc_id").collect()}
    return [pairs[k][0] for k in sorted(pairs, key=order)], [pairs[k][1] for k in sorted(pairs, key=order)]
