"""Exact deduplication over an extendible-hash index on shared files; DataFrame functions only.

Keys are 64-bit hashes of whole normalised texts. The directory starts with one bucket; a bucket
that holds more keys than its capacity is split by one more leading bit, and the directory doubles
whenever a bucket gets deeper than it. The directory has at most 2**MAX_BITS entries, as each
counts a range of keys, so it is the only thing that the driver sees; buckets at that depth hold
what they hold. Leading bits give a key its slot, the slot its bucket, and each bucket is dealt to
one owner task, which holds the key range of the bucket: there texts of a key are compared by their
bytes and counted, and different texts of one key chain. Only texts of keys with several rows are
dealt (a bit table, sized by their number, lets some more through), once for each of SALTS parts of
the input, so a hot text costs its owner a few rows; a key of one row has nothing to be compared
with. The index is written as Parquet files in the shared folder, sorted by bucket, key and chain.

A row finds its answer by the way that a key was stored: slot, bucket, then key and SHA-256 within
the bucket, which tells a chain's texts apart. Rows of groups above a HOT-th of all rows, fewer than
HOT groups, look theirs up in a broadcast, so no task gets a hot key's rows.

Null texts count as empty, so do empty ones: they are copies of each other. Rows with a null
doc_id belong to their group; the group's keep_id is its smallest doc_id that is not null, else
null, and of rows that repeat that doc_id with equal texts one is kept.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import BROADCAST_IDS, stored

#: Leading hash bits that the directory can use at most.
MAX_BITS = 16
#: Keys that a bucket holds before it splits.
CAPACITY = 1 << 20
#: Bits of the table of keys with several rows: 16 for each of them, within bounds (16 MB as words); parts of the input that count a text by themselves; the share of all rows from which a group is hot.
TABLE_BITS, SALTS, HOT = (16, 27), 16, 1000


def normalised(text: Column) -> Column:
    """The text, null as empty, with each run of bytes 0x20, 0x09-0x0D as one space."""
    # single spaces stay as they are, so only other runs need a match
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned(F.col("hash"), 64 - bits) if bits else F.lit(0).cast("long")


def directory(counts: dict[int, int], capacity: int, max_bits: int = MAX_BITS) -> tuple[int, list[tuple[int, int]]]:
    """(global depth, buckets as (leading bits, depth)) from the keys counted by max_bits leading bits.

    >>> directory({0: 3, 1: 3, 2: 1, 3: 1}, 4, 2)
    (2, [(0, 2), (1, 2), (1, 1)])
    """
    level = [counts.get(i, 0) for i in range(1 << max_bits)]
    sums = [level]
    while len(level) > 1:
        level = [a + b for a, b in zip(level[::2], level[1::2], strict=True)]
        sums.append(level)
    out, todo = [], [(0, 0)]
    while todo:
        bits, depth = todo.pop()
        if depth < max_bits and sums[max_bits - depth][bits] > capacity:
            todo += [(2 * bits + 1, depth + 1), (2 * bits, depth + 1)]
        else:
            out.append((bits, depth))
    return max(d for _, d in out), out


def bucket_table(spark, depth: int, buckets: list[tuple[int, int]]) -> DataFrame:
    """The directory, a row for each of its 2**depth entries: slot, bucket. At most 2**MAX_BITS rows."""
    rows = [(slot, n) for n, (bits, own) in enumerate(buckets) for slot in range(bits << depth - own, (bits + 1) << depth - own)]
    return spark.createDataFrame(rows, "slot long, bucket int")


@dataclass
class Index:
    """buckets: bucket, hash, chain, sha, keep_id, group_size, stays (a row of entries); depth and slots (slot, bucket) are the directory that leads to them."""

    buckets: DataFrame
    depth: int
    slots: DataFrame

    def routed(self, rows: DataFrame) -> DataFrame:
        """rows (hash, …) with the bucket that the directory sends their key to. The directory has 2**MAX_BITS entries at most."""
        return rows.withColumn("slot", _prefix(self.depth)).join(F.broadcast(self.slots), "slot").drop("slot")

    def find(self, entries: DataFrame, total: int) -> DataFrame:
        """entries (doc_id, hash, sha, row) with chain, keep_id, group_size, stays of their keys."""
        key = ["bucket", "hash", "sha"]
        hot = F.broadcast(self.buckets.filter(F.col("group_size") * HOT > total))  # fewer than HOT rows
        rows = self.routed(entries)
        cold = rows.join(hot, key, "left_anti").join(self.buckets.filter(F.col("group_size") * HOT <= total), key)
        return cold.unionByName(rows.join(hot, key))


def build_index(norm: DataFrame, entries: DataFrame, capacity: int = CAPACITY) -> Index:
    """The index of norm (doc_id, norm, hash) and its entries (doc_id, hash, sha, row)."""
    spark = norm.sparkSession
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    keys = stored(entries.groupBy("hash", "sha").agg(first, F.count("*").alias("n")), "keys")
    counts = {r[0]: r[1] for r in keys.select("hash").distinct().groupBy(_prefix(MAX_BITS).alias("p")).agg(F.count("*")).collect()}
    # a bucket for each core at least, as far as the directory goes
    fair = -(-sum(counts.values()) // max(1, 4 * spark.sparkContext.defaultParallelism))
    depth, split = directory(counts, max(1, min(capacity, fair)))
    empty = Index(keys, depth, bucket_table(spark, depth, split))

    several = stored(keys.groupBy("hash").agg(F.sum("n").alias("rows")).filter("rows > 1").select("hash"), "several")
    near = _near(norm, several)
    # a text goes to its owner once for each part of the input that has it, with its counts
    parted = near.withColumn("salt", F.spark_partition_id() % SALTS).groupBy("hash", "norm", "salt").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    dealt = empty.routed(parted.drop("salt")).repartition("bucket")
    # in the owner's task: the bytes decide, no row moves again
    texts = dealt.groupBy("bucket", "hash", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    compared = texts.select("bucket", "hash", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size").join(empty.routed(several), ["bucket", "hash"], "left_semi")
    own = empty.routed(keys)
    alone = own.join(empty.routed(several), ["bucket", "hash"], "left_anti").select("bucket", "hash", "sha", F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"))
    owned = compared.unionByName(alone).join(own.select("bucket", "hash", "sha", F.col("first.row").alias("stays")), ["bucket", "hash", "sha"])
    # one owner a bucket again: the chain is numbered and the bucket's files are written where its keys are
    chained = owned.repartition("bucket").withColumn("chain", F.row_number().over(Window.partitionBy("bucket", "hash").orderBy("sha")) - 1)
    return Index(stored(chained.sortWithinPartitions("bucket", "hash", "chain"), "index"), depth, empty.slots)


def _near(norm: DataFrame, several: DataFrame) -> DataFrame:
    """Rows of norm whose hash is one of `several`, and few others: those whose bit in a table of all of them is set."""
    bits = min(TABLE_BITS[1], max(TABLE_BITS[0], (16 * several.count()).bit_length()))
    at = F.shiftrightunsigned("hash", 64 - bits)
    place = f"cast(shiftrightunsigned(hash, {64 - bits}) & 63 as int)"
    table = several.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, {place})").alias("v")).groupBy("w").agg(F.bit_or("v").alias("v"))  # 2**(bits - 6) rows at most
    return norm.withColumn("w", F.shiftright(at, 6)).join(F.broadcast(table), "w").filter(F.getbit("v", F.expr(place)) == 1).drop("w", "v")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, hash_bits: int = 64) -> DataFrame:
    """A row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, chain.

    chain numbers the different texts of one hash, 0 unless hashes collide, as they do when hash_bits are few.
    """
    entries, index = indexed(docs, doc_id, text, capacity, hash_bits)
    found = index.find(entries, entries.count())
    return found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("stays")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "chain")


def indexed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, hash_bits: int = 64) -> tuple[DataFrame, Index]:
    """(entries, index) of docs."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("norm"))
    norm = plain.withColumn("hash", F.xxhash64("norm").bitwiseAND(F.lit(-1 << 64 - hash_bits)) if hash_bits < 64 else F.xxhash64("norm"))
    entries = stored(norm.select("doc_id", "hash", F.unhex(F.sha2("norm", 256)).alias("sha"), F.monotonically_increasing_id().alias("row")), "entries")
    return entries, build_index(norm, entries, capacity)


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without the copies; columns as they are, of any name. A row of one doc_id and text stays once."""
    found = exact_groups(docs, doc_id, text, **options)
    pairs = stored(found.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n"), F.max("kept").alias("kept")).filter("not kept or n > 1"), "copies")
    side = F.broadcast(pairs) if pairs.count() <= BROADCAST_IDS else pairs
    rows = docs.alias("docs")
    same = F.col(f"docs.`{doc_id}`").eqNullSafe(F.col("copy.doc_id")) & (F.sha2(normalised(F.col(f"docs.`{text}`")), 256) == F.col("copy.text_sha256"))
    out = rows.join(side.alias("copy"), same, "left_anti")
    twice = pairs.filter("kept")
    if twice.isEmpty():
        return out
    # rows that repeat a doc_id and text, one of which stays
    key = f"key_{uuid.uuid4().hex}"
    again = rows.join(twice.alias("copy"), same, "left_semi").withColumn(key, F.sha2(normalised(F.col(text)), 256))
    return out.unionByName(again.dropDuplicates([doc_id, key]).drop(key))
