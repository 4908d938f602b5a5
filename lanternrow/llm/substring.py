"""Removal of word windows that stand more than once, over a log-structured fingerprint index.

A window is WINDOW consecutive words. Equal windows have equal smallest hashes among their GRAM-word
hashes, so only those minima, about one word place in sixteen, go to the index. The index is a list
of immutable runs, each a table sorted and bucketed by fingerprint. A new batch is sorted once and
merge-joined with every run; a fingerprint met before, or twice in the batch, is a hit. The batch
then becomes a run itself, and runs are merged into one when there are more than `fan`. Windows
around hits are verified by 96 bits of hashes of all their words, which rest on 64-bit hashes of the
single words: those that occur once stay.

Texts of equal word sequences are judged once: where there are several of WINDOW words or more,
all their words go. Null and empty texts have no words. Repeated rows are copies of each other.
Results are per row; of a row with a null doc_id too.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import stored
from .words import SPACED, Words, mix, slices

WINDOW, GRAM, BATCHES, FAN = 35, 5, 3, 2
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


class FingerprintLog:
    """Sorted immutable runs of (fp, n), with hits collected batch by batch."""

    def __init__(self, spark: SparkSession, fan: int = FAN, runs: list[str] | None = None):
        self.spark, self.fan, self.runs = spark, fan, list(runs or [])
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, rows: DataFrame) -> str:
        name = f"fingerprints_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "fp").sortBy("fp").saveAsTable(name)
        return name

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds a batch of column fp (one row an occurrence; n, if present, its weight); returns its fingerprints that are repeated."""
        weight = F.sum("n") if "n" in batch.columns else F.count("*")
        new = self._write(batch.groupBy("fp").agg(weight.cast("long").alias("n")))
        own = self.spark.table(new)
        hits = own.filter("n > 1").select("fp")
        for run in self.runs:
            hits = hits.unionByName(own.filter("n = 1").select("fp").hint("merge").join(self.spark.table(run).select("fp"), "fp"))
        hits = stored(hits, "hits")
        self.runs.append(new)
        if len(self.runs) > self.fan:
            self.compact()
        return hits

    def compact(self) -> None:
        """Merges all runs into one and drops them."""
        old, rows = self.runs, self.spark.table(self.runs[0])
        for name in old[1:]:
            rows = rows.unionByName(self.spark.table(name))
        self.runs = [self._write(rows.groupBy("fp").agg(F.sum("n").alias("n")))]
        for name in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def drop(self) -> None:
        for name in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.runs = []


def _running(values: np.ndarray, k: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each k consecutive values."""
    out, size = values, 1
    while 2 * size <= k:
        out, size = pick(out[:-size], out[size:]), 2 * size
    return pick(out[: len(values) - k + 1], out[k - size : k - size + len(values) - k + 1]) if size < k else out


def minima(words: Words, hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each window, its minimum, places that are a minimum, their hashes)."""
    n, none = len(hashes), np.zeros(0, np.int64)
    if n < window:
        return none, none.astype(np.uint64), none, none.astype(np.uint64)
    grams = np.full(n, _TOP)
    value, at = words.windows(hashes, gram)
    grams[at] = value
    reach = window - gram + 1
    low = _running(grams, reach, np.minimum)[: n - window + 1]
    end = np.repeat(words.rows[1:], words.counts())
    ok = np.arange(len(low)) + window <= end[: len(low)]
    # a place is a minimum if the largest minimum of the windows over it is its own hash
    padded = np.zeros(len(low) + 2 * (reach - 1), np.uint64)
    padded[reach - 1 : reach - 1 + len(low)] = np.where(ok, low, 0)
    most = _running(padded, reach, np.maximum)
    place = np.flatnonzero((most == grams[: len(most)]) & (grams[: len(most)] != _TOP))
    start = np.flatnonzero(ok)
    return start, low[start], place, grams[place]


def _key(doc_id: str, text: str) -> Column:
    """Names a row by doc_id and text, so that it is found again in another scan."""
    return F.unhex(F.md5(F.concat_ws("\x00", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.coalesce(F.col(text), F.lit("")))))


def _lists(values: np.ndarray, rows: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    ends = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def scan(docs: DataFrame, window: int, gram: int, doc_id: str, text: str) -> DataFrame:
    """Per row: doc_id, key, n_words, sequence (hex SHA-256 of the words), fps (minima; one that stands twice is listed twice)."""
    source = docs.select(F.col(doc_id).alias("doc_id"), _key(doc_id, text).alias("key"), F.col(text).alias("__text"))
    names = ["doc_id", "key", "n_words", "sequence", "fps"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in slices(batch.column(2)):
                words = texts.words(SPACED)
                _, _, place, value = minima(words, words.hashes(), window, gram)
                row = np.searchsorted(words.rows, place, side="right") - 1
                order = np.lexsort((value, row))
                value, row = value[order], row[order]
                third = np.zeros(len(value), bool)
                third[2:] = (value[2:] == value[:-2]) & (row[2:] == row[:-2])
                value, row = value[~third].view(np.int64), row[~third]
                data = texts.data.tobytes()
                digests = [hashlib.sha256(b" ".join(data[a:b].split())).hexdigest() for a, b in zip(texts.offsets[:-1].tolist(), texts.offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(words.counts(), pa.int64()), pa.array(digests), _lists(value, row, j - i, pa.int64())], names=names)

    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, key binary, n_words long, sequence string, fps array<long>")


def _candidates(texts, fps: pa.Array, window: int, gram: int):
    """Words, their hashes, and the starts of the windows whose minimum is among the row's fps."""
    words = texts.words(SPACED)
    hashes = words.hashes()
    start, low, _, _ = minima(words, hashes, window, gram)
    row = np.searchsorted(words.rows, start, side="right") - 1
    listed = np.asarray(fps.flatten()).view(np.uint64)
    owner = np.repeat(np.arange(len(fps)), np.diff(np.asarray(fps.offsets)))
    salt = mix(np.arange(1, len(fps) + 1, dtype=np.uint64))
    hit = np.isin(low ^ salt[row], listed ^ salt[owner])
    return words, hashes, start[hit], row[hit]


def window_rows(found: DataFrame, window: int, gram: int) -> DataFrame:
    """From (cid, weight, text, fps): a row per candidate window: hash, check, cid, start, weight."""
    source = found.select("cid", "weight", "text", "fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, weight = (np.asarray(batch.column(k)) for k in (0, 1))
            for i, j, texts in slices(batch.column(2)):
                fps = pa.concat_arrays([batch.column(3).slice(i, j - i)])
                words, hashes, start, row = _candidates(texts, fps, window, gram)
                one, at = words.windows(hashes, window)
                two, _ = words.windows(hashes, window, salt=1)
                k = np.searchsorted(at, start)
                yield pa.RecordBatch.from_arrays([pa.array(one[k].view(np.int64)), pa.array((two[k] >> np.uint64(32)).astype(np.int64).astype(np.int32)), pa.array(cid[i:j][row]), pa.array((start - words.rows[row]).astype(np.int32)), pa.array(weight[i:j][row])], names=["hash", "check", "cid", "start", "weight"])

    return source.mapInArrow(run, "hash long, check int, cid long, start int, weight int")


def remove(found: DataFrame, window: int, gram: int) -> DataFrame:
    """From (sequence, text, fps, single): sequence, n_removed, kept_sha256, kept; single lists the candidate windows that stay."""
    source = found.select("sequence", "text", "fps", "single")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in slices(batch.column(1)):
                fps = pa.concat_arrays([batch.column(2).slice(i, j - i)])
                words, _, start, row = _candidates(texts, fps, window, gram)
                single = pa.concat_arrays([batch.column(3).slice(i, j - i)])
                own = np.asarray(single.flatten()).astype(np.int64) + np.repeat(words.rows[:-1], np.diff(np.asarray(single.offsets)))
                start = start[~np.isin(start, own)]
                change = np.zeros(len(words.starts) + 1, np.int64)
                np.add.at(change, start, 1)
                np.add.at(change, start + window, -1)
                gone = np.cumsum(change[:-1]) > 0
                removed, digests, kept = [], [], []
                data = texts.data.tobytes()
                for r in range(j - i):
                    a, b = words.rows[r], words.rows[r + 1]
                    rest = b" ".join(w for w, g in zip(data[texts.offsets[r] : texts.offsets[r + 1]].split(), gone[a:b].tolist(), strict=True) if not g)
                    removed.append(int(gone[a:b].sum()))
                    digests.append(hashlib.sha256(rest).hexdigest())
                    kept.append(rest)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(removed, pa.int64()), pa.array(digests), pa.array(kept, pa.binary()).cast(pa.string())], names=["sequence", "n_removed", "kept_sha256", "kept"])

    return source.mapInArrow(run, "sequence string, n_removed long, kept_sha256 string, kept string")


def removal(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256; with_text adds kept for the rows that lost words but not all."""
    spark = docs.sparkSession
    rows = stored(scan(docs, window, gram, doc_id, text), "scan")
    # one row for each word sequence; copies weigh two
    different = rows.filter(F.col("n_words") >= window).groupBy("sequence").agg(F.min(F.struct("key", "fps")).alias("first"), F.count("*").alias("n"))
    different = stored(different.select("sequence", "first.key", "first.fps", F.least("n", F.lit(2)).cast("int").alias("weight"), F.monotonically_increasing_id().alias("cid")), "different")

    log, hits = FingerprintLog(spark), None
    for b in range(batches):
        batch = different.filter(F.pmod(F.xxhash64("sequence"), F.lit(batches)) == b).select(F.explode("fps").alias("fp"), F.col("weight").cast("long").alias("n"))
        new = log.add(batch)
        hits = new if hits is None else hits.unionByName(new)
    log.drop()
    repeated = hits.distinct()

    near = different.select("cid", F.explode("fps").alias("fp")).join(repeated, "fp").groupBy("cid").agg(F.collect_set("fp").alias("fps"))
    near = stored(different.select("cid", "key", "sequence", "weight").join(near, "cid"), "near")
    # of rows that repeat a doc_id and text, one is enough
    texts = docs.select(_key(doc_id, text).alias("key"), F.col(text).alias("text")).join(near, "key").dropDuplicates(["key"])
    texts = stored(texts.select("cid", "sequence", "weight", "text", "fps"), "texts")

    once = window_rows(texts, window, gram).groupBy("hash", "check").agg(F.sum("weight").alias("n"), F.min("cid").alias("cid"), F.min("start").alias("start")).filter("n = 1")
    single = once.groupBy("cid").agg(F.collect_list("start").alias("single"))
    held = texts.filter("weight = 1").join(single, "cid", "left").withColumn("single", F.coalesce("single", F.array().cast("array<int>")))
    done = remove(held, window, gram)

    empty = hashlib.sha256(b"").hexdigest()
    copies = different.filter("weight > 1").select("sequence", F.lit(True).alias("copied"))
    changed = (done if with_text else done.drop("kept")).withColumn("copied", F.lit(False)).unionByName(copies, allowMissingColumns=True)
    out = rows.select("doc_id", "n_words", "sequence").join(changed, "sequence", "left")
    gone = F.coalesce(F.col("copied"), F.lit(False))
    out = out.withColumns({"n_removed": F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))), "kept_sha256": F.when(gone, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "sequence"))})
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", *["kept"] * with_text)
