"""Alignment of two tokenizers' tokens over the same bytes, and corpus-wide counts of aligned ids.

A is a byte-level BPE, B a sentencepiece model with byte fallback that puts a space before a text.
A batch of documents is laid end to end: ends of tokens are running sums of their lengths in bytes,
offsets where both have an end cut tokens into groups, and each token finds its group by binary
search. All A-B pairs of a group are links; they are expanded by repetition, a block of groups at a
time, and counted by document as they come. Groups of over WIDE links are counted by their distinct
ids first, so a text without common cuts takes room for the pairs of ids it holds, not for links.

Each document's pairs are stored once. A pair's count, the number of documents that hold it, comes
from a two-stage sum, salted by partition, so that a pair that every document holds meets in SALTS
parts first. Counts go back to documents by a broadcast of the commonest BROADCAST_PAIRS at most;
rarer pairs, if any, are joined by shuffle, where no key is hot.

Texts that are null, empty, or whose tokens don't spell the text with a space before it have no
tokens: zeros, and the empty string for the digest. Repeated rows count as documents of their own.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .bpe import byte_characters
from .tables import stored
from .words import releasing

#: Bytes of text that are aligned at a time, or one longer text; links that are expanded at a time; links from which a group is counted by ids.
SLICE_BYTES, BLOCK, WIDE = 1 << 19, 1 << 21, 1 << 16
#: Parts in which a pair is counted first, and pairs that are broadcast at most (24 bytes each).
SALTS, BROADCAST_PAIRS = 16, 1_000_000
#: Texts of these characters alone split alike under all Unicode versions and white-space classes in use.
PLAIN = re.compile(r"[\t\n\r\x20-\x7E\xA0-ɏͰ-ͳΑ-ΡΣ-ϿЀ-ҁҊ-ԯ‐-‧‰-⁞€一-龥]*\Z")
#: The split of byte-level BPE before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Vocabulary:
    """Bytes of each id, as one buffer with starts and lengths."""

    def __init__(self, tokens: list[bytes]):
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        n = self.lengths[ids]
        first = np.cumsum(n) - n
        return self.data[np.repeat(self.starts[ids] - first, n) + np.arange(int(n.sum()))]


class ByteLevel:
    """A byte-level BPE of a tokenizers file; special tokens are plain text.

    Merges are in the order of ids, so the ranks of tokens are their ids and tiktoken's merging gives
    the same ids (each token is what its own bytes merge to). It takes texts of PLAIN characters; for
    others the two libraries' classes may differ, and the file's own library is asked.
    """

    def __init__(self, path: str):
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        special = {t["id"] for t in spec["added_tokens"] if t["special"]}
        back = {c: b for b, c in enumerate(byte_characters())}
        ranks = {bytes(map(back.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if i not in special}
        size = 1 + max(*ranks.values(), *special)
        tokens = [b""] * size
        for t, i in ranks.items():
            tokens[i] = t
        self.path, self.vocabulary, self._own = path, Vocabulary(tokens), None
        self._fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        found = [self._fast(t, disallowed_special=()) if PLAIN.match(t) else np.array(self._slow(t), np.uint32) for t in texts]
        return np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int64), np.array([len(x) for x in found], np.int64)

    def _slow(self, text: str) -> list[int]:
        if self._own is None:
            from tokenizers import Tokenizer

            self._own = Tokenizer.from_file(self.path)
            self._own.encode_special_tokens = True
        return self._own.encode(text, add_special_tokens=False).ids


class Pieces:
    """A sentencepiece BPE with byte fallback. A word's pieces don't depend on its neighbours where single spaces part words.

    No piece has a space after another character (else whole texts are encoded), so words are encoded
    once and looked up; texts with other runs of spaces go to the model whole.
    """

    CACHE = 150_000

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        byte = re.compile(r"<0x([0-9A-F]{2})>")
        self.vocabulary = Vocabulary([bytes([int(m[1], 16)]) if self.model.is_byte(i) and (m := byte.fullmatch(n)) else n.replace("▁", " ").encode() for i, n in enumerate(names)])
        self.begins = np.array([n.startswith("▁") for n in names])
        self.apart = not any("▁" in n.lstrip("▁") for n in names)
        self.known: dict[str, list[int]] = {}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        by_word = [self.apart and "  " not in t and t[:1] != " " and t[-1:] != " " and "▁" not in t for t in texts]
        words = [t.split(" ") if ok else [] for t, ok in zip(texts, by_word, strict=True)]
        if len(self.known) > self.CACHE:
            self.known = {}
        known = self.known
        new = list({w for ws in words for w in ws}.difference(known))
        if new:
            ids = self.model.encode(" ".join(new))
            at = np.flatnonzero(self.begins[np.array(ids, np.int64)]).tolist()
            if len(at) != len(new):
                raise ValueError("words and their pieces don't match")
            known.update(zip(new, map(ids.__getitem__, map(slice, at, [*at[1:], len(ids)])), strict=True))
        parts = [list(chain.from_iterable(map(known.__getitem__, ws))) if ok else self.model.encode(t) for t, ok, ws in zip(texts, by_word, words, strict=True)]
        counts = np.array([len(x) for x in parts], np.int64)
        return np.fromiter(chain.from_iterable(parts), np.int64, int(counts.sum())), counts


@cache
def _tools(a_path: str, b_path: str) -> tuple[ByteLevel, Pieces, np.ndarray]:
    a, b = ByteLevel(a_path), Pieces(b_path)
    texts = [f"{i}{end}" for v, two in ((a, ",|"), (b, ",;")) for i in range(len(v.vocabulary.lengths)) for end in two]
    return a, b, np.array(texts, object)


def _spelled(vocabulary: Vocabulary, ids: np.ndarray, counts: np.ndarray, wanted: list[bytes]) -> np.ndarray:
    """Whether each text's ids spell it."""
    upto = np.concatenate([[0], np.cumsum(vocabulary.lengths[ids])])
    at = np.concatenate([[0], np.cumsum(counts)])
    ok = np.diff(upto[at]) == np.array([len(w) for w in wanted], np.int64)
    if not ok.all():
        return np.array([o and vocabulary.spell(ids[at[i] : at[i + 1]]).tobytes() == w for i, (o, w) in enumerate(zip(ok, wanted, strict=True))])
    wrong = np.flatnonzero(vocabulary.spell(ids) != np.frombuffer(b"".join(wanted), np.uint8))
    ok[np.searchsorted(upto[at], wrong, side="right") - 1] = False
    return ok


class Aligned:
    """Documents' tokens laid end to end; group g has na[g] A tokens and nb[g] B tokens."""

    def __init__(self, ids_a: np.ndarray, ids_b: np.ndarray, lengths_a: np.ndarray, lengths_b: np.ndarray, bytes_of: np.ndarray):
        self.a, self.b = ids_a, ids_b
        ends_a, ends_b = np.cumsum(lengths_a), np.cumsum(lengths_b)
        self.cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        self.group_a, self.group_b = np.searchsorted(self.cuts, ends_a), np.searchsorted(self.cuts, ends_b)
        n = len(self.cuts)
        self.na, self.nb = np.bincount(self.group_a, minlength=n), np.bincount(self.group_b, minlength=n)
        #: The document of each group.
        self.doc = np.searchsorted(np.cumsum(bytes_of), self.cuts)

    def pairs(self, n_docs: int, radix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents, pairs, times) by document and pair; a pair is id A times radix plus id B."""
        first_a, first_b = np.cumsum(self.na) - self.na, np.cumsum(self.nb) - self.nb
        links = self.na * self.nb
        span = radix * (1 + int(self.a.max(initial=0)))
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        narrow = np.flatnonzero(links <= WIDE)
        for part in np.split(narrow, np.flatnonzero(np.diff(np.cumsum(links[narrow]) // BLOCK)) + 1):
            # each A token is repeated for its group's B tokens, which follow one another
            per = np.repeat(self.nb[part], self.na[part])
            n = int(links[part].sum())
            token_a = np.repeat(first_a[part] - np.cumsum(self.na[part]) + self.na[part], self.na[part]) + np.arange(len(per))
            starts = np.repeat(np.repeat(first_b[part], self.na[part]) - np.cumsum(per) + per, per)
            keys = np.repeat(np.repeat(self.doc[part], self.na[part]) * span + self.a[token_a] * radix, per) + self.b[starts + np.arange(n)]
            held.append(np.unique(keys, return_counts=True))
        for g in np.flatnonzero(links > WIDE):
            ua, ca = np.unique(self.a[first_a[g] : first_a[g] + self.na[g]], return_counts=True)
            ub, cb = np.unique(self.b[first_b[g] : first_b[g] + self.nb[g]], return_counts=True)
            held.append(((self.doc[g] * span + ua[:, None] * radix + ub[None, :]).ravel(), (ca[:, None] * cb[None, :]).ravel()))
        keys, times = (np.concatenate(x) for x in zip(*held, strict=True))
        if len(held) > 2:
            keys, place = np.unique(keys, return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, place, times)
            times = sums
        return keys // span, keys % span, times

    def written(self, names: np.ndarray, size_a: int) -> tuple[np.ndarray, np.ndarray]:
        """Texts of the tokens in the order of groups, A's before B's, and how many there are upto each group."""
        order = np.empty(len(self.a) + len(self.b), np.int64)
        upto_a, upto_b = np.cumsum(self.na), np.cumsum(self.nb)
        at_a = np.arange(len(self.a)) + np.repeat(upto_b - self.nb, self.na)
        at_b = np.arange(len(self.b)) + np.repeat(upto_a, self.nb)
        last_a, last_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        last_a[upto_a - 1], last_b[upto_b - 1] = 1, 1
        order[at_a], order[at_b] = 2 * self.a + last_a, 2 * (size_a + self.b) + last_b
        return names[order], upto_a + upto_b


SCHEMA = StructType([StructField(n, LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")] + [StructField("groups_sha256", StringType()), StructField("pairs", ArrayType(LongType())), StructField("times", ArrayType(LongType()))])


def _align(texts: list[str | None], a_path: str, b_path: str) -> list[pa.Array]:
    """Columns of SCHEMA for some texts."""
    a, b, names = _tools(a_path, b_path)
    radix = len(b.vocabulary.lengths)
    n = len(texts)
    rows = [i for i, t in enumerate(texts) if t]
    wanted = [b" " + texts[i].encode() for i in rows]
    (ids_a, n_a), (ids_b, n_b) = a.encode([" " + texts[i] for i in rows]), b.encode([texts[i] for i in rows])
    if rows:
        ok = _spelled(a.vocabulary, ids_a, n_a, wanted) & _spelled(b.vocabulary, ids_b, n_b, wanted)
        if not ok.all():
            ids_a, ids_b, n_a, n_b = ids_a[np.repeat(ok, n_a)], ids_b[np.repeat(ok, n_b)], n_a[ok], n_b[ok]
            rows, wanted = ([x[i] for i in np.flatnonzero(ok)] for x in (rows, wanted))
    counts = np.zeros((4, n), np.int64)
    digests = [""] * n
    at = np.array(rows, np.int64)
    found = Aligned(ids_a, ids_b, a.vocabulary.lengths[ids_a], b.vocabulary.lengths[ids_b], np.array([len(w) for w in wanted], np.int64))
    groups = np.bincount(found.doc, minlength=len(rows))
    links = np.zeros(len(rows), np.int64)
    np.add.at(links, found.doc, found.na * found.nb)
    counts[:, at] = n_a, n_b, groups, links
    shown, upto = found.written(names, len(a.vocabulary.lengths))
    last = np.cumsum(groups) - 1
    begin = 0
    for row, end in zip(rows, upto[last].tolist() if rows else [], strict=True):
        digests[row] = hashlib.sha256("".join(shown[begin:end].tolist())[:-1].encode()).hexdigest()
        begin = end
    docs, pairs, times = found.pairs(len(rows), radix)
    offsets = pa.array(np.cumsum(np.bincount(at[docs] + 1, minlength=n + 1)), pa.int32())
    return [*(pa.array(c) for c in counts), pa.array(digests), pa.ListArray.from_arrays(offsets, pa.array(pairs)), pa.ListArray.from_arrays(offsets, pa.array(times))]


def linked(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, row (a number of its own), n_a, n_b, n_groups, n_links, groups_sha256, pairs and times (each pair's links in the document).

    The paths are read where tasks run, as every machine has the vocabularies' package.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    schema = StructType([*source.schema.fields[:2], *SCHEMA.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy()
            begin = 0
            while begin < batch.num_rows:
                end = max(begin + 1, begin + int(np.searchsorted(np.cumsum(sizes[begin:], dtype=np.int64), SLICE_BYTES, side="right")))
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *_align(part.column(2).to_pylist(), a_path, b_path)], names=schema.names)
                begin = end

    return source.mapInArrow(releasing(run), schema)


def pair_counts(links: DataFrame, radix: int) -> DataFrame:
    """(pair, count, best): documents that hold a pair, and whether no pair of its A id has a higher count."""
    held = links.select((F.spark_partition_id() % SALTS).alias("salt"), F.explode("pairs").alias("pair"))
    counts = stored(held.groupBy("pair", "salt").agg(F.count("*").alias("n")).groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    a = F.expr(f"pair div {radix}")
    top = counts.groupBy(a.alias("a")).agg(F.max("count").alias("top"))
    return counts.withColumn("a", a).join(top, "a").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", most: int = BROADCAST_PAIRS) -> DataFrame:
    """A row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    links = stored(linked(docs, a_path, b_path, doc_id, text), "links", "zstd")
    counts = stored(pair_counts(links, len(_tools(a_path, b_path)[1].vocabulary.lengths)), "pairs")
    single = links.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    common = counts
    if counts.count() > most:
        # the highest counts, as far as `most` pairs have them; the window sees a row for each count that occurs
        upto = counts.groupBy("count").agg(F.count("*").alias("n")).select("count", F.sum("n").over(Window.orderBy(F.desc("count"))).alias("upto"))
        least = F.lit(upto.filter(F.col("upto") <= most).agg(F.min("count")).first()[0]).cast("long")
        frequent = F.coalesce(F.col("count") >= least, F.lit(False))
        common, rare = counts.filter(frequent), counts.filter(~frequent)
    partial = lambda rows: rows.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    if common is counts:
        sums = partial(single.join(F.broadcast(common), "pair"))
    else:
        met = single.join(F.broadcast(common), "pair", "left")
        both = partial(met.filter("count is not null")).unionByName(partial(met.filter("count is null").select("row", "pair", "times").join(rare, "pair")))
        sums = both.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return links.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
