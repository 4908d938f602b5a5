"""N-gram Jaccard join: size-banded tiles, parity bitmaps, exact sorted-array intersection.

A document's set is its different K-word shingles (64-bit hashes; A-Z in lower case); with fewer
words the whole sequence is the one shingle, without words the set is empty and links nothing.
Sets link when 100 * intersection >= PERCENT * union. Equal sets are one class from the start.

Candidates: in one order of all shingles, two linked sets share at least l of the first
n - ceil(PERCENT n / 100) + l, where l is EXTRA percent of the smaller n. So a set goes on only if
that many of its first shingles are in other sets, too. The order puts frequent shingles last, as seen in a bounded sample
of documents (SAMPLE_ROWS); it decides only how many candidates there are, never which links are
found. Sets that share such a shingle form a tile, cut into bands of sizes that can link at all.
Signatures: bit j tells whether the set has an odd number of shingles that hash to j, so two
signatures differ in no more bits than the sets do in shingles, and the count of differing bits
bounds the overlap from above. What passes is intersected exactly.

First, tiles of each set's first shared shingle are linked in place, where sets that are joined
already aren't compared again. Then, ROUNDS times, all tiles give the nearest pairs that would join
what is still apart, no more than a tree of them; and last, what has any partner left by its
signature is compared in place. Tiles above a bounded size are dealt out in blocks and pairs of
blocks. So no step puts out the pairs of a group, and no link is lost. Texts are read again for the
sets of candidates only, found by a bit table of fixed size.

Null texts count as empty. Rows of a null doc_id take part; component_id is the smallest doc_id
that is not null. Rows that repeat are copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .tables import release, sampled, stored, without
from .words import SPACED, Texts, mix, releasing, slices

K, PERCENT, EXTRA = 5, 80, 5
#: Documents, and bytes, looked at for the order of shingles, and the share of them from which one is frequent.
SAMPLE_ROWS, SAMPLE_BYTES, FREQUENT = 2000, 32 << 20, 0.004
#: Shingles of a tile that one task holds, sets of a block, and bits of the table of candidates.
TILE_SHINGLES, BLOCK, TABLE_BITS = 4_000_000, 4096, 24
#: Rounds of nearest pairs before the last, exhaustive one.
ROUNDS = 2
_U = np.uint64


def shingle_sets(texts: Texts, k: int = K) -> list[np.ndarray]:
    """Each row's sorted different shingle hashes."""
    words = texts.lower().words(SPACED)
    hashes = words.hashes()
    value, at = words.windows(hashes, k)
    row = np.searchsorted(words.rows, at, side="right") - 1
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    own = np.ones(len(value), bool)
    own[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[own], row[own]
    ends = np.searchsorted(row, np.arange(len(texts) + 1))
    out = [value[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    for r in np.flatnonzero((words.counts() > 0) & (words.counts() < k)).tolist():
        part = hashes[words.rows[r] : words.rows[r + 1]]
        out[r] = mix(np.array([np.bitwise_xor.reduce(mix(part + np.arange(1, len(part) + 1, dtype=np.uint64) * _U(0x2545F491)))], np.uint64) + _U(len(part)))
    return out


def signature(values: np.ndarray) -> bytes:
    """Parity bits of the hashes, one to two a shingle, a power of two from 64 up."""
    bits = 1 << max(6, int(len(values) - 1).bit_length())
    place = (mix(values ^ _U(0x7F4A7C15)) & _U(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=bits).astype(np.uint8) & 1).tobytes()


def fold(sig: np.ndarray, words: int) -> np.ndarray:
    """Signatures (rows of 64-bit words) with fewer bits: halves are the parity of both."""
    while sig.shape[-1] > words:
        half = sig.shape[-1] // 2
        sig = sig[..., :half] ^ sig[..., half:]
    return sig


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """The exact test on sorted arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def least_size(n, percent: int = PERCENT):
    """The smallest size that can link with size n (n an int or array)."""
    return -(-percent * n // 100)


def most_apart(total, percent: int = PERCENT):
    """The most shingles that two linked sets of `total` together can differ in."""
    return (100 - percent) * total // (100 + percent)


def frequent(docs: DataFrame, k: int, doc_id: str, text: str) -> np.ndarray:
    """Sorted shingles that at least FREQUENT of a sample's documents have, of different sets; bounded by the sample."""
    rows = sampled(docs, text, SAMPLE_ROWS, SAMPLE_BYTES, doc_id)
    sets = {s.tobytes(): s for _, _, t in slices(pa.array(rows, pa.large_string())) for s in shingle_sets(t, k)}
    if not sets:
        return np.zeros(0, np.uint64)
    value, n = np.unique(np.concatenate(list(sets.values())), return_counts=True)
    return value[n >= max(3, FREQUENT * len(rows))]


def _key(doc_id: str, text: str):
    return F.unhex(F.md5(F.concat_ws("\x00", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.coalesce(F.col(text), F.lit("")))))


def scan(docs: DataFrame, late: np.ndarray, k: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """Per row: doc_id, key, n, set (16 bytes that name the set), prefix (candidate shingles in order)."""
    source = docs.select(F.col(doc_id).alias("doc_id"), _key(doc_id, text).alias("key"), F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in slices(batch.column(2)):
                sets = shingle_sets(texts, k)
                names, prefix = [], []
                for s in sets:
                    names.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    n = len(s)
                    if n and len(late):
                        at = np.minimum(np.searchsorted(late, s), len(late) - 1)
                        hot = late[at] == s
                        order = np.concatenate([s[~hot], s[hot]]) if hot.any() else s
                    else:
                        order = s
                    prefix.append(order[: n - least_size(n, percent) + -(-EXTRA * n // 100)].view(np.int64))
                ends = np.cumsum([0] + [len(p) for p in prefix]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), lists], names=["doc_id", "key", "n", "set", "prefix"])

    return source.mapInArrow(releasing(run), f"doc_id {dict(source.dtypes)['doc_id']}, key binary, n long, set binary, prefix array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    """(cid, values, sig) for the rows of docs that wanted (cid, key) names: read again, screened by a bit table of fixed size."""
    bit = F.shiftrightunsigned(F.xxhash64("key"), 64 - TABLE_BITS)
    words = wanted.groupBy(F.shiftright(bit, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(key), {64 - TABLE_BITS}) & 63 as int))")).alias("v"))
    held = np.zeros(1 << TABLE_BITS - 6, np.int64)
    for w, v in words.collect():  # 2**18 rows at most
        held[w] = v
    source = docs.select(_key(doc_id, text).alias("key"), F.col(text).alias("__text")).withColumn("bit", bit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.asarray(batch.column(2))
            part = batch.filter(pa.array((held[place >> 6] >> (place & 63)) & 1 == 1))
            for i, j, texts in slices(part.column(1)):
                sets = shingle_sets(texts, k)
                ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64))), pa.array([signature(v) for v in sets], pa.binary())], names=["key", "values", "sig"])

    found = source.mapInArrow(releasing(run), "key binary, values array<long>, sig binary")
    return found.join(wanted, "key").dropDuplicates(["key"]).select("cid", "values", "sig")


def _signatures(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def link_tile(cid: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT, joined: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (smallest cid of each part, other cid) of a tile's connected parts; sets already joined (of equal `joined`) aren't compared."""
    order = np.lexsort((cid, [len(s) for s in sets]))
    cid, sets = cid[order], [sets[i] for i in order]
    n = np.array([len(s) for s in sets])
    sigs = [np.frombuffer(signature(s), np.uint64) for s in sets]
    widths = np.array([len(s) for s in sigs])
    part = np.arange(len(cid)) if joined is None else np.unique(joined[order], return_inverse=True)[1]
    by_width: dict[int, np.ndarray] = {}
    for j in range(1, len(cid)):
        low = int(np.searchsorted(n[:j], least_size(int(n[j]), percent)))
        if low == j:
            continue
        width = int(widths[low])
        if width not in by_width:
            lo = int(np.searchsorted(widths, width))
            by_width[width] = np.stack([np.zeros(width, np.uint64)] * lo + [fold(s, width) for s in sigs[lo:]])
        table = by_width[width]
        apart = np.bitwise_count(table[low:j] ^ table[j]).sum(1)
        near = low + np.flatnonzero(apart <= most_apart(n[low:j] + n[j], percent))
        near = near[np.argsort(apart[near - low], kind="stable")]
        while len(near):
            near = near[part[near] != part[j]]
            if not len(near):
                break
            if linked(sets[near[0]], sets[j], percent):
                part[part == part[j]] = part[near[0]]
            near = near[1:]
    first = np.full(int(part.max(initial=0)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, part, cid)
    low = first[part]
    return low[low != cid], cid[low != cid]


def tile_pairs(cid: np.ndarray, part: np.ndarray, n: np.ndarray, sigs: list[np.ndarray], guest: np.ndarray, side: np.ndarray | None, percent: int = PERCENT) -> tuple[list[tuple[int, int]], np.ndarray]:
    """What sizes and signatures let pass between different parts of a banded tile: nearest pairs that would join the
    parts, at most one fewer than there are parts; and the cids of all sets that have any such partner."""
    order = np.lexsort((cid, n))
    cid, n, guest, sigs = cid[order], n[order], guest[order], [sigs[i] for i in order]
    part = np.unique(part[order], return_inverse=True)[1]
    side = side[order] if side is not None else None
    width = min(len(s) for s in sigs)
    table = np.stack([fold(s, width) for s in sigs])
    tree, pairs, met = np.arange(int(part.max()) + 1), [], np.zeros(len(cid), bool)
    for j in range(1, len(cid)):
        low = int(np.searchsorted(n[:j], least_size(int(n[j]), percent)))
        ok = (part[low:j] != part[j]) & ~(guest[low:j] & guest[j])
        if side is not None:
            ok &= side[low:j] != side[j]
        at = low + np.flatnonzero(ok)
        if not len(at):
            continue
        apart = np.bitwise_count(table[at] ^ table[j]).sum(1)
        pass_ = apart <= most_apart(n[at] + n[j], percent)
        at, apart = at[pass_], apart[pass_]
        if len(at):
            met[at] = met[j] = True
            at = at[np.argsort(apart, kind="stable")]
            while len(at := at[tree[part[at]] != tree[part[j]]]):
                pairs.append((int(min(cid[at[0]], cid[j])), int(max(cid[at[0]], cid[j]))))
                tree[tree == tree[part[j]]] = tree[part[at[0]]]
    return pairs, cid[met]


def _tile_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links within (token, chunk) tiles of rows (token, cid, n)."""
    total = rows.groupBy("token").agg(F.sum("n").alias("total"), F.count("*").alias("m")).filter("m > 1")
    dealt = rows.join(total, "token").withColumn("chunk", F.pmod(F.xxhash64("cid"), F.ceil(F.col("total") / TILE_SHINGLES)))
    dealt = dealt.select("token", "chunk", "cid").join(sets.select("cid", "values"), "cid").select("token", "chunk", "cid", "values")

    def run(tile: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return link_tile(np.asarray(tile.column(2)), _sets(tile.column(3)), percent)

    return _by_tile(dealt, 2, run).distinct()


def _sets(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.flatten().to_numpy().view(np.uint64), np.asarray(column.offsets) - column.offsets[0].as_py()
    return [flat[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]


def _tiles(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The runs of rows that are alike in the first `keys` columns; one run is held in memory."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        own = np.stack([np.asarray(batch.column(k)) for k in range(keys)])
        if held and any(held[-1].column(k)[-1].as_py() != own[k, 0] for k in range(keys)):
            yield pa.concat_batches(held)
            held = []
        cuts = [0, *(np.flatnonzero((own[:, 1:] != own[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.concat_batches(held) if len(held) > 1 else held[0]
                held = []
    if held:
        yield pa.concat_batches(held)


def _by_tile(rows: DataFrame, keys: int, work: Callable[[pa.RecordBatch], tuple[np.ndarray, ...]], names: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """work's long columns for each tile, that is, rows alike in the first `keys` columns, brought together and sorted by them.

    Tiles are cut from a stream of batches, so that small ones cost little.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for tile in _tiles(batches, keys):
            if len((got := work(tile))[0]):
                out.append(got)
                size += len(got[0])
            if size > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], names=list(names))
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], names=list(names))

    by = rows.columns[:keys]
    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(releasing(run), ", ".join(f"{n} long" for n in names))


def _mixed(tiles: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows (token, band, p, q, block, cid, n, part, guest, sig) of the tiles that still hold different parts, in bands and blocks."""
    rows = tiles.join(labels.withColumnRenamed("id", "cid"), "cid", "left").select("token", "cid", "n", F.coalesce("component", "cid").alias("part"))
    # shingles with the very same sets give the same tile, told by two hashes of its members; one of them is enough
    hashes = [F.bit_xor(F.xxhash64(F.lit(i), "cid")).alias(f"h{i}") for i in (0, 1)]
    mixed = rows.groupBy("token").agg(F.min("part").alias("x"), F.max("part").alias("y"), F.count("*").alias("m"), *hashes).filter("x < y")
    mixed = mixed.groupBy("m", "h0", "h1").agg(F.min("token").alias("token")).select("token")
    rows = stored(rows.join(mixed, "token"), "mixed")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9)
    banded = rows.withColumn("own", band).select("token", "cid", "n", "part", "own", F.explode(F.array("own", F.col("own") + 1)).alias("band")).withColumn("guest", F.col("own") != F.col("band"))
    sizes = banded.groupBy("token", "band").agg(F.count("*").alias("m"), F.sum("n").alias("total"), F.min("part").alias("x"), F.max("part").alias("y"), F.min("guest").alias("g")).filter("x < y and not g")
    # a tile of m rows is dealt out in blocks of 8 sqrt(m), within bounds: small enough to share a middling one out, large enough not to copy a large one too often
    size = F.least(F.lit(float(BLOCK)), F.greatest(F.lit(256.0), 8 * F.sqrt(F.col("m").cast("double"))))
    blocks = F.greatest(F.ceil(F.col("m") / size), F.ceil(F.col("total") / (TILE_SHINGLES // 2)))
    dealt = banded.join(sizes.select("token", "band", blocks.alias("blocks")), ["token", "band"]).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("token", "band", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "cid", "n", "part", "guest")
    return dealt.join(sets.select("cid", "sig"), "cid").select("token", "band", "p", "q", "block", "cid", "n", "part", "guest", "sig")


def _passed(tile: pa.RecordBatch, percent: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    block, cid, n, part, guest = (tile.column(k).to_numpy(zero_copy_only=False) for k in range(4, 9))
    return tile_pairs(cid, part, n, _signatures(tile.column(9)), guest, None if (block == block[0]).all() else block, percent)


def _tree_pairs(mixed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that would join each tile's parts."""

    def run(tile: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        pairs = np.array(_passed(tile, percent)[0], np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]

    return _by_tile(mixed, 4, run).distinct()


def _last_links(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All that is left to link: the sets of a tile with any partner by signature, compared exactly in place."""

    def screen(tile: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        met = _passed(tile, percent)[1]
        if not len(met):
            return (met,)
        keep = np.isin(np.asarray(tile.column(5)), met)
        return tuple(np.asarray(tile.column(k))[keep] for k in (0, 1, 2, 3, 5, 7))

    def link(tile: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return link_tile(np.asarray(tile.column(4)), _sets(tile.column(6)), percent, np.asarray(tile.column(5)))

    left = stored(_by_tile(mixed, 4, screen, ("token", "band", "p", "q", "cid", "part")), "left")
    return _by_tile(left.join(sets.select("cid", "values"), "cid").select("token", "band", "p", "q", "cid", "part", "values"), 4, link).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that link, by exact intersection of the sorted arrays."""
    left = sets.select(F.col("cid").alias("a"), F.col("values").alias("u"))
    right = sets.select(F.col("cid").alias("b"), F.col("values").alias("v"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "u", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [linked(u.values.to_numpy().view(np.uint64), v.values.to_numpy().view(np.uint64), percent) for u, v in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(releasing(run), "a long, b long")


def jaccard_components(docs: DataFrame, k: int = K, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    late = frequent(docs, k, doc_id, text)
    rows = stored(scan(docs, late, k, percent, doc_id, text), "scan")
    classes = rows.filter("n > 0").groupBy("set").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.min("doc_id").alias("least"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    # of rows that repeat a doc_id and text, all have the same prefix
    prefix = rows.select("key", "prefix").join(classes.select("key", "cid"), "key").select("cid", F.posexplode("prefix").alias("rank", "token"))
    tiles = prefix.withColumn("m", F.count("*").over(Window.partitionBy("token"))).filter("m > 1").select("token", "cid", "rank").distinct()
    tiles = stored(tiles.join(classes.select("cid", "n"), "cid"), "tiles")
    release(spark)
    # a partner has percent of the shingles at least, so of its share of EXTRA
    enough = tiles.groupBy("cid", "n").agg(F.count("*").alias("m")).filter(F.col("m") * 10_000 >= F.col("n") * EXTRA * percent).select("cid")
    enough = stored(enough, "enough")
    tiles = tiles.join(enough, "cid")

    sets = stored(sets_of(docs, classes.select("cid", "key").join(enough, "cid"), k, doc_id, text), "sets")
    close = tiles.withColumn("nth", F.row_number().over(Window.partitionBy("cid").orderBy("rank", "token"))).filter("nth = 1")
    edges = stored(_tile_links(close, sets, percent), "edges")
    release(spark)
    labels = components(edges)

    for last in (False,) * ROUNDS + (True,):
        mixed = _mixed(tiles, labels, sets, percent)
        extra = _last_links(mixed, sets, percent) if last else _verified(_tree_pairs(mixed, percent), sets, percent)
        extra = stored(extra, "edges")
        release(spark)
        if not extra.isEmpty():
            # links between parts, on top of each part's own
            star = labels.select(F.col("id").alias("a"), F.col("component").alias("b"))
            labels = components(star.unionByName(extra))

    part = classes.select("cid", "set", "least").join(labels.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    named = part.groupBy("component").agg(F.min("least").alias("component_id"))
    named = part.select("set", "component").join(named, "component").select("set", "component_id")
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "set").join(named, "set", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_linked(docs: DataFrame, k: int = K, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component, that of the smallest doc_id; columns as they are.

    Rows of a null doc_id stay: they have no smallest doc_id to be dropped for.
    """
    found = jaccard_components(docs, k, percent, doc_id, text)
    return without(docs, found.filter("component_id < doc_id").select("doc_id"), doc_id)
