"""Exact nearest vectors by an inverted file whose cells are left out where a bound shows that they can't matter.

Centroids are fitted on a bounded sample; they decide speed, never results. Every vector goes to its
nearest centroid's cell, and within it to a ring by its distance from the centroid's axis. With t the
share of a query along the axis, no vector of a ring scores more than along * t + across * |rest of
the query|. A query scores the rings of highest bounds until they hold enough vectors, which gives a
least score for its k-th place; then all other rings whose bound reaches that. Rings are cut into
blocks of BLOCK vectors, a ring's queries into blocks of ASKED, and a task scores one by the other as
a matrix product: no group is larger than that, however many vectors or queries share a ring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .retrieval import clusters, small, top_k

#: Vectors that centroids are fitted on, cells at most, rings of a cell, vectors and queries of a block.
SAMPLE, CELLS, RINGS, BLOCK, ASKED = 20_000, 1024, 16, 4096, 1024
#: What rounding of scores and of the bound can amount to for vectors of moderate length, as a share of the bound's scale.
SLACK = 1e-7


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as rows of doubles."""
    n = len(column)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


@dataclass
class Ivf:
    """vectors: key, embedding, cell, ring, part; rings: cell, ring, n, parts and bounds of each; axes: a unit vector for each cell."""

    vectors: DataFrame
    rings: DataFrame
    axes: np.ndarray
    key: str

    def search(self, queries: DataFrame, k: int, query_key: str = "query_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
        """(nearest, scored): query_key, key, score, rank of the k vectors of highest dot product, equal scores by key; and how many vectors each query scored.

        Queries are a stated set of any size; those without a vector give no rows.
        """
        asked = written(queries.filter(F.col(vector).isNotNull()).select(F.col(query_key).alias("q"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v")), "ivf-queries")
        first = written(self._chosen(asked.withColumn("least", F.lit(None).cast("double")), k, probe=True), "ivf-first")
        found = written(self._scored(asked, first, k), "ivf-found")
        # the k-th best so far; without k of them all rings are looked at
        least = found.groupBy("q").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        rest = self._chosen(asked.join(least, "q", "left"), k, probe=False).join(first, ["q", "cell", "ring"], "left_anti")
        rest = written(rest, "ivf-rest")
        both = found.unionByName(self._scored(asked, rest, k))
        best = top_k(both, "q", k, "key").select(F.col("q").alias(query_key), F.col("key").alias(self.key), "score", "rank")
        looked = first.unionByName(rest).join(F.broadcast(self.rings.select("cell", "ring", "n")), ["cell", "ring"]).groupBy(F.col("q").alias(query_key)).agg(F.sum("n").alias("n_scored"))
        return best, looked

    def _chosen(self, asked: DataFrame, k: int, probe: bool) -> DataFrame:
        """q, cell, ring: to be scored first (probe), or all whose bound reaches `least`."""
        rings = self.rings.orderBy("cell", "ring").toPandas()  # CELLS * RINGS rows at most
        cell, ring, n = rings["cell"].to_numpy(), rings["ring"].to_numpy(), rings["n"].to_numpy()
        low, high, across, axes = rings["low"].to_numpy(), rings["high"].to_numpy(), rings["across"].to_numpy(), self.axes
        kind = dict(asked.dtypes)["q"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows if len(n) else 0, 64):
                    part = batch.slice(at, 64)
                    q = _matrix(part.column(1))
                    along = q @ axes.T
                    rest = np.sqrt(np.maximum((q * q).sum(1, keepdims=True) - along * along, 0))
                    bound = np.maximum(along[:, cell] * low, along[:, cell] * high) + rest[:, cell] * across
                    if probe:
                        order = np.argsort(-bound, axis=1, kind="stable")
                        before = np.cumsum(n[order], axis=1) - n[order]
                        rows, places = np.nonzero(before < 2 * k)
                        places = order[rows, places]
                    else:
                        least = part.column(2).to_numpy(zero_copy_only=False).astype(float)
                        slack = SLACK * (1 + np.abs(bound))
                        rows, places = np.nonzero(~(bound + slack < np.where(np.isnan(least), -np.inf, least)[:, None]))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(cell[places], pa.int32()), pa.array(ring[places], pa.int32())], names=["q", "cell", "ring"])

        return asked.select("q", "v", "least").mapInArrow(run, f"q {kind}, cell int, ring int")

    def _scored(self, asked: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
        """q, key, score: of each pair (q, cell, ring) the k best of each of the ring's blocks."""
        # ring tables have CELLS * RINGS rows at most
        loads = pairs.groupBy("cell", "ring").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("sides"))
        sides = F.broadcast(loads)
        split = F.broadcast(self.rings.select("cell", "ring", "parts"))
        wanted = pairs.join(split, ["cell", "ring"]).join(sides, ["cell", "ring"]).withColumn("side", F.pmod(F.xxhash64("q"), F.col("sides")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        left = wanted.join(asked, "q").select("q", "v", "cell", "ring", "part", "side")
        right = self.vectors.join(sides, ["cell", "ring"]).withColumn("side", F.explode(F.sequence(F.lit(0), F.col("sides") - 1))).select("key", "embedding", "cell", "ring", "part", "side")
        kinds = dict(left.dtypes)["q"], dict(right.dtypes)["key"]

        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            qs, keys = a.column("q").combine_chunks(), b.column("key").combine_chunks()
            if not len(qs) or not len(keys):
                return pa.table({"q": qs.slice(0, 0), "key": keys.slice(0, 0), "score": pa.array([], pa.float64())})
            order = pc.sort_indices(keys)
            keys = keys.take(order)
            x = _matrix(b.column("embedding").combine_chunks().take(order))
            scores = _matrix(a.column("v").combine_chunks()) @ x.T
            # equal to nine digits: the smaller key, as keys are in order
            best = np.argsort(-np.round(scores, 9), axis=1, kind="stable")[:, :k]
            rows = np.repeat(np.arange(len(qs)), best.shape[1])
            return pa.table({"q": qs.take(pa.array(rows)), "key": keys.take(pa.array(best.ravel())), "score": pa.array(scores[rows, best.ravel()])})

        by = ["cell", "ring", "part", "side"]
        block = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, f"q {kinds[0]}, key {kinds[1]}, score double")
        nth = F.row_number().over(Window.partitionBy("q").orderBy(F.round("score", 9).desc(), "key"))
        return block.withColumn("nth", nth).filter(F.col("nth") <= k).drop("nth")


#: Vectors and queries of a block within a group, and queries whose scores are held at once.
GROUP_BLOCK, AT_ONCE = 4096, 256


def within_groups(vectors: DataFrame, queries: DataFrame, k: int, groups: tuple[DataFrame, DataFrame], key: str = "vec_id", query_key: str = "query_id", vector: str = "embedding") -> DataFrame:
    """query_key, key, score, rank of the k vectors of highest dot product among those that share a group with each query, equal scores by key.

    groups: (query_key, group) and (key, group). Pairs of a query and a vector are made nowhere but in
    a task, as matrix products of blocks; what leaves it is k rows a query and block. Scores are summed
    in the order of the dimensions.
    """
    asked_of = groups[0].select(F.col(query_key).alias("q"), F.col("group").alias("g")).filter("g is not null").distinct()
    group_of = groups[1].select(F.col(key).alias("key"), F.col("group").alias("g")).filter("g is not null").distinct()
    asked = written(queries.filter(F.col(vector).isNotNull()).select(F.col(query_key).alias("q"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v")).join(asked_of, "q"), "grouped-queries")
    own = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("embedding"))
    placed = written(own.join(group_of, "key").join(small(asked.select("g").distinct()), "g", "left_semi"), "grouped-vectors")
    blocks = lambda rows, name: rows.groupBy("g").agg(F.ceil(F.count("*") / GROUP_BLOCK).cast("int").alias(name))
    split = small(written(blocks(placed, "parts").join(blocks(asked, "sides"), "g"), "grouped-blocks"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(split, "g").withColumn("side", F.pmod(F.xxhash64("q"), F.col("sides")).cast("int")).withColumn("part", each("parts")).select("q", "v", "g", "part", "side")
    right = placed.join(split, "g").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).withColumn("side", each("sides")).select("key", "embedding", "g", "part", "side")
    kinds = dict(left.dtypes)["q"], dict(right.dtypes)["key"]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        qs, keys = a.column("q").combine_chunks(), b.column("key").combine_chunks()
        found = [], [], []
        if len(qs) and len(keys):
            order = pc.sort_indices(keys)
            keys, x, v = keys.take(order), _matrix(b.column("embedding").combine_chunks().take(order)), _matrix(a.column("v").combine_chunks())
            for at in range(0, len(v), AT_ONCE):
                rows, places, scores = _best(v[at : at + AT_ONCE], x, k)
                for out, part in zip(found, (rows + at, places, scores), strict=True):
                    out.append(part)
        rows, places, scores = (np.concatenate([np.zeros(0, t), *f]) for f, t in zip(found, (int, int, float), strict=True))
        return pa.table({"q": qs.take(pa.array(rows, pa.int64())), "key": keys.take(pa.array(places, pa.int64())), "score": pa.array(scores, pa.float64())})

    by = ["g", "part", "side"]
    block = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, f"q {kinds[0]}, key {kinds[1]}, score double")
    # a vector may share several groups with a query
    best = top_k(block.distinct(), "q", k, "key")
    return best.select(F.col("q").alias(query_key), F.col("key").alias(key), "score", "rank")


def _best(v: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of v, rows of x and scores: the k best of each row of v by its score to nine digits, then by place in x."""
    near = v @ x.T
    if near.shape[1] > k:
        least = np.partition(near, -k, axis=1)[:, -k:].min(1, keepdims=True)
        rows, places = np.nonzero(near >= least - 2e-9 - SLACK * 1e-2 * np.abs(least))
    else:
        rows, places = np.indices(near.shape).reshape(2, -1)
    # the product may sum in any order, a score sums in that of the dimensions
    scores = np.zeros(len(rows))
    for d in range(v.shape[1]):
        scores += v[rows, d] * x[places, d]
    order = np.lexsort((places, -np.round(scores, 9), rows))
    rows, places, scores = rows[order], places[order], scores[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], places[keep], scores[keep]


def build(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cells: int | None = None, seed: int = 7) -> Ivf:
    """An inverted file of vectors (key, vector) of one dimension; rows without a vector are left out. cells: about the square root of their number, CELLS at most."""
    rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("embedding"))
    spark, total = vectors.sparkSession, rows.count()
    drawn = rows.orderBy(F.xxhash64(F.col("key"), F.lit(seed))).limit(SAMPLE).select("embedding").toPandas()["embedding"]
    x = np.array([np.asarray(v, np.float64) for v in drawn]) if len(drawn) else np.zeros((1, 1))
    k = max(1, min(CELLS, cells or int(total**0.5), len(x)))
    label = clusters(x, k, np.random.default_rng(seed).random(k), 10)
    means = np.array([x[label == c].mean(0) for c in range(k) if (label == c).any()])
    sizes = np.linalg.norm(means, axis=1, keepdims=True)
    axes = np.divide(means, sizes, out=np.zeros_like(means), where=sizes > 0)
    half = (means * means).sum(1) / 2
    kind = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(1))
            cell = (v @ means.T - half).argmax(1)
            along = (v * axes[cell]).sum(1)
            across = np.sqrt(np.maximum((v * v).sum(1) - along * along, 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(along), pa.array(across)], names=["key", "embedding", "cell", "along", "across"])

    placed = written(rows.mapInArrow(run, f"key {kind['key']}, embedding {kind['embedding']}, cell int, along double, across double"), "ivf-placed")
    # rings of equal width up to the longest distance from an axis
    width = (placed.agg(F.max("across")).first()[0] or 0.0) / RINGS * (1 + 1e-9)
    placed = placed.withColumn("ring", F.least(F.lit(RINGS - 1), F.floor(F.col("across") / width).cast("int")) if width > 0 else F.lit(0))
    rings = written(placed.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.min("along").alias("low"), F.max("along").alias("high"), F.max("across").alias("across"), F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")), "ivf-rings")
    split = F.broadcast(rings.select("cell", "ring", "parts"))
    dealt = placed.drop("along", "across").join(split, ["cell", "ring"]).select("key", "embedding", "cell", "ring", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"))
    return Ivf(dealt, rings, axes, key)
