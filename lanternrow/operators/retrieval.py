"""Chunks, BM25, dense search, fusion and reranking.

Scores are ranked by their value rounded to nine digits, then by position, so that equal texts
keep their order whatever the order of summation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import overlap, tokens, words
from ..storage import written

#: Rows up to which a query side is broadcast; beyond, the join shuffles.
SMALL_ROWS = 200_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows, counted; as it is otherwise."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def chunk(pages: DataFrame, most: int = 200, step_back: int = 40) -> DataFrame:
    """Sliding windows of `most` words within each page: doc_id, page, start, chunk_id, text.

    Windows move by most - step_back; the last is the first to reach the page's end. Blank pages have none.
    """
    if not 0 <= step_back < most:
        raise ValueError("0 <= step_back < most")
    step = most - step_back
    split = pages.select("doc_id", "page", words(F.col("text")).alias("w")).withColumn("n", F.size("w")).filter("n > 0")
    last = (F.ceil((F.col("n") - most) / F.lit(step)) * step).cast("int")
    starts = F.when(F.col("n") <= most, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), last, F.lit(step)))
    rows = split.withColumn("start", F.explode(starts))
    return rows.select("doc_id", "page", "start", F.concat_ws(":", "doc_id", "page", "start").alias("chunk_id"), F.array_join(F.slice("w", F.col("start") + 1, most), " ").alias("text"))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf, len (tokens of the text). Token lists are counted before the shuffle."""
    rows = docs.select(key, tokens(F.col(text)).alias("t")).withColumn("len", F.size("t"))
    return rows.select(key, "len", F.explode("t").alias("term")).groupBy(key, "len", "term").agg(F.count("*").alias("tf"))


def collection_stats(docs: DataFrame, text: str) -> DataFrame:
    """One row: n texts, their average length in tokens."""
    return docs.agg(F.count("*").alias("n"), F.avg(F.size(tokens(F.col(text)))).alias("avg_len"))


def term_stats(post: DataFrame, stats: DataFrame) -> DataFrame:
    """term, df, idf over all texts of the store."""
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return post.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats.select("n"))).select("term", "df", idf.alias("idf"))


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, times: repeats of a query's token count."""
    return queries.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("times"))


def bm25(docs: DataFrame, queries: DataFrame, doc_key: str = "doc_id", query_key: str = "item_id", text: str = "text", query_text: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_key, doc_key, score of every pair with a term in common; statistics are of all docs."""
    asked = query_terms(queries, query_key, query_text)
    # the empty term stands in every text once, so that one pass gives postings and the texts' lengths
    wanted = small(asked.select("term").distinct().unionByName(asked.sparkSession.createDataFrame([("",)], "term string")))
    rows = docs.select(doc_key, tokens(F.col(text)).alias("t")).withColumn("len", F.size("t"))
    rows = rows.select(doc_key, "len", F.explode(F.concat(F.array(F.lit("")), "t")).alias("term")).filter("term is not null")
    # only postings of asked terms are kept, before anything is shuffled
    post = rows.join(wanted, "term", "left_semi").groupBy(doc_key, "len", "term").agg(F.count("*").alias("tf"))
    stats = post.agg(F.count_if(F.col("term") == "").alias("n"), F.avg(F.when(F.col("term") == "", F.col("len"))).alias("avg_len"))
    terms = term_stats(post, stats)
    norm = F.when(F.col("avg_len") == 0, F.lit(1.0)).otherwise(F.col("len") / F.col("avg_len"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * norm))
    weighted = post.join(terms, "term").crossJoin(F.broadcast(stats.select("avg_len")))
    return weighted.join(small(asked), "term").groupBy(query_key, doc_key).agg(F.sum(part).alias("score"))


def top_k(scored: DataFrame, by: str, k: int, *order: str, score: str = "score") -> DataFrame:
    """The k best rows of each `by` with their rank from 1; equal scores keep the order of `order`."""
    w = Window.partitionBy(by).orderBy(F.round(F.col(score), 9).desc(), *order)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def lexical(docs: DataFrame, queries: DataFrame, k: int, doc_key: str = "doc_id", query_key: str = "item_id", scope: DataFrame | None = None, groups: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The k best by BM25 within each query's scope (query_key, doc_key), or its groups (query_key, group) and (doc_key, group), statistics of all docs; scores above 0 only."""
    from . import postings

    if scope is not None:
        return postings.best(docs, queries, k, doc_key, query_key, scope=scope, groups=groups).filter("score > 0")
    return postings.whole(docs, queries, k, doc_key, query_key, groups=groups).filter("score > 0")


def dot(a: Column, b: Column) -> Column:
    """Dot product in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalise(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    size = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(size > 0, x / size).otherwise(x.cast("double")))


def dense(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", query_key: str = "query_id", vector: str = "embedding") -> DataFrame:
    """The k nearest vectors by dot product for each query, a stated set of any size: exact, by an inverted file, without a join of all pairs."""
    from . import ivf

    return ivf.build(vectors, key, vector).search(queries, k, query_key, vector)[0]


def hash_embed(docs: DataFrame, key: str, text: str, dim: int = 256) -> DataFrame:
    """Sparse unit vectors by feature hashing of words: key, d, value. Dimension and sign are of SHA-256's first 8 bytes."""
    from ..functions.hashing import head64

    rows = docs.select(key, F.explode(tokens(F.col(text))).alias("w")).withColumn("h", head64(F.col("w")))
    sign = F.when(F.col("h") >= F.lit("9223372036854775808").cast("decimal(20,0)"), F.lit(-1)).otherwise(F.lit(1))
    summed = rows.groupBy(key, (F.col("h") % dim).cast("int").alias("d")).agg(F.sum(sign).alias("v")).filter("v <> 0")
    size = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key)))
    return summed.select(key, "d", (F.col("v") / size).alias("value"))


def fuse(rankings: list[DataFrame], query_key: str, key: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (k + rank) over rankings (query_key, key, rank from 1)."""
    rows = rankings[0].select(query_key, key, "rank")
    for r in rankings[1:]:
        rows = rows.unionByName(r.select(query_key, key, "rank"))
    return rows.groupBy(query_key, key).agg(F.sum(1 / (F.lit(float(k)) + F.col("rank"))).alias("score"))


def rerank(fused: DataFrame, docs: DataFrame, queries: DataFrame, keep: int, k: int, query_key: str = "item_id", key: str = "doc_id", text: str = "text") -> DataFrame:
    """The `keep` best of a fusion, ordered by token overlap, then by fused rank; k a query."""
    # a top list is stored, so that it is counted and broadcast, and the texts stay where they are read
    best = written(top_k(fused, query_key, keep, key).withColumnRenamed("rank", "fused_rank").drop("score"), "fused")
    rows = docs.select(key, F.col(text).alias("d")).join(small(best), key).join(queries.select(query_key, F.col(text).alias("q")), query_key)
    scored = rows.select(query_key, key, "fused_rank", overlap(F.col("q"), F.col("d")).alias("score"))
    return top_k(scored, query_key, k, "fused_rank")


def scope(questions: DataFrame, groups: DataFrame, mode: str = "corpus") -> DataFrame:
    """qid, doc_id, pos that a question may search. questions (qid, doc_ids), groups (doc_id, corpus).

    question_docs: its own documents in the given order. corpus: all documents of any of their
    corpora, sorted; documents without a corpus belong together, as null equals null.
    """
    own = questions.select("qid", F.posexplode("doc_ids").alias("pos", "doc_id"))
    if mode == "question_docs":
        return own.select("qid", "doc_id", "pos")
    if mode != "corpus":
        raise ValueError(f"unknown scope {mode!r}")
    corpora = own.join(groups, "doc_id", "left").select("qid", "corpus").distinct()
    # documents are numbered once for each set of corpora that questions have, not for each question
    sets = written(corpora.groupBy("qid").agg(F.sort_array(F.collect_set(F.struct("corpus"))).alias("set")), "scopes")
    each = small(sets.select("set").distinct()).withColumn("c", F.explode("set"))
    reach = groups.join(small(each), F.col("c.corpus").eqNullSafe(F.col("corpus"))).select("set", "doc_id").distinct()
    ranked = reach.withColumn("pos", F.row_number().over(Window.partitionBy("set").orderBy("doc_id")) - 1)
    return ranked.join(small(sets), "set").select("qid", "doc_id", "pos")


def reachable(questions: DataFrame, groups: DataFrame, mode: str = "corpus") -> DataFrame:
    """Different doc_ids in the scope of any question."""
    return scope(questions, groups, mode).select("doc_id").distinct()


#: Bytes of distances that k-means holds at once.
AT_ONCE_BYTES = 64 << 20


def nearest_means(x, means):
    """The nearest of means for each row of x, ties to the lowest; so many rows at a time that their distances take AT_ONCE_BYTES."""
    import numpy as np

    half, rows = (means * means).sum(1), max(1, AT_ONCE_BYTES // (8 * len(means)))
    return np.concatenate([(half - 2 * x[at : at + rows] @ means.T).argmin(1) for at in range(0, len(x), rows)])


def clusters(x, k: int, draws, rounds: int = 25):
    """Cluster numbers of the rows of x: k-means++ starts by `draws` (a number in [0, 1) each), then moving means until nothing changes, ties to the lowest."""
    import numpy as np

    k, norm = max(1, min(k, len(x))), (x * x).sum(1)
    chosen, far = [int(draws[0] * len(x))], np.full(len(x), np.inf)
    for u in draws[1:k]:
        far = np.minimum(far, np.maximum(norm - 2 * x @ x[chosen[-1]] + norm[chosen[-1]], 0))
        far[chosen] = 0
        reach = np.cumsum(far)
        # of rows that all stand on a centre, any will do
        chosen.append(int(np.searchsorted(reach, u * reach[-1], side="right")) if reach[-1] > 0 else int(u * len(x)))
    means, label = x[chosen].copy(), np.full(len(x), -1)
    for _ in range(rounds):
        now = nearest_means(x, means)
        if np.array_equal(now, label):
            break
        label, size = now, np.bincount(now, minlength=k)
        total = np.zeros_like(means)
        np.add.at(total, label, x)
        means = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], means)
    return label


def kmeans(vectors: DataFrame, by: str, k: int, seed: int = 0, rounds: int = 25, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """by, key, cluster: seeded k-means++ within each group, at most `rounds` rounds, ties to the lowest cluster.

    A group is one document's leaves; for one large collection take pyspark.ml.clustering.KMeans.
    """
    return grouped_clusters(vectors, by, key, vector, lambda n: k, seed, rounds)


def grouped_clusters(vectors: DataFrame, by: str, key: str, vector: str, how_many, seed: int, rounds: int = 25) -> DataFrame:
    """by, key, cluster of each group's vectors, in how_many(n) clusters of n vectors; a group's draws depend on the seed alone."""
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        x = np.stack(pdf[vector].to_numpy()).astype(np.float64)
        k = how_many(len(x))
        return pd.DataFrame({by: pdf[by].to_numpy(), key: pdf[key].to_numpy(), "cluster": clusters(x, k, np.random.default_rng(seed).random(max(1, k)), rounds).astype("int32")})

    types = dict(vectors.dtypes)
    return vectors.select(by, key, vector).groupBy(by).applyInPandas(run, f"{by} {types[by]}, {key} {types[key]}, cluster int")
