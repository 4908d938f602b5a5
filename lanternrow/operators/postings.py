"""BM25's best texts for a set of queries, from stored postings, without scoring pairs that can't be among them.

One pass over the texts gives the postings of asked terms, with what each adds to a score; they are
stored and read from then on. The CHAMPIONS highest postings of each term name the first candidates,
whose k-th score is a lower bound for the query. A posting can only matter if what it adds and the
most that the query's other terms can add reach that bound, and a term whose most, with those of all
lesser terms, stays below it need not be looked at for candidates. Both tests are made where the
postings are read, so only pairs that pass are shuffled; they are scored in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..storage import BATCH_BYTES, bounded_batches, written
from .retrieval import query_terms, small, top_k

#: Postings of a term that are candidates before any bound is known, as a multiple of k.
CHAMPIONS = 2
#: Scores are ranked by nine digits, so pairs this close below a bound still count.
SLACK = 1e-8


@dataclass
class Postings:
    """rows: term, doc, adds; terms: term, df, idf, most (the highest that a posting of it adds)."""

    rows: DataFrame
    terms: DataFrame


def build(docs: DataFrame, asked: DataFrame, key: str = "doc_id", text: str = "text", k1: float = 1.5, b: float = 0.75) -> Postings:
    """Postings of the terms in asked (term) over docs; statistics are of all docs. A token counts once for each place it stands at."""
    spark = docs.sparkSession
    # the empty term stands in every text once, so that one pass gives postings and the texts' lengths
    wanted = small(asked.select("term").distinct().unionByName(spark.createDataFrame([("",)], "term string")))
    split = docs.select(F.col(key).alias("doc"), tokens(F.col(text)).alias("t")).withColumn("len", F.size("t"))
    each = split.select("doc", "len", F.explode(F.concat(F.array(F.lit("")), "t")).alias("term")).filter("term is not null")
    raw = written(each.join(wanted, "term", "left_semi").groupBy("doc", "len", "term").agg(F.count("*").alias("tf")), "postings-raw")
    n, length = raw.filter("term = ''").agg(F.count("*"), F.avg("len")).first()
    counts = raw.filter("term <> ''").groupBy("term").agg(F.count("*").alias("df"))
    idf = written(counts.withColumn("idf", F.log1p((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))), "postings-terms")
    norm = F.col("len") / F.lit(float(length)) if length else F.lit(1.0)
    adds = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * norm))
    rows = written(raw.join(small(idf), "term").select("term", "doc", adds.alias("adds")), "postings")
    return Postings(rows, written(idf.join(rows.groupBy("term").agg(F.max("adds").alias("most")), "term"), "postings-most"))


def search(index: Postings, asked: DataFrame, k: int, query: str = "item_id", key: str = "doc_id", scope: DataFrame | None = None, groups: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """query, key, score, rank: the k best texts of each query in asked (query, term, times), within its scope if given; equal scores go by key.

    A scope is pairs (query, key), or groups: (query, group) and (key, group), whose pairs, many times the texts, are never made.

    Texts that share no term with a query are never among its best.
    """
    ask = written(asked.join(small(index.terms.select("term", "most")), "term").select(F.col(query).alias("q"), "term", "times", (F.col("times") * F.col("most")).alias("can")), "asked")
    own = None if scope is None else written(scope.select(F.col(query).alias("q"), F.col(key).alias("doc")), "scope")
    if groups:
        asked_of, group_of = groups[0].select(F.col(query).alias("q"), F.col("group").alias("g")).distinct(), groups[1].select(F.col(key).alias("doc"), F.col("group").alias("g")).distinct()
        asked_of = small(written(asked_of, "asked-groups"))

    def within(pairs: DataFrame) -> DataFrame:
        # scopes are long and their files small, so they are not left to be broadcast
        out = pairs if own is None else pairs.join(own.hint("merge"), ["q", "doc"], "left_semi")
        return out.join(group_of.hint("merge"), "doc").join(asked_of, ["q", "g"], "left_semi").select("q", "doc").distinct() if groups else out

    # the row number's limit is applied before the shuffle, so a common term sends a few postings of each task
    high = Window.partitionBy("term").orderBy(F.desc("adds"), "doc")
    best = index.rows.withColumn("nth", F.row_number().over(high)).filter(F.col("nth") <= CHAMPIONS * k).select("term", "doc")
    first = within(best.join(small(ask), "term").select("q", "doc").distinct())
    scored = _scored(index, ask, written(first, "champions"))
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
    least = scored.withColumn("nth", nth).filter(F.col("nth") == k).select("q", F.col("score").alias("least"))
    order = Window.partitionBy("q").orderBy("can", "term")
    bounds = ask.join(least, "q", "left").withColumns({"upto": F.sum("can").over(order), "all": F.sum("can").over(Window.partitionBy("q"))})
    open_ = written(bounds.filter(F.col("least").isNull() | (F.col("upto") >= F.col("least") - SLACK)), "bounds")
    reach = F.col("least").isNull() | (F.col("times") * F.col("adds") + F.col("all") - F.col("can") >= F.col("least") - SLACK)
    pairs = index.rows.join(small(open_), "term").filter(reach).select("q", "doc").distinct()
    found = _scored(index, ask, written(within(pairs), "candidates"))
    return top_k(found, "q", k, "doc").select(F.col("q").alias(query), F.col("doc").alias(key), "score", "rank")


def _scored(index: Postings, ask: DataFrame, pairs: DataFrame) -> DataFrame:
    """q, doc, score of pairs (q, doc): the sum over the query's terms that the text has."""
    wanted = pairs.join(small(ask.select("q", "term", "times")), "q")
    return index.rows.join(small(wanted), ["term", "doc"]).groupBy("q", "doc").agg(F.sum(F.col("times") * F.col("adds")).alias("score"))


def best(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", query: str = "item_id", text: str = "text", query_text: str = "text", scope: DataFrame | None = None, groups: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The k best texts of each query: query, key, score, rank."""
    asked = written(query_terms(queries, query, query_text), "query-terms")
    return search(build(docs, asked, key, text), asked, k, query, key, scope, groups)


#: Terms times queries up to which texts are scored where they are read, groups of queries, texts scored at once.
DENSE_CELLS, DENSE_GROUPS, AT_ONCE = 8_000_000, 10_000, 512


def whole(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", query: str = "item_id", text: str = "text", query_text: str = "text", groups: tuple[DataFrame, DataFrame] | None = None, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """best() for a stated set of queries over any number of texts: query, key, score, rank.

    A text's counts of asked terms are stored as one row. A task scores its texts by all queries as
    products of counts and questions and keeps each query's k best, so neither postings nor pairs are
    shuffled, but k rows a query and task. Beyond DENSE_CELLS, or where a key has several texts, best() does it.
    """
    import numpy as np

    spark = docs.sparkSession
    asked = written(query_terms(queries, query, query_text), "query-terms")
    n_terms, n_queries = asked.agg(F.count_distinct("term"), F.count_distinct(query)).first()
    other = lambda: search(build(docs, asked, key, text, k1, b), asked, k, query, key, None, groups)
    asked_of = None
    if groups:
        asked_of = written(groups[0].select(F.col(query).alias("q"), F.col("group").alias("g")).filter("g is not null").distinct().join(small(asked.select(F.col(query).alias("q")).distinct()), "q", "left_semi"), "asked-groups")
    if not n_terms or n_terms * n_queries > DENSE_CELLS or (groups and asked_of.select("g").distinct().count() > DENSE_GROUPS):
        return other()
    # bounded by DENSE_CELLS
    ask = asked.select(query, "term", "times").toArrow()
    names = pc.unique(ask.column(query).combine_chunks())
    terms = pc.unique(ask.column("term").combine_chunks()).cast(pa.string())
    weight = np.zeros((len(terms), len(names)))
    weight[pc.index_in(ask.column("term").combine_chunks().cast(pa.string()), terms).to_numpy(), pc.index_in(ask.column(query).combine_chunks(), names).to_numpy()] = ask.column("times").to_numpy()
    kind, q_kind = dict(docs.dtypes)[key], dict(asked.dtypes)[query]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.column(1)
            size = pc.list_value_length(t).to_numpy(zero_copy_only=False).astype(np.int64)
            at = pc.index_in(t.flatten().cast(pa.string()), terms)
            some = at.is_valid().to_numpy(zero_copy_only=False)
            code = np.repeat(np.arange(len(size)), size)[some] * len(terms) + at.drop_null().to_numpy()
            code, times = np.unique(code, return_counts=True)
            ends = np.searchsorted(code, np.arange(len(size) + 1) * len(terms)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x, pa.int32())) for x in (code % len(terms), times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), *lists], names=["doc", "len", "term", "tf"])

    split = docs.select(F.col(key).alias("doc"), tokens(F.col(text)).alias("t")).filter("t is not null")
    with bounded_batches(spark, BATCH_BYTES):
        rows = written(split.mapInArrow(count, f"doc {kind}, len long, term array<int>, tf array<int>"), "postings-rows")
    if not rows.groupBy("doc").count().filter("count > 1").isEmpty():
        return other()
    n, length = rows.agg(F.count("*"), F.avg("len")).first()
    df = np.zeros(len(terms))
    for r in rows.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # as many as asked terms
        df[r["term"]] = r["count"]
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    in_groups, group_names = None, None
    if groups:
        of = asked_of.toArrow()
        group_names = pc.unique(of.column("g").combine_chunks())
        # the last row is of groups that nothing asks for
        in_groups = np.zeros((len(group_names) + 1, len(names)), bool)
        in_groups[pc.index_in(of.column("g").combine_chunks(), group_names).to_numpy(), pc.index_in(of.column("q").combine_chunks(), names).to_numpy()] = True
        group_of = groups[1].select(F.col(key).alias("doc"), F.col("group").alias("g")).groupBy("doc").agg(F.collect_set("g").alias("gs"))
        rows = rows.join(group_of, "doc").filter(F.size("gs") > 0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, least = None, np.full(len(names), -np.inf)
        for whole_batch in batches:
            for start in range(0, whole_batch.num_rows, AT_ONCE):
                batch = whole_batch.slice(start, AT_ONCE)
                sizes = pc.list_value_length(batch.column(2)).to_numpy().astype(np.int64)
                row, term = np.repeat(np.arange(batch.num_rows), sizes), batch.column(2).flatten().to_numpy()
                tf, norm = batch.column(3).flatten().to_numpy().astype(float), batch.column(1).to_numpy() / length if length else np.ones(batch.num_rows)
                used, place = np.unique(term, return_inverse=True)
                adds = np.zeros((batch.num_rows, len(used)))
                adds[row, place] = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * norm[row]))
                scores = adds @ weight[used]
                if in_groups is not None:
                    of = batch.column(4)
                    at = pc.fill_null(pc.index_in(of.flatten(), group_names), len(group_names)).to_numpy()
                    ends = np.cumsum(pc.list_value_length(of).to_numpy())
                    scores[~np.logical_or.reduceat(in_groups[at], np.concatenate([[0], ends[:-1]]))] = 0
                digits = np.round(scores, 9)
                floor = least if batch.num_rows <= k else np.maximum(least, np.partition(digits, -k, axis=0)[-k])
                row, q = np.nonzero((scores > 0) & (digits >= floor))
                if not len(row):
                    continue
                found = pa.table({"q": pa.array(q), "doc": batch.column(0).take(pa.array(row)), "score": scores[row, q], "digits": digits[row, q]})
                best = (pa.concat_tables([best, found]) if best else found).sort_by([("q", "ascending"), ("digits", "descending"), ("doc", "ascending")])
                q = best.column("q").to_numpy()
                nth = np.arange(len(q)) - np.searchsorted(q, q)
                last = nth == k - 1
                least[q[last]] = best.column("digits").to_numpy()[last]
                best = best.filter(pa.array(nth < k))
        if best:
            for part in best.combine_chunks().to_batches():
                yield pa.RecordBatch.from_arrays([names.take(part.column(0)), part.column(1), part.column(2)], names=["q", "doc", "score"])

    found = rows.mapInArrow(score, f"q {q_kind}, doc {kind}, score double")
    return top_k(found, "q", k, "doc").select(F.col("q").alias(query), F.col("doc").alias(key), "score", "rank")
