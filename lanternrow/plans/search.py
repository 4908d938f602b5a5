"""Queries on retrieval, fusion, scopes and methods."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import arms as A
from ..operators import metrics as M
from ..operators import postings as B
from ..operators import retrieval as R
from ..storage import written
from .base import GOLD, PAGES, TOKENS, WORDS, gold, load, pages

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_POST = f"tok AS (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS avg_len FROM tok), post AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM tok) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM post GROUP BY term), idf AS (SELECT term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM df, st), q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL)"
_BM25 = f"WITH {_POST}, sc AS (SELECT item_id, doc_id, sum(times * idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * len / avg_len))) AS score FROM q JOIN post USING (term) JOIN idf USING (term), st GROUP BY ALL), rk AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc)"
BM25_TOP = _BM25 + " SELECT item_id, rank, doc_id, round(score, 6) AS score FROM rk WHERE rank <= 5"


@query("bm25_topk", BM25_TOP)
def bm25_topk(spark, d):
    return B.whole(load(spark, d, "documents"), load(spark, d, "benchmark"), 5).select("item_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"))


@query("bm25_term_stats", f"WITH {_POST} SELECT term, df, round(idf, 6) AS idf FROM idf")
def _(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "text")
    stats = R.term_stats(R.postings(docs, "doc_id", "text"), R.collection_stats(docs, "text"))
    return stats.select("term", "df", F.round("idf", 6).alias("idf"))


_LANG = f"gl AS (SELECT item_id, min(lang) AS lang FROM ({GOLD}) g JOIN documents USING (doc_id) GROUP BY item_id)"


@query("lexical_search", _BM25.replace("rk AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc)", f"{_LANG}, rk AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc JOIN gl USING (item_id) JOIN documents USING (doc_id) WHERE gl.lang = documents.lang)") + " SELECT item_id, rank, doc_id, round(score, 6) AS score FROM rk WHERE rank <= 5")
def _(spark, d):
    docs = load(spark, d, "documents")
    langs = gold(spark, d).join(docs.select("doc_id", "lang"), "doc_id").groupBy("item_id").agg(F.min("lang").alias("lang"))
    groups = langs.withColumnRenamed("lang", "group"), docs.select("doc_id", F.col("lang").alias("group"))
    return R.lexical(docs, load(spark, d, "benchmark"), 5, groups=groups).select("item_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"))


_EMB = "SELECT item_id, d, v / sqrt(sum(v * v) OVER (PARTITION BY item_id)) AS value FROM (SELECT item_id, CAST(h % 256 AS INTEGER) AS d, sum(CASE WHEN h >= 9223372036854775808 THEN -1 ELSE 1 END) AS v FROM (SELECT item_id, CAST(('0x' || substr(sha256(w), 1, 16)) AS UBIGINT) AS h FROM (SELECT item_id, unnest(" + TOKENS.format("text") + ") AS w FROM benchmark)) GROUP BY ALL HAVING v <> 0)"


@query("hash_embed", f"SELECT item_id, d, round(value, 6) AS value FROM ({_EMB})")
def _(spark, d):
    return R.hash_embed(load(spark, d, "benchmark"), "item_id", "text").select("item_id", "d", F.round("value", 6).alias("value"))


_DENSE = "SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(range(1, 65), lambda i: CAST(q.embedding[i] AS DOUBLE) * CAST(v.embedding[i] AS DOUBLE))) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0"


@query("dense_topk", f"SELECT query_id, vec_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM ({_DENSE})) WHERE rank <= 8")
def _(spark, d):
    v = load(spark, d, "embeddings")
    asked = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.dense(v, asked, 8).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("vector_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS norm FROM embeddings")
def _(spark, d):
    unit = R.normalise(F.transform("embedding", lambda x: x * 3))
    return load(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(R.dot(unit, unit)), 5).alias("norm"))


# overlap of a question with the documents that BM25 puts first, as the second ranking
_TWO = _BM25 + f", b AS (SELECT item_id, doc_id, rank FROM rk WHERE rank <= 50), o AS (SELECT item_id, doc_id, b.rank AS first, len(list_intersect(qt, dt)) / CAST(greatest(len(qt), 1) AS DOUBLE) AS score FROM b JOIN (SELECT item_id, list_distinct({TOKENS.format('text')}) AS qt FROM benchmark) USING (item_id) JOIN (SELECT doc_id, {TOKENS.format('text')} AS dt FROM documents) USING (doc_id)), r2 AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM o), fu AS (SELECT item_id, doc_id, sum(1e0 / (60 + rank)) AS score FROM (SELECT item_id, doc_id, rank FROM b UNION ALL SELECT item_id, doc_id, rank FROM r2) GROUP BY ALL), fr AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM fu)"


def _rankings(spark, d):
    docs, items = load(spark, d, "documents"), load(spark, d, "benchmark")
    best = written(B.whole(docs, items, 50), "best")
    rows = docs.select("doc_id", F.col("text").alias("t")).join(R.small(best.drop("score")), "doc_id").join(items.select("item_id", F.col("text").alias("q")), "item_id")
    second = written(R.top_k(rows.select("item_id", "doc_id", T.overlap(F.col("q"), F.col("t")).alias("score")), "item_id", 50, "doc_id"), "second")
    return docs, items, best, second


@query("rrf_fusion", _TWO + " SELECT item_id, doc_id, rank, round(score, 6) AS score FROM fr WHERE rank <= 10")
def _(spark, d):
    _, _, a, b = _rankings(spark, d)
    return R.top_k(R.fuse([a, b], "item_id", "doc_id"), "item_id", 10, "doc_id").select("item_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("overlap_rerank", _TWO + " SELECT item_id, doc_id, rank, round(score, 6) AS score FROM (SELECT item_id, doc_id, o.score, row_number() OVER (PARTITION BY item_id ORDER BY round(o.score, 9) DESC, fr.rank) AS rank FROM fr JOIN o USING (item_id, doc_id) WHERE fr.rank <= 30) WHERE rank <= 8")
def _(spark, d):
    docs, items, a, b = _rankings(spark, d)
    return R.rerank(R.fuse([a, b], "item_id", "doc_id"), docs, items, 30, 8).select("item_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("arm_hybrid_rerank", SQL["overlap_rerank"])
def _(spark, d):
    docs, items, _, second = _rankings(spark, d)
    return A.hybrid_rerank(items, docs, second.select("item_id", "doc_id", "score")).select("item_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


_SCOPE = f"SELECT DISTINCT g.item_id AS qid, x.doc_id FROM ({GOLD}) g JOIN documents o USING (doc_id) JOIN documents x ON x.lang IS NOT DISTINCT FROM o.lang"


def _questions(spark, d):
    return gold(spark, d).groupBy("item_id").agg(F.sort_array(F.collect_list("doc_id")).alias("doc_ids")).withColumnRenamed("item_id", "qid")


@query("scope_corpus", f"SELECT qid, doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY doc_id) - 1 AS INTEGER) AS pos FROM ({_SCOPE})")
def _(spark, d):
    groups = load(spark, d, "documents").select("doc_id", F.col("lang").alias("corpus"))
    return R.scope(_questions(spark, d), groups)


@query("reachable_docs", f"SELECT DISTINCT doc_id FROM ({_SCOPE})")
def _(spark, d):
    groups = load(spark, d, "documents").select("doc_id", F.col("lang").alias("corpus"))
    return R.reachable(_questions(spark, d), groups)


@query("arm_oracle", f"SELECT item_id AS qid, row_number() OVER (PARTITION BY item_id ORDER BY g.doc_id) AS rank, g.doc_id, 1 AS page FROM ({GOLD}) g")
def _(spark, d):
    asked = gold(spark, d).groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("doc_id", F.lit(1).alias("page")))).alias("evidence"))
    return A.oracle(asked.withColumnRenamed("item_id", "qid"), pages(spark, d)).select("qid", F.col("rank").cast("long").alias("rank"), "doc_id", "page")


_LONG = f"SELECT item_id AS qid, doc_id, page, len({WORDS.format('p.text')}) AS n_words FROM ({GOLD}) g JOIN ({PAGES}) p USING (doc_id) WHERE len({WORDS.format('p.text')}) > 0"


@query("arm_long_context", f"SELECT qid, doc_id, page, n_words, row_number() OVER (PARTITION BY qid ORDER BY doc_id, page) AS rank, CAST(sum(n_words) OVER (PARTITION BY qid) AS BIGINT) AS total_words, sum(n_words) OVER (PARTITION BY qid) <= 1000 AS applicable FROM ({_LONG})")
def _(spark, d):
    return A.long_context(_questions(spark, d), pages(spark, d), 1000).withColumns({"n_words": F.col("n_words").cast("long"), "rank": F.col("rank").cast("long")})


@query("doc_cards", f"WITH p AS ({PAGES}), t AS (SELECT doc_id, string_agg(text, ' / ' ORDER BY page) AS sections FROM p WHERE page % 10 = 1 GROUP BY doc_id) SELECT d.doc_id, array_to_string(({WORDS.format('concat_ws(chr(10), d.source, coalesce(t.sections, chr(32)), coalesce(p.text, chr(32)))')})[1:60], ' ') AS card FROM documents d LEFT JOIN t USING (doc_id) LEFT JOIN (SELECT * FROM p WHERE page = 1) p USING (doc_id)")
def _(spark, d):
    p = pages(spark, d)
    tree = p.filter("page % 10 = 1").select("doc_id", F.col("page").alias("pos"), F.col("text").alias("title"))
    return A.doc_cards(load(spark, d, "documents").select("doc_id", F.col("source").alias("title")), tree, p, 60)


_RANKED = "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, CAST(floor(o_totalprice / 1000) AS BIGINT) AS n_words FROM orders"


def _ranked(spark, d):
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey"))
    return load(spark, d, "orders").select("o_custkey", F.col("o_orderkey"), rank.alias("rank"), F.floor(F.col("o_totalprice") / 1000).cast("long").alias("n_words"))


@query("greedy_word_budget", f"SELECT o_custkey, unnest(list_reduce(list_prepend({{'used': CAST(0 AS BIGINT), 'ids': CAST([] AS BIGINT[])}}, list_transform(items, lambda x: {{'used': x.n_words, 'ids': [x.o_orderkey]}})), lambda a, x: CASE WHEN a.used + x.used <= 600 THEN {{'used': a.used + x.used, 'ids': list_concat(a.ids, x.ids)}} ELSE a END).ids) AS o_orderkey FROM (SELECT o_custkey, list({{'n_words': n_words, 'o_orderkey': o_orderkey}} ORDER BY rank) AS items FROM ({_RANKED}) GROUP BY o_custkey)")
def _(spark, d):
    return A.greedy_budget(_ranked(spark, d), "o_custkey", 600, key="o_orderkey").select("o_custkey", "o_orderkey")


_EXC = f"WITH p AS (SELECT doc_id, page, {WORDS.format('text')} AS w FROM ({PAGES})), b AS (SELECT *, coalesce(sum(len(w)) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p), c AS (SELECT *, bool_or(len(w) > greatest(0, 80 - before) OR before >= 80) OVER (PARTITION BY doc_id) AS truncated FROM b)"


@query("excerpt_budget", _EXC + " SELECT doc_id, page AS rank, CAST(least(len(w), greatest(0, 80 - before)) AS BIGINT) AS taken, array_to_string(w[1:CAST(greatest(0, 80 - before) AS BIGINT)], ' ') AS excerpt, truncated FROM c WHERE before < 80")
def _(spark, d):
    return A.excerpts(pages(spark, d).select("doc_id", F.col("page").alias("rank"), "text"), "doc_id", 80)


@query("evidence_metrics", _BM25 + f", g AS ({GOLD}), t AS (SELECT item_id, doc_id FROM rk WHERE rank <= 5), c AS (SELECT i.item_id, (SELECT count(*) FROM g WHERE g.item_id = i.item_id) AS g, (SELECT count(*) FROM t WHERE t.item_id = i.item_id) AS r, (SELECT count(*) FROM g JOIN t USING (item_id, doc_id) WHERE g.item_id = i.item_id) AS h FROM benchmark i) SELECT item_id AS qid, CASE WHEN g > 0 THEN round(h / CAST(g AS DOUBLE), 6) END AS recall, CASE WHEN r > 0 THEN round(h / CAST(r AS DOUBLE), 6) END AS precision, CASE WHEN r > 0 THEN h = 0 END AS wrong_doc FROM c")
def _(spark, d):
    items, docs = load(spark, d, "benchmark"), load(spark, d, "documents")
    own = gold(spark, d).groupBy("item_id").agg(F.collect_list("doc_id").alias("doc_ids"))
    asked = items.select("item_id").join(own, "item_id", "left").withColumn("doc_ids", F.coalesce("doc_ids", F.array().cast("array<bigint>")))
    asked = asked.select(F.col("item_id").alias("qid"), "doc_ids", F.transform("doc_ids", lambda x: F.struct(x.alias("doc_id"), F.lit(1).alias("page"))).alias("evidence"))
    got = B.whole(docs, items, 5).select(F.col("item_id").alias("qid"), "doc_id", F.lit(1).alias("page"), F.lit("chunk").alias("kind"))
    return M.evidence_metrics(asked, got).select("qid", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"), "wrong_doc")


@query("kmeans_clusters")
def _(spark, d):
    return R.kmeans(load(spark, d, "embeddings").withColumn("g", F.col("label")), "g", 4).select("vec_id", "g", "cluster")


@query("raptor_tree")
def _(spark, d):
    v = load(spark, d, "embeddings")
    leaves = v.select(F.col("label").alias("doc_id"), F.col("vec_id").cast("string").alias("node_id"), F.col("vec_id").cast("int").alias("start_page"), F.col("vec_id").cast("int").alias("end_page"), F.concat(F.lit("leaf "), "vec_id").alias("text"), "embedding")
    return A.raptor_levels(leaves).select("doc_id", "node_id", "level", "start_page", "end_page", F.size("children").alias("n_children"))
