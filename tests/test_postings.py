"""BM25 with bounds against scores of all pairs, and what the bounds leave out."""

import random

import pytest
from pyspark.sql import functions as F

from lanternrow.operators import postings, retrieval


def texts(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    out = [(i, " ".join(["the"] * r.randrange(0, 4) + [r.choice(words[: r.choice([5, 20, 60])]) for _ in range(r.randrange(0, 30))])) for i in range(n)]
    # ties by copies, no text, one long text
    return [*out, (n, out[3][1]), (n + 1, out[3][1]), (n + 2, None), (n + 3, ""), (n + 4, "w1 the " * 3000)]


@pytest.mark.parametrize("k", [1, 4, 500])
def test_best_equals_all_pairs(spark, k):
    docs = spark.createDataFrame(texts(3, 300), "doc_id long, text string")
    queries = spark.createDataFrame([(1, "the w1 w1 w55"), (2, "w3"), (3, "nowhere"), (4, None), (5, ""), (6, "the"), (7, " ".join(f"w{i}" for i in range(30)))], "item_id long, text string")
    all_ = retrieval.top_k(retrieval.bm25(docs, queries), "item_id", k, "doc_id")
    show = lambda df: sorted((r.item_id, r["rank"], r.doc_id, round(r.score, 9)) for r in df.collect())
    assert show(postings.best(docs, queries, k)) == show(all_)
    scope = docs.filter("doc_id % 3 = 0").select("doc_id").crossJoin(queries.filter("item_id < 7").select("item_id"))
    within = retrieval.top_k(retrieval.bm25(docs, queries).join(scope, ["item_id", "doc_id"]), "item_id", k, "doc_id")
    assert show(retrieval.lexical(docs, queries, k, scope=scope)) == show(within)


def test_bounds_leave_common_words_out(spark, tmp_path):
    """A rare word's texts are the best; those that share only the common one are no candidates."""
    docs = spark.createDataFrame([(i, "common " * (1 + i % 3) + ("rare" if i % 100 == 0 else f"other{i}")) for i in range(2000)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "common rare")], "item_id long, text string")
    stored = []
    keep, postings.written = postings.written, lambda df, kind: stored.append((kind, keep(df, kind))) or stored[-1][1]
    try:
        got = postings.best(docs, queries, 5)
    finally:
        postings.written = keep
    assert {r.doc_id % 100 for r in got.collect()} == {0}
    assert 5 <= dict(stored)["candidates"].count() <= 20
    assert dict(stored)["postings"].count() == 2020


def test_nothing_asked_or_nothing_there(spark):
    docs = spark.createDataFrame(texts(1, 5), "doc_id long, text string")
    queries = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert postings.best(docs.limit(0), queries, 3).count() == 0
    assert postings.best(docs, queries.limit(0), 3).count() == 0
    assert postings.best(docs.filter(F.col("text") == ""), queries, 3).count() == 0


@pytest.mark.parametrize("k", [1, 4, 500])
def test_whole_equals_all_pairs(spark, k):
    """Texts scored where they are read give what pairs give, within groups too, and nothing of a pair is stored."""
    docs = spark.createDataFrame(texts(3, 300), "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(1, "the w1 w1 w55"), (2, "w3"), (3, "nowhere"), (4, None), (5, ""), (6, "the"), (7, " ".join(f"w{i}" for i in range(30)))], "item_id long, text string")
    show = lambda df: sorted((r.item_id, r["rank"], r.doc_id, round(r.score, 9)) for r in df.collect())
    scored = retrieval.bm25(docs, queries)
    stored = []
    keep, postings.written = postings.written, lambda df, kind: stored.append(kind) or keep(df, kind)
    at_once, postings.AT_ONCE = postings.AT_ONCE, 7
    try:
        got = show(postings.whole(docs, queries, k))
    finally:
        postings.written, postings.AT_ONCE = keep, at_once
    assert got == show(retrieval.top_k(scored, "item_id", k, "doc_id")) and stored == ["query-terms", "postings-rows"]
    q_of = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (6, None), (7, "c")], "item_id long, group string")
    d_of = docs.select("doc_id", F.explode(F.array(F.lit("a"), F.when(F.col("doc_id") % 3 > 0, "b"), F.lit("z"))).alias("group")).filter("doc_id % 5 > 0")
    pairs = q_of.join(d_of, "group").select("item_id", "doc_id").distinct()
    within = retrieval.top_k(scored.join(pairs, ["item_id", "doc_id"]), "item_id", k, "doc_id")
    assert show(postings.whole(docs, queries, k, groups=(q_of, d_of))) == show(within)


def test_whole_of_repeated_keys(spark):
    docs = spark.createDataFrame([(1, "ab ab"), (1, "ab cd"), (2, "cd")], "doc_id long, text string")
    queries = spark.createDataFrame([("x", "ab cd")], "item_id string, text string")
    show = lambda df: sorted((r.item_id, r["rank"], r.doc_id, round(r.score, 9)) for r in df.collect())
    assert show(postings.whole(docs, queries, 3)) == show(postings.best(docs, queries, 3))
    assert postings.whole(docs, queries.limit(0), 3).count() == 0 and postings.whole(docs.limit(0), queries, 3).count() == 0
