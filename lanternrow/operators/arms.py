"""Retrieval methods as functions from questions to evidence rows (qid, rank, doc_id, page, ...)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from . import retrieval as R


def oracle(questions: DataFrame, pages: DataFrame) -> DataFrame:
    """The gold pages in their order. questions (qid, evidence array of (doc_id, page))."""
    rows = questions.select("qid", F.posexplode("evidence").alias("pos", "e")).select("qid", "pos", "e.doc_id", "e.page")
    return rows.join(pages, ["doc_id", "page"]).select("qid", (F.col("pos") + 1).alias("rank"), "doc_id", "page", "text")


def chunk_embed(questions: DataFrame, chunks: DataFrame, k: int = 8) -> DataFrame:
    """The k chunks nearest to each question vector: questions (query_id, embedding), chunks (vec_id, embedding)."""
    return R.dense(chunks, questions, k)


def hybrid_rerank(questions: DataFrame, docs: DataFrame, first: DataFrame, k: int = 8, each: int = 50, keep: int = 30) -> DataFrame:
    """The `each` best of `first` (item_id, doc_id, score) and of BM25, fused, the `keep` best of that reranked."""
    a = R.top_k(first, "item_id", each, "doc_id")
    b = R.lexical(docs, questions, each)
    return R.rerank(R.fuse([a, b], "item_id", "doc_id"), docs, questions, keep, k)


def long_context(questions: DataFrame, pages: DataFrame, most: int = 150_000) -> DataFrame:
    """All pages that aren't blank of each question's documents, and whether they fit: qid, rank, doc_id, page, n_words, total_words, applicable."""
    own = questions.select("qid", F.posexplode("doc_ids").alias("pos", "doc_id"))
    rows = own.join(pages.select("doc_id", "page", F.size(words(F.col("text"))).alias("n_words")).filter("n_words > 0"), "doc_id")
    total = F.sum("n_words").over(Window.partitionBy("qid"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("pos", "page"))
    return rows.select("qid", rank.alias("rank"), "doc_id", "page", "n_words", total.alias("total_words"), (total <= most).alias("applicable"))


def doc_cards(docs: DataFrame, tree: DataFrame, pages: DataFrame, most: int = 1500) -> DataFrame:
    """doc_id, card: title, section titles joined by ' / ', and the first page, cut to `most` words."""
    titles = tree.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda x: x["title"]), " / ").alias("sections"))
    first = pages.filter("page = 1").select("doc_id", F.col("text").alias("first"))
    text = F.concat_ws("\n", "title", F.coalesce("sections", F.lit("")), F.coalesce("first", F.lit("")))
    return docs.join(titles, "doc_id", "left").join(first, "doc_id", "left").select("doc_id", F.array_join(F.slice(words(text), 1, most), " ").alias("card"))


def greedy_budget(ranked: DataFrame, by: str, budget: int, rank: str = "rank", size: str = "n_words", key: str = "node_id") -> DataFrame:
    """Rows taken in rank order while they fit the budget, skipping those that don't, until it is full: by, key, rank, size.

    An ordered fold over each group's ranked list, which is as long as the ranking, a top list.
    """
    items = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("rank"), F.col(size).cast("long").alias("size"), F.col(key).alias("key"))))
    kinds = dict(ranked.dtypes)
    empty = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<struct<rank: {kinds[rank]}, size: bigint, key: {kinds[key]}>>").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["size"] <= budget
        return F.when(fits, F.struct((acc["used"] + x["size"]).alias("used"), F.concat(acc["taken"], F.array(x)).alias("taken"))).otherwise(acc)

    folded = ranked.groupBy(by).agg(items.alias("items")).select(by, F.aggregate("items", empty, step)["taken"].alias("taken"))
    return folded.select(by, F.explode("taken").alias("t")).select(by, F.col("t.rank").alias("rank"), F.col("t.size").alias("size"), F.col("t.key").alias(key))


def excerpts(blocks: DataFrame, by: str, budget: int) -> DataFrame:
    """Blocks (by, rank, text) in order, each cut to what is left of the budget in words, none after it is spent.

    Returns by, rank, taken (words), excerpt, truncated (of the whole list: a block was cut or left out).
    """
    w = Window.partitionBy(by).orderBy("rank")
    rows = blocks.select(by, "rank", words(F.col("text")).alias("w")).withColumn("n", F.size("w").cast("long"))
    rows = rows.withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    left = F.greatest(F.lit(0).cast("long"), budget - F.col("before"))
    cut = F.max((F.col("n") > left) | (F.col("before") >= budget)).over(Window.partitionBy(by))
    rows = rows.withColumns({"taken": F.least("n", left), "truncated": cut}).filter(F.col("before") < budget)
    return rows.select(by, "rank", "taken", F.array_join(F.slice("w", 1, F.col("taken").cast("int")), " ").alias("excerpt"), "truncated")


def raptor_levels(leaves: DataFrame, branching: int = 6, most_levels: int = 3, seed: int = 0, summarise: Callable[[Column], Column] | None = None) -> DataFrame:
    """A clustered tree: leaves (doc_id, node_id, start_page, end_page, text, embedding) and the summaries above them.

    Each level clusters a document's nodes into ceil(n / branching) groups while more than `branching`
    are left, at most `most_levels` levels. A parent spans its children's pages, has the mean vector
    and the text that `summarise` makes of its children's texts (the first 120 words of them as it
    stands). Returns doc_id, node_id, level, start_page, end_page, children, text, embedding.
    """
    make = summarise or (lambda texts: F.array_join(F.slice(words(F.array_join(texts, " ")), 1, 120), " "))
    level = leaves.select("doc_id", "node_id", F.lit(0).alias("level"), "start_page", "end_page", F.array().cast("array<string>").alias("children"), "text", "embedding")
    out = level
    for depth in range(1, most_levels + 1):
        sizes = level.groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") > branching)
        todo = level.join(sizes, "doc_id")
        label = _cluster(todo, branching, seed + depth)
        rows = todo.join(label, ["doc_id", "node_id"]).withColumn("pos", F.struct("start_page", "node_id"))
        vectors = rows.select("doc_id", "cluster", F.posexplode("embedding").alias("i", "x")).groupBy("doc_id", "cluster", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
        vectors = vectors.groupBy("doc_id", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"].cast("float")).alias("embedding"))
        parts = F.array_sort(F.collect_list(F.struct("pos", "node_id", "text")))
        up = rows.groupBy("doc_id", "cluster").agg(F.min("start_page").alias("start_page"), F.max("end_page").alias("end_page"), parts.alias("parts"))
        level = up.join(vectors, ["doc_id", "cluster"]).select(
            "doc_id", F.concat_ws("/", F.col("doc_id").cast("string"), F.lit(f"L{depth}"), F.col("cluster").cast("string")).alias("node_id"), F.lit(depth).alias("level"), "start_page", "end_page",
            F.transform("parts", lambda p: p["node_id"]).alias("children"), make(F.transform("parts", lambda p: p["text"])).alias("text"), "embedding",
        )
        out = out.unionByName(level)
    return out


def _cluster(nodes: DataFrame, branching: int, seed: int) -> DataFrame:
    return R.grouped_clusters(nodes, "doc_id", "node_id", "embedding", lambda n: -(-n // branching), seed)


def nearest_documents(questions: DataFrame, cards: DataFrame, scope: DataFrame | None, k: int = 3, groups: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """qid, doc_id, rank, score: the k documents of each question's scope (qid, doc_id) whose cards (doc_id, embedding) are nearest to it (qid, embedding).

    Instead of a scope, groups (qid, group) and (doc_id, group), whose pairs, many times the documents, are never shuffled.
    """
    if groups:
        from . import ivf

        return ivf.within_groups(cards, questions, k, groups, "doc_id", "qid")
    near = scope.select("qid", "doc_id").join(R.small(questions.select("qid", F.col("embedding").alias("q"))), "qid").join(cards.select("doc_id", "embedding"), "doc_id")
    return R.top_k(near.select("qid", "doc_id", R.dot(F.col("embedding"), F.col("q")).alias("score")), "qid", k, "doc_id")


def reads_within(questions: DataFrame, cards: DataFrame, scope: DataFrame | None, reads: DataFrame, k: int = 3, groups: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """qid, seq, doc_id, page, doc_rank: what was read (qid, seq, doc_id, page) in the k nearest documents.

    With groups, as in nearest_documents(), reads are (group, seq, doc_id, page) of all questions of a group.
    """
    best = nearest_documents(questions, cards, scope, k, groups).select("qid", "doc_id", F.col("rank").alias("doc_rank"))
    by = ["qid", "doc_id"]
    if groups:
        best, by = best.join(groups[0].select("qid", "group").distinct(), "qid"), ["group", "doc_id"]
    return reads.join(best, by).select("qid", "seq", "doc_id", "page", "doc_rank")


def raptor(questions: DataFrame, nodes: DataFrame, scope: DataFrame, budget: int = 2000) -> DataFrame:
    """qid, rank, node_id, doc_id, page, end_page, kind: nodes of all levels by their nearness, taken while they fit `budget` words.

    nodes (node_id, doc_id, level, start_page, end_page, text, embedding), scope (qid, doc_id, pos);
    summaries carry their last page. Equal scores go by the scope's order, then by level and node.
    """
    sized = nodes.select("node_id", "doc_id", "level", "start_page", "end_page", F.size(words(F.col("text"))).alias("n_words"), "embedding")
    near = scope.join(R.small(questions.select("qid", F.col("embedding").alias("q"))), "qid").join(sized, "doc_id").withColumn("score", R.dot(F.col("embedding"), F.col("q")))
    order = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "pos", "level", "start_page", "node_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("n_words") <= budget)
    taken = greedy_budget(ranked.select("qid", "rank", "n_words", "node_id"), "qid", budget)
    kind = F.when(F.col("level") == 0, "chunk").otherwise("summary")
    return taken.join(nodes.select("node_id", "doc_id", "level", "start_page", "end_page"), "node_id").select("qid", "rank", "node_id", "doc_id", F.col("start_page").alias("page"), F.when(F.col("level") > 0, F.col("end_page")).alias("end_page"), kind.alias("kind"))
