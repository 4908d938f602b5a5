"""Queries on navigation: turns, reads, summaries, runs with their own answers."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import navigate as N
from ..operators import retrieval as R
from ..operators import trees as Tr
from ..sources import services as S
from ..storage import shared_folder, written
from .base import GOLD, PAGES, WORDS, gold, load, pages
from .evaluation import _UNIT, _agrees

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


TURNS, TRIES = 5, 2


def walker(prompt: str) -> dict:
    """A navigator that takes documents in their order: it looks at one's structure, reads the node that the item's number
    falls on, and answers after a page with an odd number of words, or after the last document."""
    item = int(re.search(r"^Question: item (\d+)", prompt)[1])
    docs = re.findall(r"^\d+\. \[(\w+)\]", prompt.split("\n\n")[0], re.M)
    blocks = re.split(r"\n\n(?=> )", prompt)[1:]
    structures, reads = ([b for b in blocks if b.startswith(f"> {kind} ")] for kind in ("structure", "pages"))
    odd = bool(reads) and len(reads[-1].split("\n")[2].split()) % 2 == 1
    if len(structures) > len(reads):
        spans = re.findall(r"^\[n\d+\] (\d+-\d+)", structures[-1], re.M)
        act = {"action": "pages", "doc_id": docs[len(reads)], "pages": spans[item % len(spans)]}
    elif odd or len(reads) == len(docs):
        act = {"action": "answer", "answer": f"item {item}"}
    else:
        act = {"action": "structure", "doc_id": docs[len(reads)]}
    return {"text": "```json\n" + json.dumps(act) + "\n```", "input_tokens": 2, "output_tokens": 1, "finish_reason": "stop"}


def _tree(spark, d):
    """Every fourth line from the first on is a heading."""
    # texts are read once, to count their lines
    n = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    lines = written(load(spark, d, "documents").select("doc_id", F.col("source").alias("title"), n.alias("n")), "lines")
    p = lines.select("doc_id", F.explode(F.sequence(F.lit(1), "n", F.lit(4))).alias("page"))
    heads = p.select("doc_id", (F.col("page") / 4).cast("int").alias("pos"), F.concat(F.lit("part "), "page").alias("title"), "page", F.lit(1).alias("level"))
    docs = lines.filter("n is not null").groupBy("doc_id").agg(F.max("n").alias("n_pages")).join(lines.select("doc_id", "title"), "doc_id")
    return written(docs, "docs"), written(Tr.build_tree(heads, docs), "tree")


def _index(spark, d):
    """An index of every document, but for those whose number 7 divides."""
    docs, tree = _tree(spark, d)
    line = F.concat(F.lit("["), "node_id", F.lit("] "), "start_page", F.lit("-"), "end_page", F.lit(" "), "title")
    shown = tree.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("structure"))
    nested = N.nested(tree.withColumn("summary", F.when(F.col("pos") % 2 == 0, F.concat(F.lit("about "), "title"))))
    error = F.when(F.col("doc_id") % 7 == 0, "no tree")
    return tree, written(docs.join(shown, "doc_id").join(nested, "doc_id").withColumns({"description": F.concat(F.lit("from "), "title"), "error": error}), "index")


def _items(spark, d):
    return load(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.concat(F.lit("item "), "item_id").alias("question"))


def _gold_scope(held):
    return held.select(F.col("item_id").alias("qid"), "doc_id", F.col("doc_id").alias("pos"))


_WALK = (
    "lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), n AS (SELECT s.item_id, s.doc_id, row_number() OVER (PARTITION BY s.item_id ORDER BY s.pos, s.doc_id) AS r, l, len(l) AS n_pages, (len(l) + 3) // 4 AS n_nodes, s.item_id % ((len(l) + 3) // 4) AS k FROM s JOIN lines USING (doc_id) WHERE s.doc_id % 7 > 0), "
    f"rd AS (SELECT *, 4 * k + 1 AS first, CASE WHEN k = n_nodes - 1 THEN n_pages ELSE 4 * k + 5 END AS last FROM n), st AS (SELECT *, least(len({WORDS.format('l[first]')}), 1500) % 2 = 1 AS stops FROM rd), "
    f"en AS (SELECT item_id, coalesce(min(r) FILTER (stops), max(r)) AS ends FROM st GROUP BY item_id), oc AS (SELECT item_id, ends, CASE WHEN ends IS NULL THEN CASE WHEN item_id IN (SELECT item_id FROM s) THEN 'index_failed' END WHEN 2 * ends + 1 > {TURNS} THEN 'max_turns' END AS failure, CASE WHEN ends IS NULL THEN 0 WHEN 2 * ends + 1 > {TURNS} THEN {TURNS * TRIES} ELSE 2 * ends + 1 END AS n_calls FROM benchmark LEFT JOIN en USING (item_id)), "
    "ev AS (SELECT item_id, string_agg(doc_id || ':' || p, ' ' ORDER BY r, p) AS evidence, bool_or(p = 1) AS first_page, count(*) FILTER (p = 1) AS n_first FROM (SELECT item_id, doc_id, r, unnest(range(first, last + 1)) AS p FROM st JOIN oc USING (item_id) WHERE failure IS NULL AND r <= ends) GROUP BY item_id)"
)
_WALKED = (
    "SELECT oc.item_id AS qid, failure, CASE WHEN failure IS NULL AND ends IS NOT NULL THEN 'item ' || oc.item_id END AS answer, CAST(n_calls AS BIGINT) AS n_calls, coalesce(evidence, '') AS evidence, CASE WHEN failure IS NULL AND ends IS NOT NULL THEN 'n' || k END AS selected, "
    "CASE WHEN failure IS NULL AND ends IS NOT NULL THEN CAST(1 + CAST(k > 0 AS INTEGER) + CAST(k < n_nodes - 1 AS INTEGER) AS INTEGER) END AS n_visited FROM oc LEFT JOIN ev USING (item_id) LEFT JOIN st ON st.item_id = oc.item_id AND st.r = oc.ends"
)


def _walked(got: N.Retrieved, answer: str):
    ran = got.calls.groupBy("qid").agg(F.count("*").alias("n_calls"))
    pages_ = got.evidence.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "page"))), lambda e: F.concat(e["doc_id"], F.lit(":"), e["page"])), " ").alias("evidence"))
    rows = got.outcomes.join(ran, "qid", "left").join(pages_, "qid", "left").join(got.trace, "qid", "left")
    return rows.select("qid", "failure", F.col(answer).alias("answer"), F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("evidence", F.lit("")).alias("evidence"), "selected", F.when(F.col("visited").isNotNull(), F.size("visited")).alias("n_visited"))


@query("arm_pageindex", f"WITH s AS (SELECT item_id, doc_id, doc_id AS pos FROM ({GOLD})), {_WALK} {_WALKED}")
def _(spark, d):
    tree, index = _index(spark, d)
    got = N.pageindex(_items(spark, d), _gold_scope(gold(spark, d)), index, pages(spark, d), tree, walker, shared_folder(spark, "navigation"), TURNS, TRIES)
    return _walked(got, "native_answer")


_NEAREST = (
    f"v AS ({_UNIT.format('documents')}), q AS ({_UNIT.format('benchmark')}), la AS (SELECT DISTINCT item_id, lang FROM ({GOLD}) JOIN documents USING (doc_id)), "
    "nr AS (SELECT q.item_id, v.doc_id, row_number() OVER (PARTITION BY q.item_id ORDER BY round(q.b / q.l * (v.b / v.l) + q.s / q.l * (v.s / v.l) + 1 / q.l * (1 / v.l), 9) DESC, v.doc_id) AS pos FROM q JOIN la USING (item_id) JOIN v USING (lang)), s AS (SELECT item_id, doc_id, pos FROM nr WHERE pos <= 3)"
)


@query("arm_vec_tree_walk", f"WITH {_NEAREST}, {_WALK} {_WALKED}")
def _(spark, d):
    tree, index = _index(spark, d)
    docs = load(spark, d, "documents")
    langs = gold(spark, d).join(docs.select("doc_id", "lang"), "doc_id").select(F.col("item_id").alias("qid"), "lang").distinct()
    groups = langs.withColumnRenamed("lang", "group"), docs.select("doc_id", F.col("lang").alias("group"))
    vectors = S.embed(load(spark, d, "benchmark").withColumnRenamed("item_id", "qid"), "qid").select("qid", "embedding")
    cards = written(S.embed(docs, "doc_id").select("doc_id", "embedding"), "cards")
    asked = written(_items(spark, d).join(vectors, "qid"), "asked")
    got = N.vec_tree(asked, cards, None, index, pages(spark, d), tree, walker, shared_folder(spark, "navigation"), k=3, groups=groups, turns=TURNS, attempts=TRIES)
    return _walked(got, "sdk_answer")


_CLASS = "CASE WHEN correct THEN NULL WHEN blank THEN 'parse_failure' WHEN coalesce(recall, 0) = 0 THEN 'wrong_page' ELSE 'right_evidence_wrong_answer' END"


@query(
    "navigated_runs",
    f"WITH s AS (SELECT item_id, doc_id, doc_id AS pos FROM ({GOLD})), {_WALK}, gd AS (SELECT item_id, count(*) AS g, bool_or(trim(string_split(d.text, chr(10))[1]) = '') AS blank FROM s JOIN documents d USING (doc_id) GROUP BY 1), "
    "m AS (SELECT oc.item_id, ends, n_calls, oc.failure AS stop, item_id % 3 > 0 AS correct, CASE WHEN item_id % 2 = 0 THEN 'exact' ELSE 'llm' END AS judge, coalesce(blank, false) AS blank, CASE WHEN g > 0 THEN coalesce(n_first, 0) / CAST(g AS DOUBLE) END AS recall FROM oc LEFT JOIN gd USING (item_id) LEFT JOIN ev USING (item_id)), "
    f"ran AS (SELECT item_id, correct, judge, recall, n_calls, ends, {_CLASS} AS failure FROM m WHERE stop IS NULL) "
    "SELECT item_id AS qid, 'pageindex' AS arm, 'reader' AS answerer, correct, judge, round(recall, 6) AS evidence_recall, n_calls + 1 AS llm_calls_sequential, 176 AS tokens_index_amortised, failure FROM ran "
    "UNION ALL SELECT item_id, 'pageindex_native', 'walker', correct, 'llm', round(recall, 6), n_calls, 176, failure FROM ran WHERE ends IS NOT NULL "
    "UNION ALL SELECT item_id, a, b, false, NULL, round(recall, 6), NULL, 176, stop FROM m, (VALUES ('pageindex', 'reader'), ('pageindex_native', 'walker')) AS t(a, b) WHERE stop IS NOT NULL",
)
def _(spark, d):
    tree, index = _index(spark, d)
    p = pages(spark, d).select("doc_id", "page", "text")
    folder = shared_folder(spark, "navigation")
    q = _items(spark, d)
    own = gold(spark, d)
    held = own.groupBy(F.col("item_id").alias("qid")).agg(F.collect_list(F.col("doc_id").cast("string")).alias("doc_ids"))
    kind, value = F.when(F.col("qid") % 2 == 0, "exact").otherwise("free"), F.when(F.col("qid") % 3 == 0, "another").otherwise(F.col("question"))
    asked = q.join(held, "qid", "left").withColumn("doc_ids", F.coalesce("doc_ids", F.array().cast("array<string>")))
    asked = asked.withColumn("evidence", F.transform("doc_ids", lambda x: F.struct(x.alias("doc_id"), F.lit(1).alias("page")))).withColumn("gold", F.struct(kind.alias("kind"), value.alias("value"), F.lit(None).cast("array<string>").alias("values")))
    asked = written(asked, "asked")
    got = N.pageindex(q, _gold_scope(own), index, p, tree, walker, folder, TURNS, TRIES)
    stats = spark.createDataFrame([(1000, 234, None, None)], "input_tokens long, output_tokens long, gpu_s double, cost_usd double")
    prices = spark.createDataFrame([], "model string, input_per_m double, output_per_m double")
    rows = E.run_rows(asked, got.evidence, got.outcomes, got.calls, p.withColumn("doc_id", F.col("doc_id").cast("string")), stats, prices, folder, S.mock_chat, _agrees, "pageindex", "walker", "reader", 7)
    return rows.select("qid", "arm", "answerer", "correct", "judge", F.round("evidence_recall", 6).alias("evidence_recall"), F.col("llm_calls_sequential").cast("long").alias("llm_calls_sequential"), F.col("tokens_index_amortised").cast("int").alias("tokens_index_amortised"), "failure")


@query(
    "shown_summaries",
    f"WITH p AS (SELECT doc_id, CAST(max(page) AS INTEGER) AS n_pages FROM ({PAGES}) GROUP BY 1), h AS (SELECT doc_id, lang, n_pages, CAST(unnest(range(0, (n_pages + 3) // 4)) AS INTEGER) AS k FROM p JOIN documents USING (doc_id)), w AS (SELECT 'q' || lang AS qid, min(doc_id) AS seq0 FROM documents GROUP BY lang), "
    "r AS (SELECT 'q' || lang AS qid, 0 AS o, doc_id AS seq, CAST(doc_id AS VARCHAR) AS doc_id, k, 4 * k + 1 AS page, CASE WHEN k = (n_pages + 3) // 4 - 1 THEN n_pages ELSE 4 * k + 5 END AS end_page, 'part ' || (4 * k + 1) || ': about part ' || (4 * k + 1) AS text FROM h WHERE k % 2 = 0 AND doc_id % 3 < 2 "
    "UNION ALL SELECT 'q' || lang, 1, doc_id, CAST(doc_id AS VARCHAR), 0, 1, n_pages, 'from ' || source FROM documents JOIN p USING (doc_id) WHERE doc_id % 3 > 0) "
    "SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY o, seq, doc_id, k) AS INTEGER) AS rank, doc_id, page, end_page, text FROM r",
)
def _(spark, d):
    _, index = _index(spark, d)
    docs = load(spark, d, "documents").select(F.concat(F.lit("q"), "lang").alias("qid"), F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("doc_id"), (F.col("doc_id") % 3).alias("m"))
    again = docs.unionByName(docs.withColumn("seq", F.col("seq") + 1_000_000))
    kinds = F.explode(F.expr("filter(array('structure', 'description'), w -> (w = 'structure' AND m < 2) OR (w = 'description' AND m > 0))"))
    return N.shown_evidence(again.withColumn("what", kinds), index).select("qid", "rank", "doc_id", "page", "end_page", "text")


def _bundle(content: str, settings: str) -> dict:
    """Builds from a text of an even number of bytes."""
    n = len(content.encode())
    if n % 2:
        raise ValueError(f"{n} bytes")
    return {"tree": "[]", "description": content[:5], "input_tokens": n, "output_tokens": 1}


@query(
    "tree_indexes",
    "WITH t AS (SELECT doc_id, octet_length(encode(text)) AS n, sha256(text) AS sha FROM documents) "
    "SELECT doc_id, CASE WHEN n % 2 = 1 AND NOT hit THEN 3 ELSE 1 END AS attempts, CASE WHEN n % 2 = 1 AND NOT hit THEN 'ValueError: ' || n || ' bytes' END AS error, CASE WHEN hit THEN 7 WHEN n % 2 = 1 THEN 0 ELSE n END AS input_tokens FROM (SELECT *, doc_id % 4 = 0 AS hit FROM t)",
)
def _(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.col("text").alias("content"))
    # built before: a quarter with these settings, a quarter with others, a quarter of another text, a quarter in vain
    m = F.col("doc_id") % 4
    known = docs.select("doc_id", F.when(m == 2, "other").otherwise(F.col("sha256")).alias("sha256"), F.when(m == 1, "old").otherwise("new").alias("settings"), F.lit(1).alias("attempts"), F.when(m == 3, "failed").alias("error"), F.lit("[]").alias("tree"), F.lit("").alias("description"), F.lit(7).cast("long").alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"))
    return N.build_indexes(docs, known, "new", _bundle)[0].select("doc_id", "attempts", "error", "input_tokens")
