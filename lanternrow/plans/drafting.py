"""Queries on the drafting stages and their ledger."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from ..operators import stages as G
from ..operators.ledger import Ledger
from ..storage import shared_folder
from .base import PAGES, WORDS, load, pages

QUERIES, SQL = {}, {}


def author(prompt: str) -> dict:
    """Drafts from the first page shown: one good item, one outside the window, one of an unknown type, one without the placeholder."""
    kind = prompt.split("\n", 1)[0].removeprefix("Task: ")
    shown = [(int(n), text.split(" ")) for n, text in re.findall(r"^\[page (\d+)\]\n(.*)$", prompt, re.M)]
    first, words = shown[0]
    quote = " ".join(words[1:6])
    if kind == "facts":
        reply = {"facts": {"coupon_rate": {"value": "5", "page": first, "quote": quote if first % 2 else "not there at all"}}}
    elif kind == "window":
        item = lambda t, q, p: {"qtype": t, "question": q, "kind": "numeric", "answer": "5", "evidence": [p], "quote": quote}
        reply = {"questions": [item("lookup", "What is {product}?", first), item("table", "How is {product}?", first + 100_000), item("poem", "{product}", first), item("computation", "How much?", first)]}
    elif kind == "unanswerable":
        reply = {"questions": [{"question": "Why {product}?", "keywords": words[:1]}]}
    elif kind == "confirm":
        reply = {"answered": len(shown) % 2 == 0, "page": first, "quote": quote}
    elif kind == "terms":
        reply = {"provisions": [{"wording": words[1], "keywords": [], "page": first}, {"wording": "", "keywords": ["zzz"]}, {"wording": "third"}]}
    else:
        _, ts, left, sn, right = re.split(r"\n(\d+)\n(?=\[page )", prompt)
        at = lambda block: re.search(r"\[page (\d+)\]\n(.*)", block)
        a, b = at(left), at(right)
        said = lambda m: " ".join(m[2].split(" ")[1:6])
        other = "not there at all" if int(sn) % 4 == 3 else said(b)
        pages_ = [{"doc_id": ts, "page": int(a[1])}, {"doc_id": sn, "page": int(b[1])}]
        reply = {"questions": [{"question": "Both {product}?", "kind": "free", "answer": "x", "evidence": [*pages_, {"doc_id": "none", "page": 1}], "quotes": [pages_[0] | {"text": said(a)}, pages_[1] | {"text": other}]}]}
    return {"text": "Here: " + json.dumps(reply), "input_tokens": 1, "output_tokens": 1, "finish_reason": "stop"}


SQL["drafted_stages"] = (
    f"WITH p AS (SELECT doc_id, page, {WORDS.format('text')} AS w FROM ({PAGES})), k AS (SELECT doc_id, min(page) AS first FROM p WHERE len(w) >= 10 AND doc_id % 2 = 0 GROUP BY 1), sh AS (SELECT doc_id, count(*) AS n, min(page) AS low FROM p WHERE len(w) > 0 GROUP BY 1), "
    "x AS (SELECT k.doc_id AS ts, k.first, p.doc_id AS sn, len(p.w) AS n FROM k JOIN p ON p.doc_id = k.doc_id + 1 AND p.page = 1), "
    "r AS (SELECT 'facts' AS stage, 'facts:' || doc_id AS task, 0 AS n, CASE WHEN first % 2 = 0 THEN 'quote' END AS reason, doc_id || ':' || first AS evidence FROM k "
    "UNION ALL SELECT 'window', 'window:' || doc_id || ':0', t.n, t.reason, doc_id || ':' || (first + t.off) FROM k, (VALUES (0, NULL, 0), (1, 'evidence outside the window', 100000), (3, 'question does not use the {product} placeholder', 0)) AS t(n, reason, off) "
    "UNION ALL SELECT 'unanswerable', 'unanswerable:' || doc_id || ':0', 0, CASE WHEN sh.n % 2 = 0 THEN 'checker found an answer on p.' || low END, '' FROM k JOIN sh USING (doc_id) "
    "UNION ALL SELECT 'cross_doc', 'cross_doc:' || ts || ':' || sn, 0, CASE WHEN sn % 4 = 3 OR n < 4 THEN 'a quote was not found on its page' END, ts || ':' || first || ',' || sn || ':1' FROM x) "
    "SELECT stage, task, CAST(n AS INTEGER) AS n, CASE WHEN reason IS NULL THEN 'draft' ELSE 'auto_rejected' END AS status, reason, evidence FROM r"
)


def drafted_stages(spark, d):
    """Facts, windows, unanswerable and cross-document questions over the documents of even number, each linked with the next document."""
    p = pages(spark, d).select(F.col("doc_id").cast("string").alias("doc_id"), "page", "text")
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("id"))
    even = docs.filter("id % 2 = 0")
    pairs = even.join(docs.select((F.col("id") - 1).alias("id")), "id").select(F.col("id").cast("string").alias("ts_id"), (F.col("id") + 1).cast("string").alias("sn_id"))
    ledger = Ledger(spark, shared_folder(spark, "drafts"))
    G.draft_all(ledger, even.select(F.col("id").cast("string").alias("doc_id"), F.lit("A").alias("regime"), F.lit("the note").alias("label")), p, pairs, author, least=10)
    shown = F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["doc_id"], e["page"])), ",")
    facts = ledger.rows("facts").select("task", F.explode("records").alias("r")).select(F.lit("facts").alias("stage"), "task", F.lit(0).alias("n"), F.when(F.col("r.quote_ok"), "draft").otherwise("auto_rejected").alias("status"), F.when(~F.col("r.quote_ok"), "quote").alias("reason"), F.concat_ws(":", F.substring_index("task", ":", -1), "r.page").alias("evidence"))
    return facts.unionByName(G.drafts(ledger).select("stage", "task", "n", "status", "reason", shown.alias("evidence")))


QUERIES["drafted_stages"] = drafted_stages
