"""Queries on fetching, settings and review."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import config as C
from ..operators import review as V
from ..sources.fetch import fetch
from ..storage import BATCH_BYTES, bounded_batches, written
from .base import load

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _stored(row: dict) -> tuple[int, bytes]:
    return (404 if row["page_id"] % 17 == 0 else 200), (row["given"] or "").encode()


@query(
    "fetched_pages",
    r"WITH p AS (SELECT page_id, url, html, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, page_id % 13 = 0 AS manual, NOT contains(url, 'page=') AS allowed, CASE WHEN page_id % 11 = 0 THEN 'sha256:0' WHEN page_id % 5 = 0 THEN 'sha256:' || sha256(html) END AS pin FROM pages), "
    "s AS (SELECT *, NOT manual AND allowed AS sent, 2e0 * count(*) FILTER (NOT manual AND allowed) OVER (PARTITION BY host ORDER BY url, page_id ROWS UNBOUNDED PRECEDING) AS t FROM p), "
    "r AS (SELECT *, CASE WHEN manual THEN 'manual document: download it by hand' WHEN NOT allowed THEN 'robots.txt disallows it' WHEN page_id % 17 = 0 THEN 'HTTP 404' WHEN NOT starts_with(html, '<!DOCTYPE') THEN 'not a document of the kind' WHEN pin <> 'sha256:' || sha256(html) THEN 'sha256 mismatch' END AS reason FROM s) "
    "SELECT page_id, CASE WHEN reason IS NULL THEN 'fetched' ELSE 'failed' END AS status, reason, CASE WHEN reason IS NULL OR reason = 'sha256 mismatch' THEN 'sha256:' || sha256(html) END AS sha256, CASE WHEN reason IS NULL THEN octet_length(encode(html)) END AS n_bytes, CASE WHEN sent THEN t END AS at FROM r",
)
def _(spark, d):
    """Stored pages fetched as from their hosts, whose robots keep listings out."""
    pin = F.when(F.col("page_id") % 11 == 0, "sha256:0").when(F.col("page_id") % 5 == 0, F.concat(F.lit("sha256:"), F.sha2("html", 256)))
    asked = load(spark, d, "pages").select("page_id", "url", pin.alias("sha256"), (F.col("page_id") % 13 == 0).alias("manual"), "html")
    got = fetch(asked, _stored, lambda host: "User-agent: *\nDisallow: /*page=", b"<!DOCTYPE", key="page_id", given="html").drop("body")
    # stored, as its batches are bounded then; rows are digests
    with bounded_batches(spark, BATCH_BYTES):
        return written(got, "fetched")


@query(
    "config_hashes",
    """SELECT c_custkey, 'sha256:' || sha256('{"arms":["' || c_mktsegment || '",null],"hostname":"h' || c_nationkey || '","seed":' || c_custkey || '}') AS config, 'sha256:' || sha256('{"arms":["' || c_mktsegment || '",null],"seed":' || c_custkey || '}') AS manifest, substr(sha256(c_custkey || '|e|i|6|3|120|200|40|7|{}'), 1, 24) AS tree FROM customer""",
)
def _(spark, d):
    text = F.concat(F.lit('{ "seed": '), F.col("c_custkey").cast("string"), F.lit(', "hostname" :"h'), "c_nationkey", F.lit('", "arms": ["'), "c_mktsegment", F.lit('", null]}'))
    return load(spark, d, "customer").select("c_custkey", C.config_hash(text).alias("config"), C.manifest_hash(text).alias("manifest"), C.raptor_key(F.col("c_custkey").cast("string"), "e", "i", 6, 3, 120, 200, 40, 7).alias("tree"))


@query(
    "parsed_answers",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS value, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_custkey % 2 = 0 THEN o_orderpriority || '+2026-02-01+x' ELSE '' END END AS vals FROM orders",
)
def _(spark, d):
    kind = F.when(F.col("o_orderstatus") == "F", "date_list").when(F.col("o_orderstatus") == "O", "exact").otherwise("unanswerable")
    text = F.when(kind != "date_list", F.concat(F.lit(" "), "o_orderpriority", F.lit("\n"))).otherwise(F.when(F.col("o_custkey") % 2 == 0, F.concat("o_orderpriority", F.lit(" ;2026-02-01,\n,x"))).otherwise(" ; "))
    return load(spark, d, "orders").select("o_orderkey", V.parse_answer(kind, text).alias("a")).select("o_orderkey", "a.value", F.array_join("a.values", "+").alias("vals"))


@query(
    "draft_views",
    "SELECT p_partkey AS draft_id, CASE WHEN p_size % 2 = 0 THEN 'The product with ISIN ' || p_brand || ' pays?' ELSE '{product} pays?' END AS by_isin, CASE WHEN p_size % 2 = 0 AND p_partkey % 3 > 0 THEN 'The ' || p_type || ' pays?' END AS by_description, 'd' || p_partkey || ':1' AS evidence, "
    "CASE WHEN (p_partkey + 1) % 2 = 0 THEN (SELECT CAST(s.p_size AS VARCHAR) FROM part s WHERE s.p_partkey = part.p_partkey + 1) END AS sibling_value, CASE WHEN (p_partkey + 1) % 3 > 0 THEN (SELECT 'the ' || s.p_type FROM part s WHERE s.p_partkey = part.p_partkey + 1) END AS sibling_description, p_name AS page FROM part",
)
def _(spark, d):
    p = load(spark, d, "part").withColumn("doc_id", F.concat(F.lit("d"), "p_partkey"))
    drafts = p.select(
        F.col("p_partkey").alias("draft_id"), F.when(F.col("p_size") % 2 == 0, "A").otherwise("B").alias("regime"), F.array("doc_id").alias("doc_ids"), F.col("p_brand").alias("isin"), F.lit("{product} pays?").alias("question"), F.lit("x").alias("answer"),
        F.array(F.struct("doc_id", F.lit(1).alias("page"))).alias("evidence"), F.lit("coupon").alias("field"), F.array(F.concat(F.lit("d"), F.col("p_partkey") + 1)).alias("siblings"),
    )
    facts = p.filter("p_partkey % 2 = 0").select("doc_id", F.lit("coupon").alias("field"), F.col("p_size").cast("string").alias("value"))
    seen = V.draft_view(drafts, p.filter("p_partkey % 3 > 0").select("doc_id", F.concat(F.lit("the "), "p_type").alias("description")), facts, p.select("doc_id", F.lit(1).alias("page"), F.col("p_name").alias("text")))
    near = F.get("siblings", F.lit(0))
    return seen.select("draft_id", "by_isin", "by_description", "evidence", near["value"].alias("sibling_value"), near["description"].alias("sibling_description"), F.get("pages", F.lit(0))["text"].alias("page"))


_DECIDED = "SELECT o_orderkey, o_custkey % 7 > 0 AS known, CASE o_orderstatus WHEN 'F' THEN 'accept' WHEN 'O' THEN 'reject' ELSE 'maybe' END AS action, o_orderkey % 10 = 0 AS mute, o_custkey % 3 = 0 AS un, CASE WHEN o_custkey % 4 = 0 THEN 'none' WHEN o_custkey % 5 = 0 THEN 'b' ELSE 'a' END AS doc FROM orders"


@query(
    "decision_problems",
    f"WITH d AS ({_DECIDED}) SELECT o_orderkey AS draft_id, 'every decision needs a reason' AS problem FROM d WHERE mute UNION ALL SELECT o_orderkey, 'unknown action' FROM d WHERE action = 'maybe' UNION ALL SELECT o_orderkey, 'unknown draft' FROM d WHERE NOT known "
    "UNION ALL SELECT o_orderkey, 'an answer without evidence' FROM d WHERE action = 'accept' AND NOT un AND known AND doc = 'none' UNION ALL SELECT o_orderkey, 'evidence on another document' FROM d WHERE action = 'accept' AND NOT un AND known AND doc = 'b'",
)
def _(spark, d):
    o = load(spark, d, "orders").withColumnRenamed("o_orderkey", "draft_id")
    page = lambda doc: F.array(F.struct(F.lit(doc).alias("doc_id"), F.lit(1).alias("page")))
    evidence = F.when(F.col("o_custkey") % 4 == 0, F.array().cast("array<struct<doc_id: string, page: int>>")).when(F.col("o_custkey") % 5 == 0, page("b")).otherwise(page("a"))
    action = F.when(F.col("o_orderstatus") == "F", "accept").when(F.col("o_orderstatus") == "O", "reject").otherwise("maybe")
    made = o.select("draft_id", action.alias("action"), F.when(F.col("draft_id") % 10 == 0, " ").otherwise("because").alias("reason"), F.when(F.col("o_custkey") % 3 == 0, "unanswerable").alias("kind"), evidence.alias("evidence"))
    drafts = o.filter("o_custkey % 7 > 0").select("draft_id", F.array(F.lit("a")).alias("doc_ids"), F.lit("exact").alias("kind"), page("a").alias("evidence"))
    return V.decision_problems(made, drafts)


@query(
    "new_products",
    "WITH f AS (SELECT c_custkey % 500 AS doc_id, c_custkey AS pos, c_name || ' ' || c_mktsegment AS name FROM customer), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM f) WHERE n = 1) SELECT doc_id, pos FROM o WHERE doc_id >= 50 AND NOT contains(lower(name), 'building') AND NOT contains(lower(name), '77 mach')",
)
def _(spark, d):
    c = load(spark, d, "customer")
    found = c.select((F.col("c_custkey") % 500).alias("doc_id"), F.col("c_custkey").alias("pos"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("name"))
    return V.new_products(found, found.filter("doc_id < 50"), spark.createDataFrame([("Building",), ("77  MACH",)], "name string")).select("doc_id", "pos")
