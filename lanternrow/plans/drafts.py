"""Queries on drafting and checking of questions, and on link and cache sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import row_key
from ..operators import drafting as D
from ..sources import files as S
from .base import GOLD, PAGES, TOKENS, WORDS, gold, load, pages

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("page_windows")
def _(spark, d):
    return D.page_windows(pages(spark, d).select("doc_id", "page", "text"), least=20).select("doc_id", "start", F.size("pages").alias("n"))


@query("topic_focus")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", D.focus(F.col("doc_id"), ["fees", "risk", "tax"]).alias("topic"))


_FACTS = f"SELECT doc_id, page, 'coupon' AS field, CASE WHEN doc_id % 2 = 0 THEN array_to_string(({WORDS.format('text')})[2:6], ' ') ELSE 'not there at all' END AS quote, text FROM ({PAGES})"


@query("checked_facts", rf"SELECT doc_id, page, len({WORDS.format('quote')}) >= 3 AND contains(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g')), trim(regexp_replace(replace(lower(quote), 'ß', 'ss'), '\s+', ' ', 'g'))) AS quote_ok FROM ({_FACTS})")
def _(spark, d):
    p = pages(spark, d)
    facts = p.select("doc_id", F.lit("coupon").alias("field"), F.lit("1").alias("value"), "page", F.when(F.col("doc_id") % 2 == 0, F.array_join(F.slice(T.words(F.col("text")), 2, 5), " ")).otherwise("not there at all").alias("quote"))
    return D.check_facts(facts, p).select("doc_id", "page", "quote_ok")


@query("attribute_values", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS day, CAST(o_custkey AS DOUBLE) / 10 AS num, 'chf' AS cur FROM orders")
def _(spark, d):
    o = load(spark, d, "orders")
    num = D.attribute_value(F.lit("coupon_rate"), F.concat((F.col("o_custkey") / 10).cast("string"), F.lit(" % p.a.")))
    return o.select("o_orderkey", D.attribute_value(F.lit("maturity_date"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"), num.cast("double").alias("num"), D.attribute_value(F.lit("currency"), F.lit(" CHF ")).alias("cur"))


@query("latest_facts", "SELECT user_id AS doc_id, max(event_id) AS line, arg_max(event_type, event_id) AS facts FROM events GROUP BY user_id")
def _(spark, d):
    return D.latest_facts(load(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("line"), F.col("event_type").alias("facts")))


@query("descriptions", "SELECT p_partkey, 'the ' || CASE WHEN p_size % 2 = 0 THEN 'EUR-denominated ' ELSE '' END || p_brand || ' note on ' || CASE p_size % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'A and B' ELSE 'A, B and C' END || ' paying 5% p.a.' AS description FROM part")
def _(spark, d):
    p = load(spark, d, "part")
    unders = F.slice(F.array(F.lit("A"), F.lit("B"), F.lit("C")), 1, F.col("p_size") % 3 + 1)
    attrs = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("currency"), F.lit("coupon"))).otherwise(F.array(F.lit("coupon")))
    facts = F.create_map(F.lit("currency"), F.lit("EUR"), F.lit("coupon"), F.lit("5%"), F.lit("maturity"), F.lit("x"), F.lit("barrier"), F.lit("x"), F.lit("strike"), F.lit("x"))
    return p.select("p_partkey", D.describe(F.col("p_brand"), F.lit("note"), unders, attrs, facts).alias("description"))


@query("window_item_reasons", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'no evidence' WHEN l_linenumber > 4 THEN 'evidence outside the window' WHEN l_returnflag = 'R' THEN 'quote not on page' END AS why FROM lineitem")
def _(spark, d):
    evidence = F.when(F.col("l_linenumber") > 1, F.array("l_linenumber"))
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", D.window_item_reason(evidence, F.array(F.lit(2), F.lit(3), F.lit(4)), F.col("l_returnflag") != "R").alias("why"))


@query("evidence_bounds", "SELECT DISTINCT o_orderkey AS draft_id, CASE WHEN o_orderkey % 5 = 0 THEN 'foreign document' ELSE 'no such page' END AS why FROM orders WHERE o_orderkey % 5 = 0 OR o_custkey % 9 > 6 UNION ALL SELECT o_orderkey, 'document without evidence' FROM orders WHERE o_orderkey % 5 = 0")
def _(spark, d):
    o = load(spark, d, "orders")
    drafts = o.select(F.col("o_orderkey").alias("draft_id"), F.array(F.when(F.col("o_orderkey") % 5 == 0, "b").otherwise("a")).alias("doc_ids"), F.array(F.struct(F.lit("a").alias("doc_id"), (F.col("o_custkey") % 9 + 1).alias("page"))).alias("evidence"))
    return D.evidence_bounds(drafts, spark.createDataFrame([("a", 7), ("b", 7)], "doc_id string, n_pages int"))


_WITHIN = f"q AS (SELECT g.item_id, g.doc_id, b.text FROM ({GOLD}) g JOIN benchmark b USING (item_id)), own AS (SELECT doc_id, page, {TOKENS.format('text')} AS t FROM ({PAGES}) WHERE doc_id IN (SELECT doc_id FROM q)), st AS (SELECT doc_id, count(*) AS n, avg(len(t)) AS avg_len FROM own GROUP BY 1), post AS (SELECT doc_id, page, len, term, count(*) AS tf FROM (SELECT doc_id, page, len(t) AS len, unnest(t) AS term FROM own) GROUP BY ALL), df AS (SELECT doc_id, term, count(*) AS df FROM post GROUP BY ALL), qt AS (SELECT item_id, doc_id, term, count(*) AS times FROM (SELECT item_id, doc_id, unnest({TOKENS.format('text')}) AS term FROM q) GROUP BY ALL), sc AS (SELECT item_id, doc_id, page, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * len / avg_len))) AS score FROM qt JOIN post USING (doc_id, term) JOIN df USING (doc_id, term) JOIN st USING (doc_id) GROUP BY ALL)"


def _asked(spark, d):
    return gold(spark, d).join(load(spark, d, "benchmark").select("item_id", "text"), "item_id")


@query("confirm_scope", f"WITH {_WITHIN}, sz AS (SELECT doc_id, sum(len({WORDS.format('text')})) AS n FROM ({PAGES}) GROUP BY 1) SELECT item_id, q.doc_id, page FROM q JOIN sz USING (doc_id) JOIN ({PAGES}) p USING (doc_id) WHERE sz.n <= 300 UNION ALL SELECT item_id, doc_id, page FROM (SELECT item_id, doc_id, page, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY round(score, 9) DESC, page) AS r FROM sc JOIN sz USING (doc_id) WHERE sz.n > 300) WHERE r <= 5")
def _(spark, d):
    return D.confirm_scope(_asked(spark, d), pages(spark, d), 300, 5)


@query("provision_pages", f"WITH {_WITHIN} SELECT DISTINCT doc_id, page FROM (SELECT doc_id, page, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY round(score, 9) DESC, page) AS r FROM sc) WHERE r <= 3")
def _(spark, d):
    return D.provision_pages(pages(spark, d), _asked(spark, d))


@query("family_labels", "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'economy') THEN 'e' WHEN contains(lower(p_type), 'o') THEN 'o' END AS family FROM part")
def _(spark, d):
    return load(spark, d, "part").select("p_partkey", D.family(F.col("p_type"), [("economy", "e"), ("o", "o")]).alias("family"))


@query("gold_records", f"SELECT item_id AS qid, count(*) AS n FROM ({GOLD}) WHERE item_id NOT IN (SELECT item_id FROM ({GOLD}) WHERE doc_id % 4 = 1) GROUP BY 1")
def _(spark, d):
    g = gold(spark, d)
    rows = g.groupBy(F.col("item_id").alias("qid")).agg(F.collect_list("doc_id").alias("doc_ids"), F.collect_list(F.struct("doc_id", F.lit(0).alias("page"))).alias("evidence"))
    return D.gold_records(rows, load(spark, d, "documents").filter("doc_id % 4 <> 1").select("doc_id")).select("qid", F.size("evidence").cast("long").alias("n"))


@query("parse_cache", "SELECT doc_id, sha256(text) AS sha256, doc_id % 3 > 0 AS hit FROM documents")
def _(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.lit("v2").alias("parser_id"))
    cache = docs.filter("doc_id % 3 > 0").withColumn("n_pages", F.lit(1))
    hits, misses = D.cached(docs, cache, "doc_id", "sha256", "parser_id")
    return hits.select("doc_id", "sha256", F.lit(True).alias("hit")).unionByName(misses.select("doc_id", "sha256", F.lit(False).alias("hit")))


@query("empty_pages", f"SELECT doc_id, count(*) AS n_pages, count(*) FILTER (trim(text) = '') AS n_empty FROM ({PAGES}) GROUP BY doc_id")
def _(spark, d):
    return pages(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.count_if(F.trim("text") == "").alias("n_empty"))


@query("link_dates", r"SELECT page_id, pos, CAST(length(regexp_extract(html, '(?s)<a\s[^>]*href=\"([^\"]*)\"', 1)) AS INTEGER) AS n_href, strptime(d, '%d.%m.%Y')::DATE AS day FROM (SELECT page_id, 0 AS pos, html, lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') || '.03.2026' AS d FROM pages) WHERE regexp_matches(html, '(?s)<a\s[^>]*href=\"')")
def _(spark, d):
    p = load(spark, d, "pages")
    day = F.concat(F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"), F.lit(".03.2026"))
    rows = p.select("page_id", F.concat(F.regexp_extract("html", r'(?s)(<a\s[^>]*href="[^"]*"[^>]*>.*?</a>)', 1), F.lit(" <p>Final Terms ("), day, F.lit(")</p>")).alias("html"))
    return S.link_dates(rows).select("page_id", "pos", F.length("href").alias("n_href"), "day")


@query("manifest_pins", "SELECT CAST(c_custkey AS VARCHAR) AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN 'old' ELSE 'new' END AS sha256, CASE WHEN c_custkey % 2 = 0 THEN 5 END AS pages FROM customer")
def _(spark, d):
    new = load(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("doc_id"), F.lit("new").alias("sha256"), F.lit(None).cast("int").alias("pages"))
    old = new.filter("doc_id % 2 = 0").select("doc_id", F.lit("old").alias("sha256"), F.lit(5).alias("pages"))
    return S.keep_pins(new, old)


@query("decided_ids", "SELECT DISTINCT user_id FROM events WHERE event_type IN ('purchase', 'click')")
def _(spark, d):
    e = load(spark, d, "events")
    return e.filter("event_type = 'purchase'").select("user_id").unionByName(e.filter("event_type = 'click'").select("user_id")).distinct()


@query("native_answer_rows", "SELECT CAST(o_custkey AS VARCHAR) || '|' || arm || '|none|' || o_orderkey AS key, o_totalprice AS latency FROM orders, (VALUES ('nav'), ('nav_native')) AS a(arm)")
def _(spark, d):
    o = load(spark, d, "orders")
    own = o.withColumn("arm", F.lit("nav"))
    both = own.unionByName(own.withColumn("arm", F.lit("nav_native")))
    return both.select(row_key(F.col("o_custkey").cast("string"), F.col("arm"), F.lit("none"), F.col("o_orderkey").cast("string")).alias("key"), F.col("o_totalprice").alias("latency"))


@query("provision_rounds", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'a,b' WHEN 1 THEN 'c,d' ELSE 'e' END AS items FROM orders")
def _(spark, d):
    items = F.array(*(F.lit(x) for x in "abcde"))
    return load(spark, d, "orders").select("o_orderkey", F.array_join(D.paged(items, (F.col("o_orderkey") % 3 + 1).cast("int")), ",").alias("items"))
