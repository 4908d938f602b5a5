"""Queries on text, identity and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as T
from ..operators import questions as Q
from ..operators import retrieval as R
from ..sources import files as S
from .base import PAGES, TOKENS, WORDS, load, pages

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("tokenize_counts", f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_different FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents)")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_different"))


@query("word_counts", f"SELECT doc_id, len({WORDS.format('text')}) AS n_words FROM documents")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", F.size(T.words(F.col("text"))).cast("long").alias("n_words"))


@query("page_explode", f"SELECT doc_id, page, len({WORDS.format('text')}) AS n_words, trim(text) = '' AS blank FROM ({PAGES})")
def _(spark, d):
    return pages(spark, d).select("doc_id", "page", F.size(T.words(F.col("text"))).cast("long").alias("n_words"), (F.trim("text") == "").alias("blank"))


@query("content_pages", f"SELECT doc_id, page, n FROM (SELECT doc_id, page, len({WORDS.format('text')}) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS nth FROM ({PAGES}) WHERE len({WORDS.format('text')}) >= 20) WHERE nth <= 3")
def _(spark, d):
    rows = pages(spark, d).withColumn("n", F.size(T.words(F.col("text"))).cast("long")).filter("n >= 20")
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))).filter("nth <= 3").select("doc_id", "page", "n")


@query("markdown_tables", r"SELECT l_orderkey, l_linenumber, regexp_matches(md, '(?m)^\s*\|.*\|\s*\n\s*\|[\s:|-]+\|\s*$') AS has_table FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN concat('| ', l_shipmode, ' | n |', chr(10), '|---|---|') ELSE concat('| ', l_shipmode) END AS md FROM (SELECT l_orderkey, l_linenumber, l_returnflag AS l_shipmode FROM lineitem))")
def _(spark, d):
    md = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("| "), "l_returnflag", F.lit(" | n |\n|---|---|"))).otherwise(F.concat(F.lit("| "), "l_returnflag"))
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.has_table(md).alias("has_table"))


@query("dev_test_split", "SELECT c_custkey, CASE WHEN CAST(CAST(('0x' || substr(sha256('7:' || c_name), 1, 16)) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0 < 0.2 THEN 'dev' ELSE 'test' END AS split FROM customer")
def _(spark, d):
    return load(spark, d, "customer").select("c_custkey", H.assign_split(7, F.col("c_name")).alias("split"))


@query("hash_shards", "SELECT c_custkey, CAST(list_reduce(list_transform(string_split(sha256(c_name), ''), lambda c: CAST(instr('0123456789abcdef', c) - 1 AS BIGINT)), lambda a, c: (a * 16 + c) % 7, CAST(0 AS BIGINT)) AS INTEGER) AS shard FROM customer")
def _(spark, d):
    return load(spark, d, "customer").select("c_custkey", H.shard_of(F.col("c_name"), 7).alias("shard"))


@query("slug_ids", "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def _(spark, d):
    return load(spark, d, "part").select("p_partkey", T.slug(F.concat("p_name", F.lit(" / "), "p_type")).alias("slug"))


@query("chunk_cache_keys", "SELECT doc_id, substr(sha256(concat_ws('|', sha256(text), 'model', '200', '40')), 1, 24) AS key, 'sha256:' || sha256(text) AS file FROM documents")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", H.chunk_key(F.sha2("text", 256), "model", 200, 40).alias("key"), H.file_hash(F.col("text")).alias("file"))


_LUHN = "list_reverse(string_split(array_to_string(list_transform(string_split(body, ''), lambda c: CAST(instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1 AS VARCHAR)), ''), ''))"


@query("isin_check_digit", f"SELECT p_partkey, body || CAST((10 - list_sum(list_transform(range(1, len(r) + 1), lambda i: CASE WHEN i % 2 = 1 THEN (CAST(r[i] AS INTEGER) * 2) // 10 + (CAST(r[i] AS INTEGER) * 2) % 10 ELSE CAST(r[i] AS INTEGER) END)) % 10) % 10 AS VARCHAR) AS isin FROM (SELECT p_partkey, body, {_LUHN} AS r FROM (SELECT p_partkey, 'CH' || lpad(CAST(p_partkey * 7919 AS VARCHAR), 9, '0') AS body FROM part))")
def _(spark, d):
    return load(spark, d, "part").select("p_partkey", H.isin_from_valor(F.col("p_partkey") * 7919).alias("isin"))


@query("exclusion_screen", "SELECT doc_id FROM documents WHERE NOT (contains(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g'), 'mit license') OR contains(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g'), 'cc by-nc'))".replace("\\\\", "\\"))
def _(spark, d):
    return Q.excluded(load(spark, d, "documents"), spark.createDataFrame([("MIT  License",), ("CC BY-NC",)], "name string"), "text").select("doc_id")


@query(
    "manifest_screen",
    r"WITH n AS (SELECT DISTINCT trim(regexp_replace(replace(lower(substr(p_name, 1, 12)), 'ß', 'ss'), '\s+', ' ', 'g')) AS name FROM part UNION SELECT DISTINCT lower(regexp_extract(text, '([\p{L}]{6,})', 1)) FROM benchmark WHERE regexp_matches(text, '[\p{L}]{6,}')) "
    r"SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM n WHERE name <> '' AND contains(trim(regexp_replace(replace(lower(d.text), 'ß', 'ss'), '\s+', ' ', 'g')), replace(name, 'ß', 'ss')))",
)
def _(spark, d):
    """Documents that mention none of the parts' names nor the first long word of any question."""
    words = load(spark, d, "benchmark").select(F.regexp_extract("text", r"(\p{L}{6,})", 1).alias("name"))
    return Q.excluded(load(spark, d, "documents"), load(spark, d, "part").select(F.substring("p_name", 1, 12).alias("name")).unionByName(words), "text").select("doc_id")


@query("snippets", r"SELECT doc_id, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 300) AS snippet FROM documents")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query("regex_search", r"SELECT doc_id, page, unnest(range(1, len(m) + 1)) AS nth, unnest(m) AS hit FROM (SELECT doc_id, page, regexp_extract_all(regexp_replace(text, '\s+', ' ', 'g'), '(?i).{0,40}licen[cs]e.{0,40}') AS m FROM (" + PAGES + ")) WHERE len(m) > 0")
def _(spark, d):
    hits = F.regexp_extract_all(T.collapse(F.col("text")), F.lit(r"(?i).{0,40}licen[cs]e.{0,40}"), F.lit(0))
    return pages(spark, d).select("doc_id", "page", F.posexplode(hits).alias("at", "hit")).select("doc_id", "page", (F.col("at") + 1).cast("long").alias("nth"), "hit")


@query("chunk_windows", f"SELECT doc_id, page, CAST(s AS INTEGER) AS start, doc_id || ':' || page || ':' || s AS chunk_id, array_to_string(w[s + 1:s + 200], ' ') AS text FROM (SELECT doc_id, page, w, unnest(CASE WHEN len(w) <= 200 THEN [0] ELSE range(0, CAST(ceil((len(w) - 200) / 160.0) * 160 + 1 AS BIGINT), 160) END) AS s FROM (SELECT doc_id, page, {WORDS.format('text')} AS w FROM ({PAGES})) WHERE len(w) > 0)")
def _(spark, d):
    return R.chunk(pages(spark, d))


#: Drafted answers of every kind and form, from orders.
_DRAFTED = """SELECT o_orderkey AS id, list_extract(['numeric', 'exact', 'date', 'date_list', 'free', 'bogus'], CAST(o_orderkey % 6 + 1 AS INTEGER)) AS kind,
    CASE o_custkey % 9 WHEN 0 THEN 'CHF 1' || chr(39) || n || '.00' WHEN 1 THEN ' ' || n || '.5 % of the initial price' WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') || ', 2027-01-02;2028-03-04'
    WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%d') || ' and 2027-01-02' WHEN 5 THEN 'about ' || o_orderpriority WHEN 6 THEN n || ' shares' WHEN 7 THEN '-' || n || ' per share' END AS answer
    FROM (SELECT *, CAST(o_orderkey % 997 AS VARCHAR) AS n FROM orders)"""


@query("normalise_answers", rf"""WITH t AS (SELECT id, CASE WHEN kind = 'bogus' THEN 'free' ELSE kind END AS kind, trim(coalesce(answer, '')) AS a FROM ({_DRAFTED})),
    p AS (SELECT *, list_filter(list_transform(regexp_split_to_array(a, '[,;]\s*|\s+and\s+'), lambda x: trim(x)), lambda x: x <> '') AS parts, regexp_extract(a, '^((?:[A-Z]{{3}}\s?)?-?\d[\d.,'']*\s?%?)(?:\s+(?:of|per)\b.*)?$', 1) AS amount FROM t),
    q AS (SELECT *, len(parts) > 1 AND len(list_filter(parts, lambda x: NOT regexp_full_match(x, '\d{{4}}-\d{{2}}-\d{{2}}'))) = 0 AS dates FROM p)
    SELECT id, CASE WHEN kind IN ('date_list', 'free') AND dates THEN 'date_list' WHEN kind IN ('numeric', 'exact') AND amount <> '' THEN 'numeric' WHEN kind IN ('numeric', 'date_list') THEN 'free' WHEN kind = 'date' AND NOT regexp_full_match(a, '\d{{4}}-\d{{2}}-\d{{2}}') THEN 'free' ELSE kind END AS kind,
    CASE WHEN kind IN ('date_list', 'free') AND dates THEN NULL WHEN kind IN ('numeric', 'exact') AND amount <> '' THEN trim(amount) ELSE a END AS value, CASE WHEN kind IN ('date_list', 'free') AND dates THEN array_to_string(parts, '|') END AS vs FROM q""")
def _(spark, d):
    day, n = F.date_format("o_orderdate", "yyyy-MM-dd"), (F.col("o_orderkey") % 997).cast("string")
    forms = [F.concat(F.lit("CHF 1'"), n, F.lit(".00")), F.concat(F.lit(" "), n, F.lit(".5 % of the initial price")), day, F.concat(day, F.lit(", 2027-01-02;2028-03-04")), F.concat(day, F.lit(" and 2027-01-02")), F.concat(F.lit("about "), "o_orderpriority"), F.concat(n, F.lit(" shares")), F.concat(F.lit("-"), n, F.lit(" per share")), F.lit(None).cast("string")]
    kinds = F.array(*(F.lit(k) for k in ("numeric", "exact", "date", "date_list", "free", "bogus")))
    rows = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.get(kinds, (F.col("o_orderkey") % 6).cast("int")).alias("kind"), F.get(F.array(*forms), (F.col("o_custkey") % 9).cast("int")).alias("answer"))
    return rows.select("id", Q.normalise_answer(F.col("kind"), F.col("answer")).alias("a")).select("id", "a.kind", "a.value", F.array_join("a.values", "|").alias("vs"))


@query("parsed_evidence", "SELECT o_orderkey, 'doc:' || o_custkey AS doc_id, CAST(o_orderkey % 9 AS INTEGER) AS page FROM orders UNION ALL SELECT o_orderkey, 'b', 3 FROM orders")
def _(spark, d):
    text = F.concat(F.lit(" doc:"), "o_custkey", F.lit(":"), F.col("o_orderkey") % 9, F.lit(", b: 3,"))
    return load(spark, d, "orders").select("o_orderkey", F.explode(T.parse_evidence(text)).alias("e")).select("o_orderkey", "e.doc_id", "e.page")


@query("json_replies", "SELECT event_id, CAST(event_id % 5 AS BIGINT) AS a, event_type AS b FROM events")
def _(spark, d):
    reply = F.concat(F.lit("Sure:\n```json\n{\"a\": "), F.col("event_id") % 5, F.lit(", \"b\": \""), "event_type", F.lit("\"}\n``` thanks"))
    return load(spark, d, "events").select("event_id", T.parse_json(reply, "a bigint, b string").alias("r")).select("event_id", "r.*")


@query("html_table_rows", r"SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, list_transform(regexp_extract_all(trs[i], '(?s)<t[dh][^>]*>(.*?)</t[dh]>', 1), lambda c: trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(c, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))) AS cells FROM (SELECT page_id, regexp_extract_all(html, '(?s)<tr[^>]*>(.*?)</tr>', 1) AS trs FROM pages), UNNEST(range(1, len(trs) + 1)) AS u(i)")
def _(spark, d):
    return S.html_rows(load(spark, d, "pages"))


@query("links_keep_first", r"SELECT href, page_id, pos FROM (SELECT href, page_id, pos, row_number() OVER (PARTITION BY href ORDER BY page_id, pos) AS nth FROM (SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, regexp_extract(a[i], 'href=\"([^\"]*)\"', 1) AS href FROM (SELECT page_id, regexp_extract_all(html, '(?s)(<a\s[^>]*href=\"[^\"]*\"[^>]*>.*?</a>)', 1) AS a FROM pages), UNNEST(range(1, len(a) + 1)) AS u(i))) WHERE nth = 1")
def _(spark, d):
    return S.first_links(S.html_links(load(spark, d, "pages"))).select("href", "page_id", "pos")


@query("fuzzy_quotes")
def _(spark, d):
    from ..sources.services import fuzzy_quotes

    # quotes of even pages as they stand, of odd ones with a word that was misread, or two that weren't there
    own = F.slice(T.words(F.col("text")), 2, 8)
    word = F.element_at(own, 3)
    misread = F.transform(own, lambda w, i: F.when(i == 2, F.concat(F.lit("l"), F.substring(word, 2, 1 << 30))).otherwise(w))
    parts = F.when(F.col("page") % 2 == 0, own).when(F.col("page") % 4 == 1, misread).otherwise(F.concat(own, F.array(F.lit("entirely"), F.lit("elsewhere"))))
    rows = pages(spark, d).filter(F.size(T.words(F.col("text"))) >= 9).select("doc_id", "page", F.array_join(parts, " ").alias("quote"), F.col("text"))
    return fuzzy_quotes(rows, "quote", "text").select("doc_id", "page", "on_page")


@query("page_verify")
def _(spark, d):
    from ..sources.services import best_page

    own = pages(spark, d)
    wanted = own.select("doc_id", F.col("page").alias("mapped"), "text")
    return best_page(wanted, own).select("doc_id", "mapped", "page", F.round("ratio", 6).alias("ratio"))


@query("llm_answer_mock", "SELECT item_id, 'ANSWER: ' || trim(string_split(text, chr(10))[-1]) AS text FROM benchmark")
def _(spark, d):
    from ..sources.services import complete

    return complete(load(spark, d, "benchmark").select(F.col("item_id"), F.col("text").alias("prompt")), "item_id").select("item_id", "text")
