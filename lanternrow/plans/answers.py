"""Queries on answers, values, headings, notes and manifests as the given tables' rows spell them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import drafting as D
from ..operators import trees as TR
from ..sources import files as S
from .base import PAGES, load
from .navigation import _tree

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


#: An order's answer: its kind by the order's number, its form by the customer's.
_ANSWERS = """SELECT o_orderkey AS id, list_extract(['numeric', 'exact', 'date', 'date_list', 'free', 'unanswerable'], k + 1) AS kind, k, f, n, iso, CASE k WHEN 0 THEN n WHEN 1 THEN 'Item ' || o_custkey WHEN 2 THEN iso ELSE 'x' END AS value,
    CASE WHEN f = 3 THEN 'It is as follows.' || chr(10) || 'ANSWER: NOT_STATED' WHEN f = 5 THEN NULL
      WHEN k = 0 THEN CASE f WHEN 0 THEN 'ANSWER: ' || n WHEN 1 THEN 'so it is' || chr(10) || 'ANSWER: CHF ' || n || '.00' WHEN 2 THEN 'ANSWER: ' || (CAST(n AS INTEGER) * 2 + 7) ELSE 'well' || chr(10) || ' ' || n || ' % p.a. ' || chr(10) END
      WHEN k = 1 THEN CASE f WHEN 0 THEN 'ANSWER: Item ' || o_custkey WHEN 1 THEN 'x' || chr(10) || 'ANSWER: ITEM  ' || o_custkey || ', and more' || chr(10) || 'ignored' WHEN 2 THEN 'ANSWER: Item ' || o_custkey || 'X' ELSE 'item ' || o_custkey || '.' END
      WHEN k = 2 THEN CASE f WHEN 0 THEN 'ANSWER: ' || strftime(o_orderdate, '%-d.%-m.%Y') WHEN 1 THEN 'ANSWER: ' || strftime(o_orderdate, '%-d %B %Y') WHEN 2 THEN 'ANSWER: 1900-01-01 and ' || iso ELSE 'on ' || strftime(o_orderdate, '%B %-d, %Y') END
      WHEN k = 3 THEN CASE f WHEN 0 THEN 'ANSWER: 02/01/2030; ' || strftime(o_orderdate, '%d.%m.%Y') WHEN 1 THEN 'ANSWER: ' || iso WHEN 2 THEN 'ANSWER: ' || iso || ', 2030-01-02, 2031-01-02' ELSE iso || ' and 2 January 2030' END
      ELSE 'ANSWER: some text' END AS answer
    FROM (SELECT *, CAST(o_orderkey % 6 AS INTEGER) AS k, CAST(o_custkey % 6 AS INTEGER) AS f, CAST(o_orderkey % 997 AS VARCHAR) AS n, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders)"""


def _answers(spark, d):
    o = load(spark, d, "orders")
    k, f, n = (F.col("o_orderkey") % 6).cast("int"), (F.col("o_custkey") % 6).cast("int"), (F.col("o_orderkey") % 997).cast("string")
    day = lambda form: F.date_format("o_orderdate", form)
    iso, item, say = day("yyyy-MM-dd"), F.concat(F.lit("Item "), "o_custkey"), lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v for v in x))
    forms = {
        0: (say("ANSWER: ", n), say("so it is\nANSWER: CHF ", n, ".00"), say("ANSWER: ", (n.cast("int") * 2 + 7).cast("string")), say("well\n ", n, " % p.a. \n")),
        1: (say("ANSWER: ", item), say("x\nANSWER: ITEM  ", F.col("o_custkey"), ", and more\nignored"), say("ANSWER: ", item, "X"), say("item ", F.col("o_custkey"), ".")),
        2: (say("ANSWER: ", day("d.M.yyyy")), say("ANSWER: ", day("d MMMM yyyy")), say("ANSWER: 1900-01-01 and ", iso), say("on ", day("MMMM d, yyyy"))),
        3: (say("ANSWER: 02/01/2030; ", day("dd.MM.yyyy")), say("ANSWER: ", iso), say("ANSWER: ", iso, ", 2030-01-02, 2031-01-02"), say(iso, " and 2 January 2030")),
    }
    answer = F.when(f == 3, "It is as follows.\nANSWER: NOT_STATED").when(f == 5, F.lit(None).cast("string"))
    for kind, by_form in forms.items():
        for form, text in zip((0, 1, 2, 4), by_form, strict=True):
            answer = answer.when((k == kind) & (f == form), text)
    kinds = F.array(*(F.lit(x) for x in ("numeric", "exact", "date", "date_list", "free", "unanswerable")))
    value = F.when(k == 0, n).when(k == 1, item).when(k == 2, iso).otherwise("x")
    return o.select(F.col("o_orderkey").alias("id"), F.get(kinds, k).alias("kind"), answer.otherwise("ANSWER: some text").alias("answer"), value.alias("value"), F.when(k == 3, F.array(iso, F.lit("2030-01-02"))).alias("vs"))


_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_TAIL = _STRIP.format("string_split(answer, 'ANSWER:')[-1]")
_FINAL = f"CASE WHEN answer IS NULL THEN '' WHEN contains(answer, 'ANSWER:') THEN {_STRIP.format('string_split(' + _TAIL + ', chr(10))[1]')} ELSE coalesce(list_filter(list_transform(string_split(answer, chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> '')[-1], '') END"
_REFUSAL = T.REFUSAL.replace("'", "''")


@query("extract_final", f"SELECT id, {_FINAL} AS final FROM ({_ANSWERS})")
def _(spark, d):
    return _answers(spark, d).select("id", T.extract_final(F.coalesce("answer", F.lit(""))).alias("final"))


@query("refusals", f"SELECT id, f = 3 AS refused FROM ({_ANSWERS}) WHERE answer IS NOT NULL UNION ALL SELECT -o_orderkey, regexp_matches('it is ' || lower(o_orderpriority), '{_REFUSAL}') FROM orders")
def _(spark, d):
    own = _answers(spark, d).filter("answer is not null").select("id", "answer")
    spoken = load(spark, d, "orders").select((-F.col("o_orderkey")).alias("id"), F.concat(F.lit("it is "), F.lower("o_orderpriority")).alias("answer"))
    return own.unionByName(spoken).select("id", T.is_refusal(F.col("answer")).alias("refused"))


@query("exact_match", f"WITH s AS (SELECT id, {_FINAL} AS fin, value FROM ({_ANSWERS}) WHERE kind = 'exact'), n AS (SELECT id, trim(regexp_replace(replace(lower(fin), 'ß', 'ss'), '\\s+', ' ', 'g'), ' .,;:') AS a, trim(regexp_replace(replace(lower(value), 'ß', 'ss'), '\\s+', ' ', 'g'), ' .,;:') AS g FROM s) SELECT id, a = g OR (starts_with(a, g) AND regexp_matches(substr(a, length(g) + 1), '^(?:\\s*[,(;]|\\s+[–-]\\s)')) AS matches FROM n".replace("\\\\", "\\"))
def _(spark, d):
    return _answers(spark, d).filter("kind = 'exact'").select("id", V.score(F.coalesce("answer", F.lit("")), F.col("kind"), F.col("value"), F.col("vs"))["correct"].alias("matches"))


@query(
    "score_dispatch",
    "SELECT id, CASE WHEN k = 5 THEN f = 3 WHEN f = 3 THEN false WHEN k = 4 THEN NULL WHEN f = 5 THEN false WHEN k = 3 THEN f IN (0, 4) ELSE f <> 2 END AS correct, CASE WHEN k = 5 THEN 'refusal' WHEN k = 4 AND f <> 3 THEN 'llm' ELSE kind END AS method, CASE WHEN k = 5 AND f <> 3 THEN 'answered_unanswerable' END AS failure "
    f"FROM ({_ANSWERS})",
)
def _(spark, d):
    s = V.score(F.coalesce("answer", F.lit("")), F.col("kind"), F.col("value"), F.col("vs"))
    return _answers(spark, d).select("id", s.alias("s")).select("id", "s.*")


@query(
    "numeric_match",
    "SELECT l_orderkey, l_linenumber, CASE WHEN form = 5 THEN false WHEN form = 8 THEN abs(whole + qty - cents / 100e0) <= 0.005e0 * cents / 100 ELSE true END AS matches FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(round(l_extendedprice * 100) AS BIGINT) // 100 AS whole, CAST(l_quantity AS BIGINT) AS qty, CAST((l_orderkey + l_linenumber) % 9 AS INTEGER) AS form FROM lineitem)",
)
def _(spark, d):
    """Line prices as people write them; a price is met by its spellings, by itself rounded, and by what lies within the tolerance."""
    rows = load(spark, d, "lineitem").withColumn("cents", F.round(F.col("l_extendedprice") * 100).cast("long"))
    rows = rows.withColumns({"whole": F.floor(F.col("cents") / 100), "frac": F.lpad((F.col("cents") % 100).cast("string"), 2, "0"), "form": ((F.col("l_orderkey") + F.col("l_linenumber")) % 9).cast("int")})
    w, frac = F.col("whole").cast("string"), F.col("frac")
    parted = lambda mark: F.regexp_replace(w, r"(\d)(?=(\d{3})+$)", f"$1{mark}")
    plain = F.concat(w, F.lit("."), frac)
    spelled = [
        plain, F.concat(F.lit("CHF "), parted("'"), F.lit("."), frac), F.concat(parted("."), F.lit(","), frac), F.concat(plain, F.lit(" EUR")), w, (F.col("whole") * 2).cast("string"),
        F.concat(w, F.lit(".000")), F.concat(plain, F.lit(" %")), (F.col("whole") + F.col("l_quantity").cast("long")).cast("string"),
    ]
    return rows.select("l_orderkey", "l_linenumber", V.numbers_match(F.get(F.array(*spelled), F.col("form")), plain).alias("matches"))


_MONTHS = "['Januar', 'Februar', 'März', 'April', 'Mai', 'Juni', 'Juli', 'August', 'September', 'Oktober', 'November', 'Dezember']"


@query(
    "date_parse",
    "SELECT o_orderkey, CASE CAST(o_orderkey % 4 AS INTEGER) WHEN 0 THEN iso || ' ' || after WHEN 1 THEN after || ' ' || iso || ' 2028-02-29' WHEN 2 THEN '' ELSE iso || ' ' || iso END AS days FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') AS after FROM orders)",
)
def _(spark, d):
    """Numeric, English and German dates in the order of a text; days that don't exist are none."""
    o = load(spark, d, "orders").withColumn("after", F.col("o_orderdate") + F.expr("INTERVAL 1 DAY"))
    months = F.array(*(F.lit(m) for m in _MONTHS.strip("[]").replace("'", "").split(", ")))
    german = F.concat(F.date_format("after", "d"), F.lit(". "), F.get(months, F.month("after") - 1), F.lit(" "), F.date_format("after", "yyyy"))
    text = (
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("from "), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(" to "), german))
        .when(F.col("o_orderkey") % 4 == 1, F.concat(german, F.lit(", then "), F.date_format("o_orderdate", "d/M/yyyy"), F.lit(", 30.02.2028 or February 29, 2028")))
        .when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("31.02.2028 or 5 Foo 2020 or "), F.date_format("o_orderdate", "MMMM d")))
        .otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" ("), F.date_format("o_orderdate", "d-MMM-yyyy"), F.lit(")")))
    )
    return o.select("o_orderkey", F.array_join(F.transform(V.dates(text), lambda x: x.cast("string")), " ").alias("days"))


@query(
    "sse_usage",
    "SELECT event_id, CASE WHEN event_id % 4 > 0 THEN event_id END AS prompt_tokens, CASE WHEN event_id % 4 > 0 THEN user_id END AS completion_tokens, CASE WHEN event_id % 3 > 0 THEN event_type END AS finish FROM events",
)
def _(spark, d):
    """Token counts and the finish of streams; of several the last counts."""
    line = lambda *x: F.concat(F.lit("data: "), *(F.lit(v) if isinstance(v, str) else v for v in x), F.lit("\n\n"))
    use = lambda p: line('{"usage":{"prompt_tokens":', p, ',"completion_tokens":', F.col("user_id").cast("string"), '},"choices":[]}')
    none = F.lit("")
    body = F.concat(
        F.lit("event: x\n"), line('{"choices":[{"finish_reason":null}]}'), F.when(F.col("event_id") % 4 == 1, use("1")).otherwise(none), F.when(F.col("event_id") % 3 > 0, line('{"choices":[{"finish_reason":"', F.col("event_type"), '"}]}')).otherwise(none),
        F.when(F.col("event_id") % 4 > 0, use(F.col("event_id").cast("string"))).otherwise(none), line("[DONE]"),
    )
    return load(spark, d, "events").select("event_id", T.sse_usage(body).alias("u")).select("event_id", "u.*")


@query(
    "manifest_checks",
    "WITH m AS (SELECT c_custkey, 'doc-' || CASE WHEN c_custkey % 10 = 9 THEN c_custkey - 1 ELSE c_custkey END AS id, c_custkey % 7 = 0 AS a, c_custkey % 5 = 0 AS b, c_custkey % 11 = 0 AS c, c_custkey % 13 = 0 AS e, c_nationkey > 20 AS f FROM customer), n AS (SELECT *, count(*) OVER (PARTITION BY id) AS k FROM m) "
    "SELECT CASE WHEN a THEN upper(id) ELSE id END AS doc_id, 'bad doc_id' AS why FROM n WHERE a UNION ALL SELECT CASE WHEN a THEN upper(id) ELSE id END, w FROM n, (VALUES ('bad regime', 1), ('bad isin', 2), ('bad sha256', 3), ('bad pages', 4)) AS t(w, i) WHERE (i = 1 AND b) OR (i = 2 AND c) OR (i = 3 AND e) OR (i = 4 AND f) "
    "UNION ALL SELECT doc_id, 'repeated doc_id' FROM (SELECT CASE WHEN a THEN upper(id) ELSE id END AS doc_id, count(*) OVER (PARTITION BY CASE WHEN a THEN upper(id) ELSE id END) AS k FROM m) WHERE k > 1",
)
def _(spark, d):
    k = F.col("c_custkey")
    name = F.concat(F.lit("doc-"), F.when(k % 10 == 9, k - 1).otherwise(k))
    rows = load(spark, d, "customer").select(
        F.when(k % 7 == 0, F.upper(name)).otherwise(name).alias("doc_id"), F.when(k % 5 == 0, "C").otherwise("A").alias("regime"), F.when(k % 11 == 0, "CH12").otherwise("CH0012345678").alias("isin"), F.lit("de").alias("language"), F.lit("2026-01-01").alias("issue_date"),
        F.when(k % 13 == 0, "sha256:12").otherwise(F.concat(F.lit("sha256:"), F.sha2("c_name", 256))).alias("sha256"), F.when(F.col("c_nationkey") > 20, "-1").otherwise(F.col("c_nationkey").cast("string")).alias("pages"),
    )
    return S.invalid_manifest(rows)


#: Headings of a customer's orders, by the order's number.
_TITLES = ("Part A", "II. Text", "1. General", "1.2 Detail", "plain words here", "[image]", "Annex 1")


@query(
    "relevel",
    "WITH h AS (SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS pos, CAST(o_orderkey % 7 AS INTEGER) AS t FROM orders), s AS (SELECT *, CASE WHEN t = 0 THEN 'part' WHEN t = 6 THEN 'annex' WHEN t = 1 THEN 'roman' WHEN t IN (2, 3) THEN 'arabic' END AS scheme FROM h), "
    "u AS (SELECT doc_id, scheme, min(pos) AS first FROM s WHERE scheme IS NOT NULL GROUP BY 1, 2), p AS (SELECT *, CASE scheme WHEN 'part' THEN CASE WHEN max(CASE WHEN scheme = 'roman' THEN first END) OVER (PARTITION BY doc_id) < first THEN 21 ELSE 0 END WHEN 'annex' THEN 10 WHEN 'roman' THEN 20 ELSE 60 END AS place FROM u), "
    "r AS (SELECT doc_id, scheme, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS rank FROM p), n AS (SELECT s.doc_id, s.pos, least(rank + CASE WHEN t = 3 THEN 1 ELSE 0 END, 6) AS own FROM s LEFT JOIN r USING (doc_id, scheme)) "
    "SELECT doc_id, pos, CAST(coalesce(own, least(coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 0) + 1, 6)) AS INTEGER) AS level FROM n".replace("least(rank + CASE WHEN t = 3 THEN 1 ELSE 0 END, 6) AS own", "CASE WHEN rank IS NOT NULL THEN least(rank + CASE WHEN t = 3 THEN 1 ELSE 0 END, 6) END AS own"),
)
def _(spark, d):
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    titles = F.array(*(F.lit(t) for t in _TITLES))
    heads = load(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), pos.alias("pos"), F.get(titles, (F.col("o_orderkey") % 7).cast("int")).alias("title"), pos.alias("page"))
    return TR.relevel(heads).select("doc_id", "pos", "level")


@query(
    "navigation_trace",
    f"WITH p AS (SELECT doc_id, CAST(max(page) AS INTEGER) AS n FROM ({PAGES}) GROUP BY 1), k AS (SELECT *, (n - 1) // 4 AS k FROM p) "
    "SELECT doc_id AS qid, CASE WHEN n = 1 THEN 'n0' WHEN k = 0 THEN 'n0' WHEN n = 4 * k + 1 AND k = 1 THEN 'n0,n1' WHEN n = 4 * k + 1 THEN 'n' || (k - 1) || ',n' || k || ',n0' ELSE 'n' || k || ',n0' END AS visited, 'n0' AS selected, "
    "CASE WHEN n = 1 OR k = 0 THEN '' WHEN n = 4 * k + 1 AND k = 1 THEN 'n1' WHEN n = 4 * k + 1 THEN array_to_string(list_sort(['n' || (k - 1), 'n' || k]), ',') ELSE 'n' || k END AS backtracks FROM k",
)
def _(spark, d):
    """Each document read from its last page, then its first."""
    docs, tree = _tree(spark, d)
    both = docs.select(F.col("doc_id").alias("qid"), F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("doc_name"), F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.col("n_pages").alias("page")), F.struct(F.lit(2).alias("seq"), F.lit(1).alias("page")))).alias("r"))
    seen = TR.navigation(both.select("qid", "r.seq", "doc_name", F.array("r.page").alias("pages")), tree.withColumn("doc_id", F.col("doc_id").cast("string")))
    return seen.select("qid", F.array_join("visited", ",").alias("visited"), "selected", F.array_join("backtracks", ",").alias("backtracks"))


_ISSUED = "make_date(2026, 1 + CAST(s_suppkey % 12 AS INTEGER), 1 + CAST(s_suppkey % 28 AS INTEGER))"


@query(
    "linked_notes",
    f"WITH n AS (SELECT s_suppkey AS note_id, s_nationkey AS issuer, {_ISSUED} AS day, count(*) OVER (PARTITION BY s_nationkey) AS k FROM supplier), c AS (SELECT c_custkey AS doc_id, c_nationkey AS issuer, c_custkey % 84 AS s FROM customer) "
    f"SELECT doc_id, note_id FROM c JOIN n USING (issuer) WHERE k = 1 OR (doc_id % 5 > 0 AND day = (SELECT {_ISSUED.replace('s_suppkey', 's')}))",
)
def _(spark, d):
    """Customers' papers that name the date of one of their nation's notes on the first page, or on the third, where it doesn't count."""
    issued = lambda c: F.make_date(F.lit(2026), (1 + c % 12).cast("int"), (1 + c % 28).cast("int"))
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_nationkey").alias("issuer"))
    notes = load(spark, d, "supplier").select(F.col("s_suppkey").alias("note_id"), F.col("s_nationkey").alias("issuer"), issued(F.col("s_suppkey")).alias("note_date"))
    text = F.concat(F.lit("see the Securities Note dated "), T.human_date(issued(F.col("doc_id") % 84)), F.lit("."))
    return D.linked_notes(c, notes, c.select("doc_id", F.when(F.col("doc_id") % 5 == 0, 3).otherwise(1).alias("page"), text.alias("text")))


@query(
    "filing_gold",
    "SELECT l_orderkey, l_linenumber, CASE WHEN f = 4 THEN 'free' ELSE 'numeric' END AS kind, CASE f WHEN 0 THEN '$' || q || ',000.00' WHEN 1 THEN '-' || q || '.5%' WHEN 2 THEN CAST(q AS VARCHAR) WHEN 3 THEN '€ ' || q ELSE q || ' or more' END AS value, CASE WHEN l_linenumber % 3 = 0 THEN 'computation' WHEN l_linenumber % 2 = 0 THEN 'table' ELSE 'lookup' END AS qtype, CASE WHEN l_returnflag <> 'R' THEN 'financebench-' || l_partkey END AS qid "
    "FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q, CAST(l_orderkey % 5 AS INTEGER) AS f FROM lineitem)",
)
def _(spark, d):
    q, f = F.col("l_quantity").cast("long").cast("string"), F.col("l_orderkey") % 5
    answer = F.when(f == 0, F.concat(F.lit("$"), q, F.lit(",000.00"))).when(f == 1, F.concat(F.lit("−"), q, F.lit(".5%"))).when(f == 2, F.concat(F.lit(" "), q, F.lit(" "))).when(f == 3, F.concat(F.lit("€ "), q)).otherwise(F.concat(q, F.lit(" or more")))
    reasoning = F.when(F.col("l_linenumber") % 3 == 0, "Logical reasoning OR Numerical reasoning").when(F.col("l_linenumber") % 3 == 1, "Information extraction")
    kind = F.when(F.col("l_linenumber") % 2 == 0, "metrics-generated").otherwise("novel-generated")
    name = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("x_financebench_id_"), "l_partkey")).otherwise(F.concat(F.lit("financebench_id_"), "l_partkey"))
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", D.filing_gold(answer).alias("g"), D.filing_type(kind, reasoning).alias("qtype"), D.filing_id(name).alias("qid")).select("l_orderkey", "l_linenumber", "g.*", "qtype", "qid")
