"""Heading trees: numbering schemes, levels, page ranges, and navigation over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import dealt, written

#: Heading numbering schemes, highest first, and the deepest level.
SCHEMES = [
    ("part", r"(?i)^(part|teil)\s+([ivx]+|\d+|[a-z])\b"),
    ("annex", r"(?i)^(annex|anhang|appendix|schedule)\b"),
    ("roman", r"^[IVX]+\.\s"),
    ("caps", r"^(?=[^a-zäöü]*$)(?=.*[A-ZÄÖÜ]{3}.*\s.*[A-ZÄÖÜ]{3})"),
    ("item", r"(?i)^(item|article|artikel|section|abschnitt)\s+[\divx]+"),
    ("letter", r"^[A-Z]\.\s"),
    ("arabic", r"^\d+(\.\d+)*\.?\s"),
    ("para", r"^§\s*\d+"),
    ("note", r"(?i)^note\s+\d+"),
    ("paren", r"^\(([a-z]|[ivx]+|\d+)\)\s"),
]
MAX_LEVEL = 6
MIN_OUTLINE = 10


def heading_scheme(title: Column) -> Column:
    """The name of the first scheme that a heading has; null for plain ones and placeholders in brackets."""
    t = F.trim(title)
    out = F.when((t == "") | t.startswith("["), F.lit(None).cast("string"))
    for name, pattern in SCHEMES:
        out = out.when(t.rlike(pattern), F.lit(name))
    return out


def heading_depth(title: Column) -> Column:
    """Components of an arabic number less one, else 0."""
    number = F.regexp_extract(F.trim(title), r"^(\d+(?:\.\d+)*)", 1)
    return F.when(heading_scheme(title) == "arabic", F.size(F.split(number, r"\.")) - 1).otherwise(F.lit(0))


def relevel(headings: DataFrame) -> DataFrame:
    """Levels from numbering: headings (doc_id, pos, title, page) with level.

    A document's schemes rank in the order above among those it uses; parts come just below roman
    ones where a roman heading is first. A plain heading is one below the last numbered one.
    """
    order = F.create_map(*(x for i, (n, _) in enumerate(SCHEMES) for x in (F.lit(n), F.lit(i * 10))))
    rows = headings.withColumns({"scheme": heading_scheme(F.col("title")), "depth": heading_depth(F.col("title"))})
    used = rows.filter("scheme is not null").groupBy("doc_id", "scheme").agg(F.min("pos").alias("first"))
    at = lambda name: F.max(F.when(F.col("scheme") == name, F.col("first"))).over(Window.partitionBy("doc_id"))
    moved = (F.col("scheme") == "part") & (at("roman") < at("part"))
    used = used.withColumn("place", F.when(moved, F.lit([i for i, (n, _) in enumerate(SCHEMES) if n == "roman"][0] * 10 + 1)).otherwise(F.try_element_at(order, F.col("scheme"))))
    used = used.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("place"))).select("doc_id", "scheme", "rank")
    rows = rows.join(used, ["doc_id", "scheme"], "left")
    numbered = F.when(F.col("rank").isNotNull(), F.least(F.col("rank") + F.col("depth"), F.lit(MAX_LEVEL)))
    before = F.last(numbered, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    level = F.coalesce(numbered, F.least(F.coalesce(before, F.lit(0)) + 1, F.lit(MAX_LEVEL)))
    return rows.select("doc_id", "pos", "title", "page", level.cast("int").alias("level"))


def build_tree(headings: DataFrame, docs: DataFrame) -> DataFrame:
    """headings (doc_id, pos, title, page, level) as nodes: doc_id, node_id, parent, title, start_page, end_page, level, pos.

    The parent is the nearest earlier heading of a smaller level; the end is the page of the next
    heading of no greater level, else the last page. docs (doc_id, title, n_pages): a document
    without headings is one root. Headings are stored and dealt so that a task sorts a bounded number of
    them, however many there are.
    """
    headings = written(headings.select("doc_id", "pos", "title", "page", "level"), "headings")
    # running values a level that occurs instead of joins of all pairs of headings; levels go from 1 to MAX_LEVEL
    levels = sorted(r["level"] for r in headings.filter(F.col("level").between(1, MAX_LEVEL)).select("level").distinct().collect()) or [1]
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("doc_id").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, -1)
    at = lambda k, c: F.when(F.col("level") == k, c)
    last = {k: F.last(at(k, F.col("pos")), ignorenulls=True).over(before) for k in levels}
    after = {k: F.last(at(k, F.struct("pos", "page")), ignorenulls=True).over(behind) for k in levels}
    rows = written(headings.join(docs.select("doc_id", "n_pages"), "doc_id"), "headings-of-docs")
    rows = dealt(rows, "doc_id").withColumns({f"__u{k}": c for k, c in last.items()} | {f"__d{k}": c for k, c in after.items()})
    above = F.greatest(F.lit(None).cast("int"), *(F.when(F.col("level") > k, F.col(f"__u{k}")) for k in last))
    below = F.least(F.lit(None).cast(dict(rows.dtypes)[f"__d{levels[0]}"]), *(F.when(F.col("level") >= k, F.col(f"__d{k}")) for k in after))
    rows = rows.withColumns({"ppos": above, "npage": below["page"]})
    end = F.when(F.col("npage").isNull(), F.col("n_pages")).otherwise(F.greatest("page", "npage"))
    name = lambda p: F.concat(F.lit("n"), p.cast("string"))
    nodes = rows.select("doc_id", name(F.col("pos")).alias("node_id"), name(F.col("ppos")).alias("parent"), "title", F.col("page").alias("start_page"), end.alias("end_page"), "level", "pos")
    bare = docs.join(headings.select("doc_id").distinct(), "doc_id", "left_anti")
    root = bare.select("doc_id", F.lit("n0").alias("node_id"), F.lit(None).cast("string").alias("parent"), "title", F.lit(1).alias("start_page"), F.col("n_pages").alias("end_page"), F.lit(0).alias("level"), F.lit(0).alias("pos"))
    return nodes.unionByName(root)


def structure(outline: DataFrame, headings: DataFrame) -> DataFrame:
    """A document's outline entries where there are MIN_OUTLINE or more, else its headings re-levelled. Both (doc_id, pos, title, page), outline with level."""
    enough = outline.groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_OUTLINE).select("doc_id")
    trusted = outline.join(enough, "doc_id").select("doc_id", "pos", "title", "page", "level")
    return trusted.unionByName(relevel(headings.join(enough, "doc_id", "left_anti")))


def ancestors(tree: DataFrame, levels: int = MAX_LEVEL + 1) -> DataFrame:
    """doc_id, node_id, ancestor, distance from 1: parents joined again as often as a tree is deep, `levels` times at most.

    Parents and each round's rows are stored: a task holds one join's rows, and no round is made twice.
    """
    up = written(tree.filter("parent is not null").select("doc_id", F.col("node_id").alias("child"), F.col("parent").alias("above")), "parents")
    out = step = up.select("doc_id", F.col("child").alias("node_id"), F.col("above").alias("ancestor"), F.lit(1).alias("distance"))
    above = up.select("doc_id", F.col("child").alias("ancestor"), "above")
    for d in range(2, levels + 1):
        step = written(dealt(step, "doc_id", "ancestor").join(above, ["doc_id", "ancestor"]).select("doc_id", "node_id", F.col("above").alias("ancestor"), F.lit(d).alias("distance")), "ancestors")
        if step.isEmpty():
            break
        out = out.unionByName(step)
    return out


def leaves(tree: DataFrame) -> DataFrame:
    parents = tree.select("doc_id", F.col("parent").alias("node_id")).filter("node_id is not null").distinct()
    return tree.join(parents, ["doc_id", "node_id"], "left_anti")


def nodes_of_pages(pages: DataFrame, tree: DataFrame) -> DataFrame:
    """pages (…, doc_id, page) with every node whose range holds the page; the range join runs within a document."""
    return pages.join(tree, "doc_id").filter("page between start_page and end_page")


def deepest_node() -> Column:
    """The node_id of greatest level, then start page, then the earlier in order."""
    return F.max_by("node_id", F.struct("level", "start_page", -F.col("pos")))


def deepest(pages: DataFrame, tree: DataFrame, *keys: str) -> DataFrame:
    """The deepest node of each page: greatest level, then start page, then the earlier in order."""
    return nodes_of_pages(pages, tree).groupBy(*keys, "doc_id", "page").agg(deepest_node().alias("node_id"))


def reads_to_evidence(reads: DataFrame, pages: DataFrame) -> DataFrame:
    """Reads (qid, seq, doc_name, pages) as evidence: qid, rank, doc_id, page.

    The document is the name without .pdf; unknown documents and pages drop out; the first read of a page counts.
    """
    rows = reads.select("qid", "seq", F.regexp_replace("doc_name", r"\.pdf$", "").alias("doc_id"), F.posexplode("pages").alias("at", "page"))
    known = rows.join(pages.select("doc_id", "page"), ["doc_id", "page"])
    first = known.groupBy("qid", "doc_id", "page").agg(F.min(F.struct("seq", "at")).alias("o"))
    return first.select("qid", F.row_number().over(Window.partitionBy("qid").orderBy("o")).alias("rank"), "doc_id", "page")


def navigation(reads: DataFrame, tree: DataFrame) -> DataFrame:
    """Of each question's reads within the document read last: visited (nodes in first-seen order), selected (deepest
    node of the last read's first page), backtracks (nodes of reads that share no page with the last read, less its nodes)."""
    rows = reads.withColumn("doc_id", F.regexp_replace("doc_name", r"\.pdf$", ""))
    final = rows.groupBy("qid").agg(F.max_by(F.struct("doc_id", "pages", "seq"), "seq").alias("last"))
    mine = rows.join(final, "qid").filter("doc_id = last.doc_id")
    # stored once, then folded by node and by question: nothing is joined to itself
    seen = written(nodes_of_pages(mine.select("qid", "doc_id", "seq", "last", F.col("pages").alias("all"), F.posexplode("pages").alias("at", "page")), tree).select("qid", "node_id", "seq", "at", "pos", "level", "start_page", (F.col("seq") == F.col("last.seq")).alias("ends"), (~F.arrays_overlap("all", F.col("last.pages"))).alias("apart")), "seen")
    place = F.max(F.when(F.col("ends") & (F.col("at") == 0), F.struct("level", "start_page", -F.col("pos"))))
    nodes = seen.groupBy("qid", "node_id").agg(F.min(F.struct("seq", "at", "pos")).alias("o"), F.bool_or("ends").alias("ends"), F.bool_or("apart").alias("apart"), place.alias("place"))
    of = lambda flag: F.collect_list(F.when(F.col(flag), F.col("node_id")))
    out = nodes.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("o", "node_id"))).alias("v"), F.max_by("node_id", "place").alias("selected"), of("ends").alias("end"), of("apart").alias("away")).filter(F.size("end") > 0)
    return out.select("qid", F.transform("v", lambda x: x["node_id"]).alias("visited"), "selected", F.sort_array(F.array_except("away", "end")).alias("backtracks"))
