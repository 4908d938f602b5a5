"""Question files, parsed documents, manifests, HTML tables and links, run tables on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import assign_split

QUESTION = "qid string, dataset string, regime string, qtype string, question string, doc_ids array<string>, gold struct<kind: string, value: string>, evidence array<struct<doc_id: string, page: int>>, verified_by string, pair_id string, form string"
PARSED = "doc_id string, title string, sha256 string, pages array<struct<number: int, text: string>>, tree array<struct<id: string, parent: string, title: string, start_page: int, end_page: int, level: int>>"
MANIFEST = "doc_id string, corpus string, regime string, issuer string, isin string, product_type string, language string, issue_date string, url string, sha256 string, pages string, licence_note string"
#: What the manifest's columns look like.
MANIFEST_CHECKS = {"doc_id": r"^[a-z0-9][a-z0-9-]*$", "regime": r"^(A|B|claim)$", "isin": r"^([A-Z]{2}[A-Z0-9]{9}\d)?$", "language": r"^(en|de|fr|es)$", "issue_date": r"^(\d{4}-\d{2}-\d{2}|\d{4})?$", "sha256": r"^(sha256:[0-9a-f]{64})?$", "pages": r"^\d*$"}
KINDS = ("numeric", "exact", "date", "date_list", "unanswerable", "free")


def read_questions(spark: SparkSession, paths: list[str], seed: int = 0) -> DataFrame:
    """Question rows of JSONL files with their split; blank lines are passed over. gold.value stays as its JSON text for lists."""
    rows = spark.read.schema(QUESTION + ", _corrupt_record string").json(paths, mode="PERMISSIVE")
    return rows.filter("_corrupt_record is not null or qid is not null").withColumn("split", assign_split(seed, F.coalesce("pair_id", "qid")))


def invalid_questions(rows: DataFrame) -> DataFrame:
    """qid, why: a row for each broken rule, repeated qids and unreadable lines among them."""
    rows, twice = rows.withColumn("__n", F.count("*").over(Window.partitionBy("qid"))), F.col("__n")
    rules = {
        "unreadable line": F.col("_corrupt_record").isNotNull() if "_corrupt_record" in rows.columns else F.lit(False),
        "repeated qid": (twice > 1) & F.col("qid").isNotNull(),
        "unknown kind": ~F.col("gold.kind").isin(*KINDS),
        "pair_id and form go together": F.col("pair_id").isNull() != F.col("form").isNull(),
        "unanswerable means no evidence": (F.col("gold.kind") == "unanswerable") != (F.size(F.coalesce("evidence", F.array().cast("array<struct<doc_id: string, page: int>>"))) == 0),
    }
    checks = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))
    return rows.withColumn("why", F.explode(checks)).select("qid", "why")


def read_parsed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs with corpus, pages, tree) of a folder of parsed documents; groups.json gives the corpus of each."""
    docs = spark.read.schema(PARSED).json(f"{folder}/*.json", multiLine=True).filter(~F.endswith(F.input_file_name(), F.lit("/groups.json")))
    try:
        groups = spark.read.text(f"{folder}/groups.json", wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("doc_id", "corpus"))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        groups = spark.createDataFrame([], "doc_id string, corpus string")
    docs = docs.join(groups, "doc_id", "left")
    pages = docs.select("doc_id", F.explode("pages").alias("p")).select("doc_id", F.col("p.number").alias("page"), "p.text")
    tree = docs.select("doc_id", F.posexplode("tree").alias("pos", "t")).select("doc_id", F.col("t.id").alias("node_id"), "t.parent", "t.title", "t.start_page", "t.end_page", "t.level", "pos")
    return docs.select("doc_id", "title", "sha256", "corpus", F.size("pages").alias("n_pages")), pages, tree


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows; the header must be the one above. Empty pages are null."""
    rows = spark.read.csv(path, schema=MANIFEST, header=True, enforceSchema=False, quote='"', escape='"')
    return rows.withColumn("pages", F.col("pages").try_cast("int"))


def invalid_manifest(rows: DataFrame) -> DataFrame:
    """doc_id, why: values that break a column's pattern, and doc_ids that are there twice."""
    bad = [F.when(~F.coalesce(F.col(c).cast("string"), F.lit("")).rlike(p), F.lit(f"bad {c}")) for c, p in MANIFEST_CHECKS.items() if c in rows.columns]
    rows = rows.withColumn("__n", F.count("*").over(Window.partitionBy("doc_id")))
    bad.append(F.when(F.col("__n") > 1, F.lit("repeated doc_id")))
    return rows.withColumn("why", F.explode(F.array_compact(F.array(*bad)))).select("doc_id", "why")


def write_manifest(rows: DataFrame, path: str) -> None:
    """One CSV with the columns in their order, sorted by doc_id; null pages are empty. A manifest is small by nature."""
    names = [x.split()[0] for x in MANIFEST.split(", ")]
    rows.select(*names).orderBy("doc_id").coalesce(1).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="", escape='"', lineSep="\n")


def keep_pins(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New manifest rows with the checksums and page counts that were known before."""
    old = existing.select("doc_id", F.col("sha256").alias("__sha"), F.col("pages").alias("__pages"))
    return new.join(old, "doc_id", "left").withColumns({"sha256": F.coalesce(F.nullif(F.col("__sha"), F.lit("")), "sha256"), "pages": F.coalesce("__pages", "pages")}).drop("__sha", "__pages")


def strip_tags(html: Column) -> Column:
    """Text of a piece of HTML: tags out, the common entities put back, white space collapsed."""
    out = F.regexp_replace(html, r"<[^>]*>", " ")
    for name, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(c))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def html_rows(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, pos, cells: each table row's cell texts."""
    trs = F.regexp_extract_all(F.col(html), F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda tr: F.transform(F.regexp_extract_all(tr, F.lit(r"(?s)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), strip_tags)
    return pages.select(key, F.posexplode(trs).alias("pos", "tr")).select(key, "pos", cells(F.col("tr")).alias("cells"))


def priced_rows(rows: DataFrame, at: int = 3, least: int = 4) -> DataFrame:
    """Table rows (…, cells) of `least` cells or more whose cell `at` is a whole number, which comes as `number`."""
    cell = F.regexp_replace(F.get("cells", F.lit(at)), r"\s", "")
    return rows.filter((F.size("cells") >= least) & cell.rlike(r"^\d+$")).withColumn("number", cell.try_cast("long"))


def html_links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, pos, href, label of each link."""
    found = F.regexp_extract_all(F.col(html), F.lit(r'(?s)(<a\s[^>]*href="[^"]*"[^>]*>.*?</a>)'), F.lit(1))
    rows = pages.select(key, F.posexplode(found).alias("pos", "a"))
    return rows.select(key, "pos", F.regexp_extract("a", r'href="([^"]*)"', 1).alias("href"), strip_tags(F.col("a")).alias("label"))


def first_links(links: DataFrame, by: str = "href", key: str = "page_id") -> DataFrame:
    """Each link target's first occurrence."""
    first = links.groupBy(by).agg(F.min_by(F.struct(key, "pos", "label"), F.struct(key, "pos")).alias("r"))
    return first.select(by, f"r.{key}", "r.pos", "r.label")


def link_dates(pages: DataFrame, key: str = "page_id", html: str = "html", reach: int = 400) -> DataFrame:
    """key, pos, href, day: links with a 'Final Terms (dd.mm.yyyy)' within `reach` characters after them."""
    found = F.regexp_extract_all(F.col(html), F.lit(rf'(?s)(<a\s[^>]*href="[^"]*"[^>]*>.*?</a>(?=.{{0,{reach}}}).{{0,{reach}}})'), F.lit(1))
    rows = pages.select(key, F.posexplode(found).alias("pos", "a"))
    dated = rows.select(key, "pos", F.regexp_extract("a", r'href="([^"]*)"', 1).alias("href"), F.regexp_extract("a", r"Final Terms \((\d{1,2}\.\d{1,2}\.\d{4})\)", 1).alias("d"))
    return dated.select(key, "pos", "href", F.try_to_date("d", "dd.MM.yyyy").alias("day")).filter("day is not null")


def html_headings(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, pos from 1, level, title of each h1 to h6."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"(?s)(<h[1-6][^>]*>.*?</h[1-6]>)"), F.lit(1))
    rows = pages.select(key, F.posexplode(found).alias("at", "h"))
    return rows.select(key, (F.col("at") + 1).alias("pos"), F.regexp_extract("h", r"^<h([1-6])", 1).cast("int").alias("level"), strip_tags(F.col("h")).alias("title"))


def append_rows(rows: DataFrame, path: str) -> None:
    """Appends to a run's table; the version of a key that counts is the last, see runs.latest()."""
    rows.write.mode("append").parquet(path)


def export_runs(runs: DataFrame, path: str, fields: list[str]) -> None:
    """The public fields of a run as JSON lines."""
    runs.select(*fields).write.mode("overwrite").json(path)


def export_explorer(rows: DataFrame, path: str, size: int = 50) -> None:
    """Rows in shards of `size` by dataset, a folder each, and their index: dataset, shard, n, qids in order."""
    from ..operators.runs import shards

    dealt = shards(rows, "dataset", "qid", size)
    dealt.write.mode("overwrite").partitionBy("dataset", "shard").json(f"{path}/questions")
    # the index is made of what was written
    held = rows.sparkSession.read.schema(dealt.schema).json(f"{path}/questions")
    held.groupBy("dataset", "shard").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("qid")).alias("qids")).write.mode("overwrite").json(f"{path}/index")


def export_trees(trees: DataFrame, path: str, folders: int = 64) -> None:
    """Trees (doc_id, tree: JSON text) as JSON lines with their doc_id, dealt by its hash to a bounded number of folders, so that one is found without a search."""
    bucket = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(folders)).cast("int")
    trees.select("doc_id", F.lit("tree/v1").alias("schema"), "tree", bucket.alias("bucket")).write.mode("overwrite").partitionBy("bucket").json(path)


def exported_tree(spark: SparkSession, path: str, doc_id: str, folders: int = 64) -> DataFrame:
    """The tree of one document, from its folder alone."""
    rows = spark.read.schema("doc_id string, schema string, tree string, bucket int").json(path)
    return rows.filter((F.col("bucket") == F.pmod(F.xxhash64(F.lit(str(doc_id))), F.lit(folders)).cast("int")) & (F.col("doc_id") == str(doc_id))).drop("bucket")
