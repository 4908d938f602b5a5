"""Tables and shared SQL of the queries.

Documents are read as parsed documents: a page is a line, the language is the corpus. Benchmark
items are questions; the documents that hold an item's text are its gold evidence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.retrieval import small
from ..storage import written

Query = Callable[[SparkSession, str], DataFrame]

#: DuckDB forms of the text functions.
TOKENS = r"regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+')"
WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"
PAGES = r"SELECT doc_id, lang, CAST(i AS INTEGER) AS page, lines[i] AS text FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS lines FROM documents), UNNEST(range(1, len(lines) + 1)) AS u(i)"
GOLD = "SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, page, text: a page is a line."""
    return load(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("p", "text")).select("doc_id", "lang", (F.col("p") + 1).alias("page"), "text")


#: Bytes of the blocks that texts are cut into, for items of twice that less one at least.
BLOCKS = (32, 8)


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, doc_id of the documents that hold an item's text, stored, as most queries read it more than once.

    Where a document holds an item, the first of the document's blocks that begins within the item lies within
    it whole, at one of as many places as a block has bytes: blocks are hash-joined with the item's at these
    places, the containment is checked on what is left. Items that are too short for the smallest
    blocks are checked against every document, a stated set.
    """
    n = F.octet_length("item")
    block = F.lit(None).cast("int")
    for size in sorted(BLOCKS):
        block = F.when(n >= 2 * size - 1, size).otherwise(block)
    items = load(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item")).withColumn("block", block)
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    used = {r["block"] for r in items.select("block").distinct().collect()}
    hits = None
    for size in [b for b in BLOCKS if b in used] or BLOCKS[:1]:
        of = lambda rows, key, text, places: rows.select(key, F.col(text).cast("binary").alias("b")).select(key, "b", F.explode(places).alias("at")).select(key, F.xxhash64(F.substring("b", F.col("at"), F.lit(size))).alias("k"))  # noqa: E731, B023
        asked = small(of(items.filter(F.col("block") == size), "item_id", "item", F.sequence(F.lit(1), F.lit(size))), 50_000 * size)
        cut = of(docs.filter(F.octet_length("text") >= size), "doc_id", "text", F.sequence(F.lit(1), F.octet_length("b") - (size - 1), F.lit(size)))
        found = cut.join(asked, "k").select("item_id", "doc_id")
        hits = found if hits is None else hits.unionByName(found)
    # stored, counted and broadcast, so that texts are checked where they are read
    hits = written(hits.distinct(), "gold-hits")
    held = docs.join(small(hits.join(items, "item_id")), "doc_id").filter(F.contains("text", "item")).select("item_id", "doc_id")
    short = items.filter("block is null and item is not null")
    return written(held if short.isEmpty() else held.unionByName(docs.join(short, F.contains("text", "item")).select("item_id", "doc_id")), "gold")


def values_sql(rows: list[tuple], names: str) -> str:
    """A VALUES table in DuckDB SQL of the same rows as a Spark fixture."""
    show = lambda v: "NULL" if v is None else ("[" + ", ".join(map(show, v)) + "]") if isinstance(v, list) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + f") AS t({names})"
