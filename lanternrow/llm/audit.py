"""How filters of documents interact: what each step of each order of five filters removes.

A relational word pipeline gives the word totals: texts are dealt once by (doc_id, digest of the
text, SALTS parts), words are exploded and grouped by that and the word, then by document, in the
same tasks: neither grouping shuffles again, so of 140 million words not one crosses the network. Only (doc_id, digest,
total, distinct) does. The other flags come from a narrow scan of one row per document; totals are
outer-joined to them (texts without words have none), so are the first doc_id of each text and the
labels. A document's failures are a mask of five bits; one aggregate a part has a conditional count
for each of the 32 masks, of all, good and toxic documents. All orders and steps are read from those
counts without looking at a document again.

Null texts count as empty, null parts as the empty string. Rows that repeat a doc_id and text count
once each. A null doc_id is neither smaller nor larger than any, and has no labels; of repeated
labels of a document the largest counts. Tables without rows give none.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

FILTERS = "ABCDE"
#: Parts that rows of one doc_id and text are dealt to.
SALTS = 64
#: What stands between words.
GAP = r"[\x20\x09-\x0D]+"


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def word_totals(texts: DataFrame) -> DataFrame:
    """(doc_id, digest, total, distinct) of texts (doc_id, text: not null); documents without words have no row."""
    key = ["doc_id", "digest", "salt"]
    # rows that repeat a doc_id and text have a salt by their partition: their counts are divided by their number in it
    dealt = texts.select("doc_id", _digest(F.col("text")).alias("digest"), (F.spark_partition_id() % SALTS).alias("salt"), "text").repartition(*key)
    words = dealt.select(*key, F.explode(F.split("text", GAP)).alias("word")).filter("word <> ''")
    by_word = words.groupBy(*key, "word").agg(F.count("*").alias("n"))
    by_part = by_word.groupBy(*key).agg(F.sum("n").alias("words"), F.count("*").alias("distinct"))
    return by_part.groupBy("doc_id", "digest").agg(F.sum("words").alias("words"), F.max("distinct").alias("distinct"))


def masks(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): n rows of docs fail the filters in mask, bit i for the i-th letter of FILTERS; good and toxic are 0 or 1."""
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(text, F.lit("")).alias("text"))
    t = F.col("text")
    capitals = F.octet_length(F.regexp_replace(t, "[^A-Z]+", ""))
    flags = texts.select("doc_id", "part", _digest(t).alias("digest"), (capitals * 100 > F.length(t) * 10).alias("c"), t.rlike("[#$%&*|]").alias("d"))
    # stored: three aggregates and a join read it, the texts only once
    units = stored(flags.groupBy("doc_id", "part", "digest", "c", "d").agg(F.count("*").alias("n")), "audit-flags").alias("u")
    copies = units.groupBy("doc_id", "digest").agg(F.sum("n").alias("copies"))
    totals = copies.alias("k").join(word_totals(texts.select("doc_id", "text")).alias("w"), F.col("k.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("k.digest") == F.col("w.digest")), "left")
    totals = totals.select("k.doc_id", "k.digest", (F.coalesce("words", F.lit(0)) / F.col("copies")).cast("long").alias("total"), F.coalesce("distinct", F.lit(0)).alias("distinct")).alias("t")
    firsts = units.groupBy("digest").agg(F.min("doc_id").alias("first")).alias("f")
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).alias("l")
    all_ = units.join(totals, F.col("u.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("u.digest") == F.col("t.digest")))
    all_ = all_.join(marks, F.col("u.doc_id") == F.col("l.doc_id"), "left").join(firsts, F.col("u.digest") == F.col("f.digest"))
    failed = (F.col("total") < 100, F.col("distinct") * 100 < F.col("total") * 80, F.col("c"), F.col("d"), F.coalesce(F.col("u.doc_id") > F.col("first"), F.lit(False)))
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))
    return all_.select("part", mask.alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "n")


def counted(masked: DataFrame) -> DataFrame:
    """(part, n, good, toxic): arrays of 32 conditional counts, at place m the documents whose mask is m."""
    columns = {f"{kind}{m}": F.sum(F.when(F.col("mask") == m, F.col("n") * F.col(kind) if kind else F.col("n")).otherwise(0)) for kind in ("", "good", "toxic") for m in range(1 << len(FILTERS))}
    summed = masked.groupBy("part").agg(*(c.alias(f"m{name}") for name, c in columns.items()))
    return summed.select("part", *(F.array(*(f"m{kind}{m}" for m in range(1 << len(FILTERS)))).alias(kind or "n") for kind in ("", "good", "toxic")))


def interactions(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """A row for each part, order of the filters and step: what the step's filter removes, and what it would remove elsewhere.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    """
    counts = counted(masks(docs, labels, doc_id, text, part))
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    rows = counts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    before = F.aggregate(F.sequence(F.lit(0), F.lit(len(FILTERS))), F.lit(0), lambda acc, i: F.when((i > 0) & (i < F.col("step")), acc.bitwiseOR(_bit_of(F.substring(F.col("filter_order"), i, F.lit(1))))).otherwise(acc))
    rows = rows.withColumn("own", _bit_of(F.substring(F.col("filter_order"), F.col("step"), F.lit(1)))).withColumn("before", before)
    every = F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))
    has, gone = (lambda m: m.bitwiseAND(F.col("own")) != 0), (lambda m: m.bitwiseAND(F.col("before")) != 0)
    total = lambda of, test: F.aggregate(every, F.lit(0).cast("long"), lambda acc, m: acc + F.when(test(m), F.get(of, m)).otherwise(0))
    out = rows.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), "own",
        total("n", lambda m: ~has(m) & ~gone(m)).alias("kept"), total("n", lambda m: has(m) & ~gone(m)).alias("removed"), total("n", lambda m: has(m) & gone(m)).alias("redundant"), F.get("n", F.col("own")).alias("unique_fails"),
        total("good", lambda m: has(m) & ~gone(m)).alias("good_lost"), total("toxic", lambda m: has(m) & ~gone(m)).alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own"))).drop("own")


def _bit_of(letter: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for i, f in enumerate(FILTERS) for x in (f, 1 << i))), letter)
