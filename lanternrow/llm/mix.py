"""Mixing sources to target weights by hash thresholds; DataFrame functions only.

Each row's key is the MD5 of its doc_id and text, so a draw depends on the data alone and reruns
agree. Sizes are summed by source and by the first DIGITS hex digits of the key. Where a source's
running sum meets its budget lies the boundary bin; only the rows of boundary bins are counted
again, by DIGITS more digits, until a bin holds one row: its key is the threshold, and it is in
where that brings the sum nearer the budget. Rows below the threshold are taken by a comparison, no
row is sorted. A target above the source's size takes all rows once per whole size and draws the
rest; thresholds of a larger pass lie above those of a smaller one, so draws are nested.

Sources are ordered by code point, null last, and weigh WEIGHTS in turn. Together they get `share`
of all sizes; what a source would get beyond `most` times its size is shared anew by weight among
the others. Rows that agree in source, doc_id and text are told apart by their place in a stored
table, and as many of them are taken as the budget needs. Null texts have size 0, which is taken 0
times; null sources are one source; null doc_ids are rows like others; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

WEIGHTS = (3, 1, 2)
#: Hex digits of the key that each round counts by: a source has 16**DIGITS bins at most.
DIGITS = 3
#: Digits of the key: 32 of the MD5, then 16 of the row's place in the stored table.
KEY_DIGITS = 48
#: Sources up to which their thresholds are broadcast; beyond, the join shuffles.
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), 0)).cast("long")


def _numbered(sources: DataFrame) -> DataFrame:
    """sources with `place`, their position from 0 by code point, null last; sorted in parts, which count ahead of each other."""
    own = F.asc_nulls_last("source")
    parts = stored(sources.repartitionByRange(own).withColumn("part", F.spark_partition_id()), "mix-sources")
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    # a row for each part, of which there are as many as shuffle partitions
    ahead = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(own))
    return parts.withColumn("inside", inside).join(F.broadcast(ahead), "part").withColumn("place", F.col("ahead") + F.col("inside") - 1).drop("part", "inside", "ahead")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, target) of (source, source_size).

    The level is what a weight of one gets. A source above `most` times its size is capped there and
    the level is set anew for the others, until none is above; the driver sees three sums a round.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = stored(_numbered(sources).select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap")), "mix-weights")
    total, level, capped = None, 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > F.col("cap")
        got = weighed.agg(F.sum("source_size").alias("all"), F.sum(F.when(above, F.col("cap")).otherwise(0)).alias("fixed"), F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("weight"), F.count_if(above).alias("n")).first()
        total = share * (got["all"] or 0)
        if got["n"] <= capped or not got["weight"]:
            break
        capped, level = got["n"], (total - got["fixed"]) / got["weight"]
    return weighed.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def _boundaries(bins: DataFrame, budgets: DataFrame) -> DataFrame:
    """The bin of each (source, pass) in which the running sum of sizes meets what is left of the budget: source, pass, bin, left, n, key, size."""
    order = Window.partitionBy("b.source", "pass").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = bins.alias("b").join(budgets.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source")) & (F.col("b.upper") == F.col("g.upper")))
    ran = both.select("b.source", "pass", "bin", "left", "n", "key", "size", F.sum("size").over(order).alias("upto"))
    # rows of size 0 do not move the sum, so exactly one bin takes it from below the budget to the budget or above
    return ran.filter((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("size") < F.col("left"))).select("source", "pass", "bin", (F.col("left") - F.col("upto") + F.col("size")).alias("left"), "n", "key", "size")


def thresholds(sized: DataFrame, goals: DataFrame, most: int = 2, digits: int = DIGITS) -> DataFrame:
    """(source, cuts): for each pass that is drawn in part, the key up to which its rows are taken, exclusive unless it ends with '~'.

    sized has source, key, size; goals has source, source_size, target. At most `most` cuts a source.
    """
    bin_at = lambda upto: F.substring("key", 1, upto)
    count = lambda rows, upto: rows.groupBy("source", bin_at(upto - digits).alias("upper"), bin_at(upto).alias("bin")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("key").alias("key"))
    rows = sized = sized.filter("size > 0")
    left = F.col("target") - F.col("pass") * F.col("source_size")
    open_ = goals.withColumn("pass", F.explode(F.array(*map(F.lit, range(most))))).withColumn("left", left).filter("left > 0 and left < source_size").select("source", "pass", F.lit("").alias("upper"), "left")
    cuts = None
    for upto in range(digits, KEY_DIGITS + digits, digits):
        at = stored(_boundaries(count(rows, upto), open_), "mix-boundary")
        # alone in its bin: taken if that is nearer than not; several with one key are all alike and go together
        last = upto >= KEY_DIGITS
        done = at.filter(F.lit(last) | (F.col("n") == 1)).select("source", F.concat("key", F.when(F.col("left") * 2 >= F.col("size"), "~").otherwise("")).alias("cut"))
        cuts = done if cuts is None else cuts.unionByName(done)
        open_ = at.filter(~F.lit(last) & (F.col("n") > 1)).select("source", "pass", F.col("bin").alias("upper"), "left")
        if open_.isEmpty():
            break
        inside = open_.select("source", "upper").distinct()
        # a bin or two a source
        side = F.broadcast(inside) if inside.count() <= BROADCAST_SOURCES else inside
        rows = sized.alias("r").join(side.alias("i"), F.col("r.source").eqNullSafe(F.col("i.source")) & (F.substring("r.key", 1, upto) == F.col("i.upper")), "left_semi")
    return cuts.groupBy("source").agg(F.collect_list("cut").alias("cuts"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, doc_id: str = "doc_id", text: str = "text", source: str = "source", key_digits: int = 32) -> DataFrame:
    """A row per row of docs: doc_id, size, source_size, target, taken; taken is a multiple of size, at most `most` times it.

    A source's taken words differ from its target by at most half the size of one document. key_digits
    cuts the hash, for tests of ties.
    """
    if share > most:
        raise ValueError("share can't be above the times that a document may be taken")
    own = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"), F.rpad(F.substring(own, 1, key_digits), 32, "0").alias("hash"))
    place = F.lpad(F.lower(F.hex(F.xxhash64("_metadata.file_name", "_metadata.row_index"))), 16, "0")
    sized = stored(plain, "mix-sized").select("doc_id", "source", "size", F.concat("hash", place).alias("key"))
    goals = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "mix-targets")
    cuts = thresholds(sized, goals, most)
    sides = stored(goals.alias("g").join(cuts.alias("c"), F.col("g.source").eqNullSafe(F.col("c.source")), "left").select("g.source", "source_size", "target", F.coalesce("cuts", F.array().cast("array<string>")).alias("cuts")), "mix-cuts")
    few = F.broadcast(sides) if sides.count() <= BROADCAST_SOURCES else sides
    size = F.col("source_size")
    whole = F.size(F.filter(F.array(*map(F.lit, range(most))), lambda k: (size > 0) & (F.col("target") - k * size >= size)))
    drawn = F.size(F.filter("cuts", lambda c: F.col("key") < c))
    joined = sized.alias("d").join(few.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * (whole + drawn)).cast("long").alias("taken"))
