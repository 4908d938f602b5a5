"""Question sets: siblings, descriptions, templates, decisions, merging, sampling, materialising."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ATTRS = ("maturity", "coupon", "barrier", "currency", "strike")


def siblings(products: DataFrame, key: str = "doc_id", base: tuple[str, ...] = ("issuer", "type", "underlyings")) -> DataFrame:
    """key, sibling: other products that are alike in all of base; null underlyings have none."""
    left = products.filter(" and ".join(f"{b} is not null" for b in base)).select(key, *base)
    right = left.withColumnRenamed(key, "sibling")
    return left.join(right, list(base)).filter(F.col(key) != F.col("sibling")).select(key, "sibling")


def unique_attributes(products: DataFrame, key: str = "doc_id", base: tuple[str, ...] = ("issuer", "type", "underlyings"), attrs: tuple[str, ...] = ATTRS) -> DataFrame:
    """key, attrs, n_rivals: attributes in order that each leave fewer rivals, until none is left.

    A product's rivals are its siblings; an attribute that is null or takes no rival away is passed
    over. n_rivals above 0: no description is unique. Null base values give null attrs.
    """
    missing = F.lit(False)
    for b in base:
        missing = missing | F.col(b).isNull()
    good = products.filter(~missing).select(key, *base, *attrs)
    # products counted by base and by each subset of the attributes they have, a bit mask; linear in products.
    # Who agrees in an attribute has it, so subsets with a null one are asked by nobody
    has = sum((F.when(F.col(a).isNotNull(), 1 << i).otherwise(0) for i, a in enumerate(attrs)), F.lit(0))
    masks = good.withColumn("has", has).withColumn("mask", F.explode(F.array(*(F.lit(m) for m in range(1 << len(attrs)))))).filter(F.col("mask").bitwiseAND(F.col("has")) == F.col("mask"))
    shown = [F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col(a)).alias(f"k_{a}") for i, a in enumerate(attrs)]
    masks = masks.select(key, "mask", *base, *shown)
    by = ["mask", *base, *(f"k_{a}" for a in attrs)]
    counts = masks.groupBy(*by).agg(F.count("*").alias("n"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"m.{c}").eqNullSafe(F.col(f"c.{c}"))
    # both joins are of tables many times the file that Spark judges them by, so they may not be broadcast
    each = masks.alias("m").join(counts.hint("merge").alias("c"), same).groupBy(f"m.{key}").agg(F.map_from_entries(F.collect_list(F.struct("m.mask", "n"))).alias("n"))
    out = good.join(each.hint("merge"), key).withColumns({"used": F.lit(0), "attrs": F.array(*(F.lit(b) for b in base))})
    for i, a in enumerate(attrs):
        now, then = F.element_at("n", F.col("used")), F.element_at("n", F.col("used").bitwiseOR(1 << i))
        takes = (now > 1) & F.col(a).isNotNull() & (then < now)
        out = out.withColumns({"attrs": F.when(takes, F.array_append("attrs", F.lit(a))).otherwise(F.col("attrs")), "used": F.when(takes, F.col("used").bitwiseOR(1 << i)).otherwise(F.col("used"))})
    done = out.select(key, "attrs", (F.element_at("n", F.col("used")) - 1).cast("int").alias("n_rivals"))
    none = products.filter(missing).select(key, F.lit(None).cast("array<string>").alias("attrs"), F.lit(None).cast("int").alias("n_rivals"))
    return done.unionByName(none)


def sibling_counts(products: DataFrame, key: str = "doc_id", base: tuple[str, ...] = ("issuer", "type", "underlyings")) -> DataFrame:
    """key, n of siblings, for products that have any; counted by base, without the pairs."""
    rows = products.filter(" and ".join(f"{b} is not null" for b in base)).select(key, *base)
    # a key that is repeated isn't its own sibling
    whole = rows.groupBy(*base).agg(F.count("*").alias("all"))
    own = rows.groupBy(key, *base).agg(F.count("*").alias("own"))
    found = own.join(whole.hint("merge"), list(base)).withColumn("n", F.col("own") * (F.col("all") - F.col("own"))).filter("n > 0")
    return found.groupBy(key).agg(F.sum("n").alias("n"))


def disambiguation(facts: DataFrame, products: DataFrame, used: DataFrame, fields: list[str], most: int = 2, key: str = "doc_id", base: tuple[str, ...] = ("issuer", "type", "underlyings")) -> DataFrame:
    """doc_id, field, nth: the first `most` fields, in order, that the description leaves out, whose quote
    is right and where some sibling (a product alike in all of base) has another value.
    facts (doc_id, field, value, quote_ok), used (doc_id, attrs).

    The pairs of siblings are never made: of the values of a base and field, those that are neither
    this one nor the product's own are counted.
    """
    order = F.array_position(F.array(*(F.lit(f) for f in fields)), F.col("field"))
    bases = products.filter(" and ".join(f"{b} is not null" for b in base)).select(key, *base).distinct()
    said = facts.withColumn("o", order).filter("value is not null and o > 0").groupBy(key, "field", "o", "value").agg(F.max("quote_ok").alias("ok"))
    # a value of the product, once; own: its different values of the field
    rows = said.join(bases.hint("merge"), key).withColumn("own", F.count("*").over(Window.partitionBy(key, "field", *base)))
    alike = rows.groupBy(*base, "field", "value").agg(F.count("*").alias("alike"))
    whole = alike.groupBy(*base, "field").agg(F.sum("alike").alias("all"))
    mine = rows.filter("ok").join(used, key).filter(~F.array_contains("attrs", F.col("field")))
    other = mine.join(alike.hint("merge"), [*base, "field", "value"]).join(whole.hint("merge"), [*base, "field"]).filter(F.col("all") - F.col("alike") > F.col("own") - 1)
    found = other.select(key, "field", "o").distinct()
    nth = F.row_number().over(Window.partitionBy(key).orderBy("o"))
    return found.withColumn("nth", nth).filter(F.col("nth") <= most).select(key, "field", "nth")


def replay(log: DataFrame, by: str = "draft_id", order: str = "at", action: str = "action") -> DataFrame:
    """The decisions in force in each log: a draft's last entry, unless an undo took it back, which leaves the draft without any.

    An undo takes back the log's last entry that still stands, of whatever draft: brackets are
    matched by their depth within each log, so no list of the log is built. log has column `log`.
    """
    w = Window.partitionBy("log").orderBy(order)
    undo = F.col(action) == "undo"
    rows = log.withColumn("__level", F.sum(F.when(undo, -1).otherwise(1)).over(w))
    # an undo with nothing to take back doesn't lower the level: the floor so far is added again
    floor = F.least(F.lit(0), F.min("__level").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__level", F.col("__level") - floor)
    # an entry at level n is undone if the level falls below n later; backwards, so that the frame only grows
    back = Window.partitionBy("log").orderBy(F.col(order).desc())
    later = F.min("__level").over(back.rowsBetween(Window.unboundedPreceding, -1))
    entries = rows.withColumn("__stands", F.coalesce(later, F.col("__level")) >= F.col("__level")).filter(~undo)
    rest = [c for c in log.columns if c not in (by, "log")]
    last = entries.groupBy("log", by).agg(F.max_by(F.struct(*rest, "__stands"), order).alias("r")).filter("r.__stands")
    return last.select("log", by, *(F.col(f"r.{c}").alias(c) for c in rest))


def merge_reviewers(decisions: DataFrame, drafts: DataFrame, decided: DataFrame, strict: bool = False) -> DataFrame:
    """draft_id, action, at, source: of known drafts without a decision, each reviewer's last word; an adjudication
    wins, else all must agree and the latest line counts, else it is a conflict, an error if strict.

    decisions (draft_id, reviewer, action, at); the reviewer 'adjudication' rules.
    """
    word = F.struct("at", "action")
    last = decisions.groupBy("draft_id", "reviewer").agg(F.max(word).alias("w"))
    rows = last.join(drafts.select("draft_id").distinct(), "draft_id", "left_semi").join(decided.select("draft_id"), "draft_id", "left_anti")
    said = rows.groupBy("draft_id").agg(F.max(F.when(F.col("reviewer") == "adjudication", F.col("w"))).alias("ruling"), F.min("w.action").alias("a"), F.max("w.action").alias("b"), F.max("w").alias("newest"))
    agreed = F.when(F.col("a") == F.col("b"), F.col("newest"))
    chosen = F.coalesce("ruling", agreed)
    source = F.when(F.col("ruling").isNotNull(), "adjudicated").when(F.col("a") == F.col("b"), "agreed")
    conflict = F.raise_error(F.concat(F.lit("reviewers disagree on "), "draft_id")).cast("string") if strict else F.lit("conflict")
    return said.select("draft_id", chosen["action"].alias("action"), chosen["at"].alias("at"), F.when(source.isNotNull(), source).otherwise(conflict).alias("source"))


def next_item(drafts: DataFrame, decided: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row: the undecided draft of the least filled (regime, qtype), skipped ones last in the order of skipping, then by id."""
    accepted = decided.filter("action = 'accept'").join(drafts, "draft_id").groupBy("regime", "qtype").agg(F.count("*").alias("filled"))
    open_ = drafts.join(decided.select("draft_id"), "draft_id", "left_anti").join(accepted, ["regime", "qtype"], "left").join(skipped, "draft_id", "left")
    order = F.struct(F.col("skip_pos").isNotNull(), F.coalesce("skip_pos", F.lit(0)), F.coalesce("filled", F.lit(0)), "draft_id")
    return open_.agg(F.min_by(F.struct("draft_id", "regime", "qtype"), order).alias("r")).select("r.*")


def round_robin(rows: DataFrame, by: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows taken in turns over `by`, each in an order drawn from a hash of key."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)))
    return rows.withColumn("turn", nth).orderBy("turn", by).limit(n)


def two_forms(accepted: DataFrame) -> DataFrame:
    """Gold records: of regime A one by isin and, with a description, one by description, sharing pair_id; else one.

    accepted (draft_id, regime, question with {product}, isin, description).
    """
    asked = lambda c: F.regexp_replace("question", r"\{product\}", c)
    lead = lambda q: F.concat(F.upper(F.left(q, F.lit(1))), F.substr(q, F.lit(2)))
    by_isin = F.struct(F.concat("draft_id", F.lit("-isin")).alias("qid"), F.col("draft_id").alias("pair_id"), F.lit("isin").alias("form"), lead(asked(F.concat(F.lit("the product with ISIN "), "isin"))).alias("question"))
    by_text = F.struct(F.concat("draft_id", F.lit("-desc")).alias("qid"), F.col("draft_id").alias("pair_id"), F.lit("description").alias("form"), lead(asked(F.col("description"))).alias("question"))
    plain = F.struct(F.col("draft_id").alias("qid"), F.lit(None).cast("string").alias("pair_id"), F.lit(None).cast("string").alias("form"), F.col("question"))
    forms = F.when(F.col("regime") == "A", F.filter(F.array(by_isin, F.when(F.col("description").isNotNull(), by_text)), lambda x: x.isNotNull())).otherwise(F.array(plain))
    return accepted.select("regime", F.explode(forms).alias("f")).select("regime", "f.*")


#: Kinds of answers that are scored, and an amount, with or without a currency, that 'of' or 'per' may follow.
KINDS = ("exact", "numeric", "date", "date_list", "free")
AMOUNT = r"^((?:[A-Z]{3}\s?)?-?\d[\d.,']*\s?%?)(?:\s+(?:of|per)\b.*)?$"


def normalise_answer(kind: Column, answer: Column, answers: Column | None = None) -> Column:
    """(kind, value, values) of a drafted answer, or of a list of answers, as it can be scored; what can't is free text.

    Unknown kinds are free, null answers empty. ISO dates after one another are a list, amounts under
    numeric and exact are numeric.
    """
    iso = r"^\d{4}-\d{2}-\d{2}$"
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    none = F.lit(None).cast("array<string>")
    make = lambda k, v, vs: F.struct((F.lit(k) if isinstance(k, str) else k).alias("kind"), v.alias("value"), vs.alias("values"))
    own = F.when(kind.isin(*KINDS), kind).otherwise("free")
    text = strip(F.coalesce(answer, F.lit("")))
    parts = F.filter(F.transform(F.split(text, r"[,;]\s*|\s+and\s+"), strip), lambda x: x != "")
    amount = F.regexp_extract(text, AMOUNT, 1)
    one = (
        F.when(own.isin("date_list", "free") & (F.size(parts) > 1) & F.forall(parts, lambda x: x.rlike(iso)), make("date_list", F.lit(None).cast("string"), parts))
        .when(own.isin("numeric", "exact") & (amount != ""), make("numeric", strip(amount), none))
        .when((own.isin("numeric", "date_list")) | ((own == "date") & ~text.rlike(iso)), make("free", text, none))
        .otherwise(make(own, text, none))
    )
    if answers is None:
        return one
    clean = F.transform(answers, strip)
    many = F.when((F.size(answers) > 0) & F.forall(clean, lambda x: x.rlike(iso)), make("date_list", F.lit(None).cast("string"), clean)).otherwise(make("free", F.array_join(answers, "; "), none))
    return F.when(answers.isNotNull(), many).otherwise(one)


#: Names of one automaton; a longer list takes one pass over the texts for each.
NAMES_AT_ONCE = 1_000_000


def excluded(rows: DataFrame, names: DataFrame, text: str, at_once: int = NAMES_AT_ONCE) -> DataFrame:
    """Rows whose folded, collapsed text holds none of the names anywhere; null texts hold none. No names at all is an error: the screen fails closed.

    Names become automata of at_once names each, built once and sent to executors as arrays; a text
    is read once for each, whatever the number of its names. Names of white space alone are left out.
    """
    from ..functions.automaton import Automaton
    from ..functions.text import collapse, fold

    spark = rows.sparkSession
    plain = lambda c: F.trim(collapse(fold(c)))
    wanted = names.select(plain(F.col("name")).alias("name")).filter("name <> ''").distinct()
    block, shipped = [], []
    for r in wanted.toLocalIterator():
        block.append(r[0].encode())
        if len(block) == at_once:
            shipped, block = [*shipped, spark.sparkContext.broadcast(Automaton.build(block))], []
    if block:
        shipped.append(spark.sparkContext.broadcast(Automaton.build(block)))
    if not shipped:
        raise ValueError("the list of excluded names is empty")

    @F.pandas_udf("boolean")
    def mentions(texts: pd.Series) -> pd.Series:
        given = [(t or "").encode() for t in texts]
        found = shipped[0].value.found_in(given)
        for other in shipped[1:]:
            found |= other.value.found_in(given)
        return pd.Series(found)

    return rows.filter(~mentions(plain(F.col(text))))
