"""Reports on question sets and grades: quotas by type, agreement, progress, blind queues, paired statistics, page excerpts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metrics as M

#: The question types and regimes that quotas cover, the least numbers, and the least agreement.
QTYPES = ("lookup", "table", "computation", "cross_doc", "disambiguation", "unanswerable")
REGIMES = ("A", "B")
LEAST_TEST, LEAST_UNANSWERABLE, LEAST_TYPE = 150, 0.10, 40
LEAST_KAPPA, LEAST_GRADED = 0.7, 100


def quota_gaps(questions: DataFrame, types: tuple[str, ...] = QTYPES, regimes: tuple[str, ...] = REGIMES) -> DataFrame:
    """what ('test', 'unanswerable' or 'type'), name, value, least: thresholds that a question set misses.

    Questions of one pair count once, of other regimes not at all. Regimes and types without any question are gaps, too.
    """
    one = questions.withColumn("nth", F.row_number().over(Window.partitionBy(F.coalesce("pair_id", "qid")).orderBy("qid"))).filter("nth = 1").filter(F.col("regime").isin(*regimes))
    named = lambda names: one.sparkSession.createDataFrame([(n,) for n in names], "name string")
    per = one.groupBy(F.col("regime").alias("name")).agg(F.count_if(F.col("split") == "test").cast("double").alias("test"), F.avg((F.col("qtype") == "unanswerable").cast("double")).alias("unanswerable"))
    per = named(regimes).join(per, "name", "left").fillna(0.0)
    line = lambda what, least: F.struct(F.lit(what).alias("what"), F.col(what).alias("value"), F.lit(float(least)).alias("least"))
    a = per.select("name", F.explode(F.array(line("test", LEAST_TEST), line("unanswerable", LEAST_UNANSWERABLE))).alias("g")).select("g.what", "name", "g.value", "g.least")
    b = named(types).join(one.groupBy(F.col("qtype").alias("name")).agg(F.count("*").cast("double").alias("value")), "name", "left").fillna(0.0)
    return a.unionByName(b.select(F.lit("type").alias("what"), "name", "value", F.lit(float(LEAST_TYPE)).alias("least"))).filter("value < least")


def latest_grades(log: DataFrame) -> DataFrame:
    """grader, item_id, correct: each grader's last word on an item that wasn't undone; log (grader, item_id, action, at)."""
    from .questions import replay

    force = replay(log.withColumnRenamed("grader", "log"), "item_id")
    return force.select(F.col("log").alias("grader"), "item_id", (F.col("action") == "correct").alias("correct"))


def kappa_report(queue: DataFrame, grades: DataFrame) -> DataFrame:
    """Per grader: n, kappa and agreement to three digits, grader_correct, judge_correct, passes, disagreements (item_ids, sorted).

    queue (item_id, judge_correct), grades (grader, item_id, correct); a grader without graded items has no row.
    """
    both = queue.join(grades, "item_id")
    j, g = F.col("judge_correct").cast("int"), F.col("correct").cast("int")
    one = both.groupBy("grader").agg(
        F.count("*").alias("n"), F.avg((j == g).cast("double")).alias("po"), F.sum(g).alias("grader_correct"), F.sum(j).alias("judge_correct"),
        F.sort_array(F.collect_list(F.when(j != g, F.col("item_id")))).alias("disagreements"),
    )
    a, b = F.col("grader_correct") / F.col("n"), F.col("judge_correct") / F.col("n")
    pe = a * b + (1 - a) * (1 - b)
    kappa = F.when(pe == 1, F.when(F.col("po") == 1, 1.0).otherwise(0.0)).otherwise((F.col("po") - pe) / (1 - pe))
    return one.select("grader", "n", F.round(kappa, 3).alias("kappa"), F.round("po", 3).alias("agreement"), "grader_correct", "judge_correct", ((kappa >= LEAST_KAPPA) & (F.col("n") >= LEAST_GRADED)).alias("passes"), "disagreements")


def accepted(drafts: DataFrame, decisions: DataFrame) -> DataFrame:
    """regime, qtype, accepted: accepted drafts that are known."""
    return decisions.filter("action = 'accept'").select("draft_id").distinct().join(drafts, "draft_id").groupBy("regime", "qtype").agg(F.count("*").alias("accepted"))


def progress(drafts: DataFrame, decisions: DataFrame) -> DataFrame:
    """regime, qtype, accepted, open: of each type that has drafts; open ones have no decision."""
    left = drafts.join(decisions.select("draft_id").distinct(), "draft_id", "left_anti").groupBy("regime", "qtype").agg(F.count("*").alias("open"))
    all_ = drafts.select("regime", "qtype").distinct()
    return all_.join(accepted(drafts, decisions), ["regime", "qtype"], "left").join(left, ["regime", "qtype"], "left").fillna(0, ["accepted", "open"])


def blind(queue: DataFrame, grades: DataFrame, n: int = 10, shown: tuple[str, ...] = ("item_id", "question", "gold", "answer"), order: str = "pos") -> DataFrame:
    """The first n ungraded items in the queue's order, without the judge's verdict."""
    return queue.join(grades.select("item_id").distinct(), "item_id", "left_anti").orderBy(order).limit(n).select(*shown)


def offered(drafts: DataFrame) -> DataFrame:
    """Drafts that are open for review."""
    return drafts.filter(F.col("status") == "draft")


def in_splits(questions: DataFrame, splits: list[str]) -> DataFrame:
    """Questions of the splits."""
    return questions.filter(F.col("split").isin(*splits))


def of_regime(manifest: DataFrame, store: DataFrame, regime: str) -> DataFrame:
    """doc_id of a regime's documents that the store has."""
    return manifest.filter(F.col("regime") == regime).select("doc_id").distinct().join(store.select("doc_id"), "doc_id", "left_semi")


def chosen_arms(asked: list[str], configured: list[str]) -> list[str]:
    """The arms asked for, all if none; one that isn't configured is an error."""
    strange = [a for a in asked if a not in configured]
    if strange:
        raise ValueError(f"not configured: {', '.join(strange)}; configured: {', '.join(configured)}")
    return asked or configured


def retained(manifest: DataFrame, fetched: DataFrame, errors: DataFrame) -> DataFrame:
    """Manifest rows after a fetch: fetched versions replace their rows, documents excluded by their text go, other failures stay as they were."""
    out = errors.filter(F.contains("why", F.lit("excluded issuer"))).select("doc_id").distinct()
    left = manifest.join(out, "doc_id", "left_anti")
    return left.join(fetched.select("doc_id"), "doc_id", "left_anti").unionByName(fetched.join(left.select("doc_id").distinct(), "doc_id", "left_semi").select(*manifest.columns))


def paired(a: DataFrame, b: DataFrame, key: str = "qid") -> DataFrame:
    """One row of two arms' verdicts on shared, judged questions: n, both, only_a, only_b, p of McNemar's exact two-sided test."""
    rows = a.select(key, F.col("correct").alias("x")).join(b.select(key, F.col("correct").alias("y")), key).filter("x is not null and y is not null")
    one = rows.agg(F.count("*").alias("n"), F.count_if(F.col("x") & F.col("y")).alias("both"), F.count_if(F.col("x") & ~F.col("y")).alias("only_a"), F.count_if(~F.col("x") & F.col("y")).alias("only_b"))
    m, low = F.col("only_a") + F.col("only_b"), F.least("only_a", "only_b")
    # terms of the binomial tail by their logarithms, each from the one before
    zero = F.struct((-m * F.log(F.lit(2.0))).alias("term"), F.lit(0.0).alias("sum"))
    step = lambda acc, i: F.struct((acc["term"] + F.log((m - i) / (i + 1))).alias("term"), (acc["sum"] + F.exp(acc["term"])).alias("sum"))
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), low), zero, lambda acc, i: F.when(i < m, step(acc, i)).otherwise(F.struct(acc["term"].alias("term"), (acc["sum"] + F.exp(acc["term"])).alias("sum"))))["sum"]
    return one.select("n", "both", "only_a", "only_b", F.least(2 * tail, F.lit(1.0)).alias("p"))


def holm(tests: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """tests, a family of few, with adjusted (Holm's step-down p-value) and rejected."""
    w = Window.orderBy(p)
    steps = tests.withColumn("__m", F.count("*").over(Window.partitionBy())).withColumn("__i", F.row_number().over(w) - 1)
    raised = F.least(F.lit(1.0), (F.col("__m") - F.col("__i")) * F.col(p))
    out = steps.withColumn("adjusted", F.max(raised).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__m", "__i")
    return out.withColumn("rejected", F.col("adjusted") < alpha)


def paired_bootstrap(a: DataFrame, b: DataFrame, key: str, value: str, n: int = 10_000, seed: int = 7) -> DataFrame:
    """One row: mean difference a - b over shared keys, its 95 % interval over n resamples, and the share of resamples where a wins."""
    both = a.select(key, F.col(value).cast("double").alias("x")).join(b.select(key, F.col(value).cast("double").alias("y")), key).select(key, (F.col("x") - F.col("y")).alias("d"))
    draws = M.bootstrap(both, key, "d", n, seed).agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"), F.avg((F.col("mean") > 0).cast("double")).alias("wins"))
    return both.agg(F.avg("d").alias("difference")).crossJoin(draws)


def tidy(text: Column) -> Column:
    """Rules and runs of blank table cells shortened."""
    return F.regexp_replace(F.regexp_replace(text, "-{4,}", "—"), r"(?:\|\s*){3,}", "| ")


def excerpt(text: Column, quote: Column, reach: int = 450, most: int = 12) -> Column:
    """(before, marked, after, found): the page around a quote's first `most` words, whatever stands between them; of a quote
    under three words or not on the page the page's first 2 * reach characters as `before`."""
    page = tidy(F.coalesce(text, F.lit("")))
    parts = F.slice(F.regexp_extract_all(F.coalesce(quote, F.lit("")), F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0)), 1, most)
    # words have no marks, so the pattern needs no escapes
    pattern = F.concat(F.lit("(?iu)"), F.array_join(parts, r"[^\p{L}\p{M}\p{N}_]+"))
    found = F.when(F.size(parts) >= 3, F.regexp_substr(page, pattern))

    def cut(p: Column, marked: Column) -> Column:
        at = F.instr(p, F.coalesce(marked, F.lit("")))
        first = F.greatest(at - reach, F.lit(1))
        part = lambda a, b, c, ok: F.struct(a.alias("before"), b.alias("marked"), c.alias("after"), F.lit(ok).alias("found"))
        whole = part(F.left(p, F.lit(2 * reach)), F.lit(""), F.lit(""), False)
        return F.when(marked.isNotNull(), part(F.substr(p, first, at - first), marked, F.substr(p, at + F.length(marked), F.lit(reach)), True)).otherwise(whole)

    # bound as a lambda's variable, the page is searched once
    return F.get(F.transform(F.array(F.struct(page.alias("p"), found.alias("m"))), lambda x: cut(x["p"], x["m"])), F.lit(0))


def parse_answer(kind: Column, text: Column) -> Column:
    """(value, values) of an answer as a reviewer types it: a list for date_list, nothing for unanswerable."""
    parts = F.filter(F.transform(F.split(text, r"[,;\n]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    one = F.when(~kind.isin("unanswerable", "date_list"), F.regexp_replace(text, r"^\s+|\s+$", ""))
    return F.struct(one.alias("value"), F.when(kind == "date_list", parts).alias("values"))


def draft_view(drafts: DataFrame, descriptions: DataFrame, facts: DataFrame, pages: DataFrame) -> DataFrame:
    """What a reviewer sees of each draft: draft_id, by_isin, by_description, answer, evidence, siblings, pages.

    drafts (draft_id, regime, doc_ids, isin, question, answer, evidence, field, siblings), descriptions
    (doc_id, description), facts (doc_id, field, value), pages (doc_id, page, text). A product's
    question is shown in both forms, without the second where it has no description of its own;
    siblings carry the value of the draft's field and their descriptions; pages are the evidence's.
    """
    first = drafts.withColumn("doc0", F.get("doc_ids", F.lit(0))).join(descriptions.select(F.col("doc_id").alias("doc0"), "description"), "doc0", "left")
    form = lambda name: F.when(F.col("regime") == "A", rendered(F.col("question"), name)).otherwise(F.col("question"))
    base = first.select("draft_id", form(F.concat(F.lit("the product with ISIN "), "isin")).alias("by_isin"), F.when(F.col("regime") == "A", form(F.col("description"))).alias("by_description"), "answer", F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["doc_id"], e["page"])), ", ").alias("evidence"))
    near = drafts.select("draft_id", "field", F.explode("siblings").alias("doc_id")).join(facts.select("doc_id", "field", "value"), ["doc_id", "field"], "left").join(descriptions.select("doc_id", "description"), "doc_id", "left")
    near = near.groupBy("draft_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "value", "description"))).alias("siblings"))
    shown = drafts.select("draft_id", F.posexplode("evidence").alias("i", "e")).select("draft_id", "i", "e.doc_id", "e.page").join(pages.select("doc_id", "page", tidy(F.col("text")).alias("text")), ["doc_id", "page"])
    shown = shown.groupBy("draft_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "doc_id", "page", "text"))), lambda p: F.struct(p["doc_id"].alias("doc_id"), p["page"].alias("page"), p["text"].alias("text"))).alias("pages"))
    return base.join(near, "draft_id", "left").join(shown, "draft_id", "left")


def rendered(template: Column, reference: Column) -> Column:
    """A question with its placeholder replaced, in capitals at the start if the placeholder stood there."""
    text = F.replace(template, F.lit("{product}"), reference)
    return F.when(template.startswith("{product}"), F.concat(F.upper(F.left(text, F.lit(1))), F.substring(text, 2, 1 << 30))).otherwise(text)


def decision_problems(decisions: DataFrame, drafts: DataFrame) -> DataFrame:
    """draft_id, problem of each decision (draft_id, action, reason, kind, evidence) that may not be appended.

    Every decision needs a reason and a known draft and is accept or reject; what is accepted has
    evidence on the draft's own documents, or none if it is unanswerable. Edits that are null keep what was drafted.
    """
    rows = decisions.alias("d").join(drafts.alias("f"), "draft_id", "left")
    kind, evidence = F.coalesce("d.kind", "f.kind"), F.coalesce("d.evidence", "f.evidence")
    held = F.when(kind == "unanswerable", F.array().cast("array<struct<doc_id: string, page: int>>")).otherwise(evidence)
    accept = F.col("d.action") == "accept"
    problems = [
        F.when(F.trim(F.coalesce("d.reason", F.lit(""))) == "", "every decision needs a reason"),
        F.when(~F.col("d.action").isin("accept", "reject"), "unknown action"),
        F.when(F.col("f.doc_ids").isNull(), "unknown draft"),
        F.when(accept & (kind != "unanswerable") & (F.size(F.coalesce(evidence, F.array().cast("array<struct<doc_id: string, page: int>>"))) == 0), "an answer without evidence"),
        F.when(accept & F.exists(held, lambda e: ~F.array_contains("f.doc_ids", e["doc_id"])), "evidence on another document"),
    ]
    return rows.select("draft_id", F.explode(F.array_compact(F.array(*problems))).alias("problem"))


def new_products(found: DataFrame, known: DataFrame, names: DataFrame, key: str = "doc_id", name: str = "name") -> DataFrame:
    """Products of a listing that aren't in the manifest yet and whose name mentions no excluded one; of repeated ones the first by pos."""
    from .questions import excluded

    first = found.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).filter("__n = 1").drop("__n")
    return excluded(first.join(known.select(key).distinct(), key, "left_anti"), names, name)
