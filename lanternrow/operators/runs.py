"""Run tables: grids, resume, checkpoints, comparison, rescoring, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import row_key
from ..functions.values import score

KEY = ("qid", "arm", "navigator", "answerer")
#: Judges whose verdicts can be computed again.
DETERMINISTIC = ("numeric", "date", "date_list", "exact", "refusal")
#: The fields of an exported run, and why a run's answer can fail.
RUN_FIELDS = [
    "qid", "dataset", "regime", "qtype", "form", "arm", "navigator", "answerer", "correct", "judge", "evidence_recall", "evidence_precision", "wrong_doc", "latency_s",
    "llm_calls_sequential", "tokens_query", "tokens_index_amortised", "cost_usd", "gpu_s", "failure",
]
FAILURES = ["index_failed", "max_turns", "wrong_doc", "parse_failure", "wrong_page", "right_evidence_wrong_answer", "answered_unanswerable", "not_applicable", "truncated"]


def key() -> Column:
    return row_key(*(F.col(k) for k in KEY))


def grid(questions: DataFrame, arms: DataFrame, answerers: DataFrame, navigators: list[str]) -> DataFrame:
    """Every question, arm, navigator and answerer; arms (arm, navigates) that don't navigate have navigator 'none'."""
    pick = F.when(F.col("navigates"), F.array(*(F.lit(n) for n in navigators))).otherwise(F.array(F.lit("none")))
    dims = arms.withColumn("navigator", F.explode(pick)).drop("navigates").crossJoin(answerers)
    # the dimensions are a run's settings, a few rows
    return questions.crossJoin(F.broadcast(dims)) if dims.limit(10_001).count() <= 10_000 else questions.crossJoin(dims)


def pending(todo: DataFrame, done: DataFrame, *by: str) -> DataFrame:
    """Rows of todo without a finished row; those in error are to be done again."""
    return todo.join(done.filter("coalesce(failure, '') <> 'error'").select(*by).distinct(), list(by), "left_anti")


def latest(log: DataFrame, by: str, order: str) -> DataFrame:
    """The last version of each key, with the order value of its first: an upsert that keeps its place."""
    rest = [c for c in log.columns if c not in (by, order)]
    rows = log.groupBy(by).agg(F.min(order).alias(order), F.max_by(F.struct(*rest), order).alias("r"))
    return rows.select(by, order, *(F.col(f"r.{c}").alias(c) for c in rest))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per arm and over all: n shared rows and the shares of equal raw, correct, evidence, and both of the last; null equals null.

    Rows (key, arm, raw, correct, evidence); duplicates are to be taken out before, with latest().
    """
    both = a.alias("a").join(b.alias("b"), "key")
    same = {c: F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")).cast("double") for c in ("raw", "correct", "evidence")}
    same["correct_and_evidence"] = same["correct"] * same["evidence"]
    rows = both.select(F.col("a.arm").alias("arm"), *(v.alias(k) for k, v in same.items()))
    one = F.explode(F.array(F.col("arm"), F.lit("all")))
    return rows.withColumn("arm", one).groupBy("arm").agg(F.count("*").alias("n"), *(F.round(F.avg(c), 4).alias(c) for c in same))


def overlap_counts(a: DataFrame, b: DataFrame, by: str = "key") -> DataFrame:
    """One row: keys in both, only in a, only in b."""
    both = a.select(by).distinct().withColumn("x", F.lit(1)).join(b.select(by).distinct().withColumn("y", F.lit(1)), by, "full")
    return both.agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("shared"), F.count_if(F.col("y").isNull()).alias("only_a"), F.count_if(F.col("x").isNull()).alias("only_b"))


def rescore(runs: DataFrame, questions: DataFrame) -> DataFrame:
    """Rows whose verdict changes when their stored answer is scored again, with the old verdict added to history.

    runs (qid, judge, raw, correct, failure, history array of (correct, judge)); questions (qid, kind, value, values).
    """
    rows = runs.filter(F.col("judge").isin(*DETERMINISTIC) & F.col("raw").isNotNull()).join(questions.select("qid", "kind", "value", "values"), "qid")
    rows = rows.withColumn("new", score(F.col("raw"), F.col("kind"), F.col("value"), F.col("values")))
    rows = rows.filter(~F.col("new.correct").eqNullSafe(F.col("correct")) | ~F.col("new.method").eqNullSafe(F.col("judge")))
    old = F.struct(F.col("correct").alias("correct"), F.col("judge").alias("judge"))
    return rows.withColumns({"history": F.array_append(F.coalesce("history", F.array().cast("array<struct<correct: boolean, judge: string>>")), old), "correct": F.col("new.correct"), "judge": F.col("new.method")}).drop("new", "kind", "value", "values")


def flips(old: DataFrame, new: DataFrame, *by: str) -> DataFrame:
    """Counts of changed verdicts by arm, from and to."""
    rows = old.select(*by, "arm", F.col("correct").alias("was")).join(new.select(*by, F.col("correct").alias("now")), list(by))
    return rows.filter(~F.col("was").eqNullSafe(F.col("now"))).groupBy("arm", "was", "now").agg(F.count("*").alias("n"))


def shards(rows: DataFrame, by: str, order: str, size: int = 50) -> DataFrame:
    """rows with a shard number: `size` rows each, in order, within `by`."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("shard", F.floor((nth - 1) / F.lit(size)).cast("int"))


#: Trace entries that hold an arm's own prose.
TRACE_TEXTS = ("native_answer", "sdk_answer")


def redact(rows: DataFrame, licensed: list[str]) -> DataFrame:
    """rows (qid, dataset, question, gold, answer, evidence, trace) with redacted: licensed ones keep their place and gold's
    kind, but no question, no other field of gold, no answer, snippet or prose of the trace. Columns that are absent are passed over."""
    hide = F.col("dataset").isin(*licensed)
    out = rows.withColumn("redacted", F.coalesce(hide, F.lit(False)))
    hide, new = F.col("redacted"), {}
    if "question" in rows.columns:
        new["question"] = F.when(hide, F.concat("dataset", F.lit(" question "), "qid")).otherwise(F.col("question"))
    if "gold" in rows.columns:
        kept = {f.name: F.col("gold")[f.name] if f.name == "kind" else F.when(~hide, F.col("gold")[f.name]) for f in rows.schema["gold"].dataType.fields}
        new["gold"] = F.struct(*(c.alias(n) for n, c in kept.items()))
    if "answer" in rows.columns:
        new["answer"] = F.when(~hide, F.col("answer"))
    if "evidence" in rows.columns:
        new["evidence"] = F.transform("evidence", lambda e: e.withField("snippet", F.when(hide & e["snippet"].isNotNull(), F.lit("")).otherwise(e["snippet"])))
    if "trace" in rows.columns:
        new["trace"] = F.when(hide, F.map_filter("trace", lambda k, v: ~k.isin(*TRACE_TEXTS))).otherwise(F.col("trace"))
    return out.withColumns(new)


def top_snippets(evidence: Column, n: int = 5) -> Column:
    """Snippets of the first n pieces of evidence only."""
    return F.transform(evidence, lambda e, i: e.withField("snippet", F.when(i < n, e["snippet"])))


def model_roles(runs: DataFrame, roles: dict[str, str]) -> DataFrame:
    """model, roles: what each model is used for, in the order of `roles` (role: column)."""
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(r).alias("role"), F.col(c).alias("model")) for i, (r, c) in enumerate(roles.items()))))
    rows = runs.select(pairs.alias("p")).select("p.*").filter("model is not null and model <> 'none'").distinct()
    return rows.groupBy("model").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "role"))), lambda x: x["role"]), ",").alias("roles"))


def invalid_runs(runs: DataFrame, allow_errors: bool = False) -> DataFrame:
    """Rows that may not be exported, with why."""
    why = F.when((F.col("failure") == "error") & F.lit(not allow_errors), F.lit("error row")).when(F.col("failure").isNotNull() & ~F.col("failure").isin(*FAILURES, "error"), F.lit("unknown failure"))
    why = why.when(F.col("qid").isNull() | F.col("arm").isNull(), F.lit("no key")).when(F.col("evidence_recall").between(0, 1) == F.lit(False), F.lit("recall out of range"))
    return runs.withColumn("why", why).filter("why is not null")


def evidence_pages(evidence: Column) -> Column:
    """Evidence as it was written by any version, a VARIANT array, as an array of (doc_id, page, snippet).

    Older rows hold pairs [doc, page], newer ones objects, and one list may hold both; the shape of
    each piece decides. Pieces of another shape, or without a document, are left out; null stays null.
    """

    def piece(e: Column) -> Column:
        pair = F.schema_of_variant(e).startswith("ARRAY")
        get = lambda at, name, kind: F.when(pair, F.try_variant_get(e, at, kind)).otherwise(F.try_variant_get(e, name, kind))
        return F.struct(get("$[0]", "$.doc_id", "string").alias("doc_id"), get("$[1]", "$.page", "int").alias("page"), F.when(~pair, F.try_variant_get(e, "$.snippet", "string")).alias("snippet"))

    return F.filter(F.transform(F.try_variant_get(evidence, "$", "array<variant>"), piece), lambda e: e["doc_id"].isNotNull())
