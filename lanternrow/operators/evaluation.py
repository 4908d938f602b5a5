"""Answering and grading of retrieved evidence, index builds with a cache, and the rows of failed runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import extract_final, gold_text
from ..functions.values import score
from ..sources.services import complete, mock_chat
from ..storage import kept
from . import arms as A
from . import metrics as M
from .retrieval import small

#: What a run's row has no value for when it couldn't be run.
COSTS = ("latency_s", "llm_calls_sequential", "tokens_query", "cost_usd", "gpu_s")
MEASURES = ("evidence_recall", "evidence_precision", "wrong_doc")

ANSWER_FORM = "Answer from these excerpts alone. End with a line that begins with ANSWER: and holds the answer only, or NOT_STATED.\n\n{document}\n\n{query}"


def candidates(scope: DataFrame, chunks: DataFrame) -> DataFrame:
    """qid, ordinal, doc_id, page, start: the chunks of a question's documents, counted from 0 in the order of its scope (qid, doc_id, pos)."""
    rows = scope.join(chunks.select("doc_id", "page", "start"), "doc_id")
    nth = F.row_number().over(Window.partitionBy("qid").orderBy("pos", "page", "start")) - 1
    return rows.select("qid", nth.alias("ordinal"), "doc_id", "page", "start")


def build_index(chunks: DataFrame, cache: DataFrame, embed: Callable[[DataFrame], DataFrame], key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(index, new) of chunks (key, text): every chunk's embedding and input_tokens, and the rows to add to the cache.

    Only chunks that the cache (key, embedding, input_tokens) lacks are embedded; a cached chunk's
    tokens count as if it had been embedded now. Equal keys are embedded once. Write `new` before
    using it twice.
    """
    known = cache.select(key, "embedding", "input_tokens").dropDuplicates([key])
    wanted = chunks.dropDuplicates([key])
    new = embed(wanted.join(known.select(key), key, "left_anti")).select(key, "embedding", "input_tokens")
    return known.join(wanted.select(key), key, "left_semi").unionByName(new), new


def index_costs(stored: DataFrame, built: DataFrame, *by: str) -> DataFrame:
    """Costs by which an index is accounted for: those of its first build, stored ones first, then by `at`."""
    rest = [c for c in built.columns if c not in by]
    both = stored.select(*by, *rest, F.lit(0).alias("__o")).unionByName(built.select(*by, *rest, F.lit(1).alias("__o")))
    first = both.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct("__o", "at")).alias("r"))
    return first.select(*by, *(F.col(f"r.{c}").alias(c) for c in rest))


def parse_failure(questions: DataFrame, pages: DataFrame) -> DataFrame:
    """qid, parse_failure: whether a page of the gold evidence is blank or isn't there; without evidence false."""
    gold = questions.select("qid", F.explode("evidence").alias("e")).select("qid", "e.doc_id", "e.page").distinct()
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    # pages of the evidence alone are joined: they are found where they are read, if the evidence is a moderate table
    own = pages.select("doc_id", "page", "text").join(small(gold.select("doc_id", "page").distinct()), ["doc_id", "page"], "left_semi")
    blank = gold.join(own, ["doc_id", "page"], "left").groupBy("qid").agg(F.max(text == "").alias("blank"))
    return questions.select("qid").join(blank, "qid", "left").select("qid", F.coalesce("blank", F.lit(False)).alias("parse_failure"))


def answer(questions: DataFrame, blocks: DataFrame, service: Callable[[str], dict] = mock_chat, budget: int = 9000, form: str = ANSWER_FORM) -> DataFrame:
    """qid, raw, answer, truncated, input_tokens, output_tokens, latency_s, error.

    blocks (qid, rank, text) are cut to `budget` words in order. A reply that was cut off for its
    length is an error, not a wrong answer; what it cost stays.
    """
    from ..functions.text import expand

    cut = A.excerpts(blocks, "qid", budget)
    shown = cut.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "excerpt"))), lambda x: x["excerpt"]), "\n\n").alias("shown"), F.max("truncated").alias("truncated"))
    asked = questions.select("qid", "question").join(shown, "qid", "left").withColumn("prompt", expand(form, F.col("question"), F.coalesce("shown", F.lit("(no excerpts retrieved)"))))
    found = complete(asked, service=service)
    error = F.when(F.col("finish_reason") == "length", F.lit("the reply was cut off")).otherwise(F.col("error"))
    raw = F.when(error.isNull(), F.col("text"))
    return found.join(asked.select("qid", "truncated"), "qid").select("qid", raw.alias("raw"), extract_final(raw).alias("answer"), F.coalesce("truncated", F.lit(False)).alias("truncated"), "input_tokens", "output_tokens", "latency_s", error.alias("error"))


def judge(rows: DataFrame, service: Callable[[str], dict], key: str = "qid", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, keep, said, unsaid of rows (key, question, gold, candidate): right if the verdict begins with CORRECT in any case;
    unsaid is the service's error. With keep, rows without a candidate pass by unjudged."""
    prompt = F.concat_ws(
        "\n", F.lit("Does the candidate state the same fact as the reference? Other wording is fine. Reply with one word, CORRECT or INCORRECT."),
        F.concat(F.lit("Question: "), F.coalesce("question", F.lit(""))), F.concat(F.lit("Reference: "), F.coalesce("gold", F.lit(""))), F.concat(F.lit("Candidate: "), F.coalesce("candidate", F.lit(""))),
    )
    asked = rows.select(key, *keep, F.when(F.col("candidate").isNotNull() | F.lit(not keep), prompt).alias("prompt"))
    found = complete(asked, key, service=service, keep=keep)
    return found.select(key, *keep, F.upper(F.regexp_replace("text", r"^\s+", "")).startswith("CORRECT").alias("said"), F.col("error").alias("unsaid"))


def stopped(rows: DataFrame) -> DataFrame:
    """Rows (not_applicable, failure, navigator, native, arm, answerer, …) of runs that gave nothing to answer from.

    Not applicable ones have no verdict and no measures, failed ones are wrong and keep their
    measures; neither has costs. A failed run that has its arm's own answer has a row of that, too.
    """
    off = F.coalesce("not_applicable", F.lit(False))
    kind = dict(rows.dtypes)
    out = rows.filter(off | F.col("failure").isNotNull()).withColumns(
        {"correct": F.when(~off, F.lit(False)), "judge": F.lit(None).cast("string"), "failure": F.when(off, F.lit("not_applicable")).otherwise(F.col("failure"))}
        | {c: F.when(~off, F.col(c)) for c in MEASURES if c in rows.columns}
        | {c: F.lit(None).cast(kind[c]) for c in COSTS if c in rows.columns}
    )
    twin = out.filter((F.col("failure") != "not_applicable") & F.col("native").isNotNull())
    return out.unionByName(twin.withColumns({"arm": F.concat("arm", F.lit("_native")), "answerer": F.col("navigator")}))


def error_rows(failed: DataFrame) -> DataFrame:
    """Rows (…, error) of runs whose service failed: failure 'error', no verdict, measures or costs."""
    kind = dict(failed.dtypes)
    gone = {c: F.lit(None).cast(kind[c]) for c in (*MEASURES, *COSTS, "tokens_index_amortised", "correct", "judge") if c in failed.columns}
    return failed.filter("error is not null").withColumns({**gone, "failure": F.lit("error")})


def evaluate(questions: DataFrame, retrieved: DataFrame, pages: DataFrame, service: Callable[[str], dict], judged_by: Callable[[str], dict], budget: int = 9000) -> DataFrame:
    """qid, answer, correct, judge, evidence_recall, evidence_precision, wrong_doc, failure, error of each question.

    questions (qid, question, doc_ids, evidence, gold of kind, value, values), retrieved (qid, rank,
    doc_id, page, kind, text). Answers are scored by rule; free ones go to the judge. A service's
    failure, the judge's too, is an error row.
    """
    found = answer(questions, retrieved.select("qid", "rank", "text"), service, budget)
    scored = questions.join(found, "qid").withColumn("s", score(F.col("raw"), F.col("gold.kind"), F.col("gold.value"), F.col("gold.values")))
    scored = scored.select("qid", "question", "answer", "error", gold_text(F.col("gold.kind"), F.col("gold.value"), F.col("gold.values")).alias("gold"), "s.*")
    scored = scored.withColumnRenamed("error", "unanswered").withColumn("candidate", F.when(F.col("unanswered").isNull() & F.col("correct").isNull(), F.coalesce("answer", F.lit(""))))
    # the judge's pass carries the answers on, so that no service is asked twice
    rows = judge(scored, judged_by, keep=("answer", "correct", "method", "failure", "unanswered"))
    rows = rows.join(M.evidence_metrics(questions, retrieved), "qid").join(parse_failure(questions, pages), "qid")
    rows = rows.withColumns({"correct": F.coalesce("correct", "said"), "error": F.coalesce("unanswered", "unsaid")})
    why, ran = M.failure_class(F.col("correct"), F.col("failure"), F.col("recall"), F.col("wrong_doc"), F.col("parse_failure")), F.col("error").isNull()
    kept = {"correct": "correct", "method": "judge", "recall": "evidence_recall", "precision": "evidence_precision", "wrong_doc": "wrong_doc"}
    return rows.select("qid", F.when(ran, F.col("answer")).alias("answer"), *(F.when(ran, F.col(c)).alias(n) for c, n in kept.items()), F.when(ran, why).otherwise("error").alias("failure"), "error")


#: A run's row as run_rows() gives it.
ROW = ("qid", "arm", "navigator", "answerer", "answer", "correct", "judge", *MEASURES, *COSTS, "tokens_index_amortised", "failure", "error")


def run_rows(
    questions: DataFrame, evidence: DataFrame, outcomes: DataFrame, calls: DataFrame, pages: DataFrame, index: DataFrame, prices: DataFrame, folder: str,
    service: Callable[[str], dict], judged_by: Callable[[str], dict], arm: str, navigator: str = "none", answerer: str = "answerer", n_questions: int = 1, local: bool = True, budget: int = 9000,
) -> DataFrame:
    """A row of ROW for each question of one arm, and one more where the arm gave an answer of its own.

    outcomes (qid, not_applicable, failure, native_answer, error) says what retrieval came to: a
    question that doesn't apply has no verdict, one that failed is wrong without asking anyone, one
    in error is an error row. The others are answered from their evidence, scored by rule or judged,
    and charged with retrieval (calls) and answer; the arm's own answer is judged as prose and
    charged with retrieval alone, under the name of arm and "_native". index (one row: input_tokens,
    output_tokens, gpu_s, cost_usd) is shared by n_questions. Answers and verdicts are stored in
    folder before they are used, so neither a lost executor nor a second start asks again.
    """
    columns = set(outcomes.columns)
    given = lambda name, kind: F.col(name) if name in columns else F.lit(None).cast(kind).alias(name)
    state = outcomes.select("qid", given("not_applicable", "boolean"), given("failure", "string").alias("stop"), given("native_answer", "string"), given("error", "string").alias("lost"))
    base = questions.join(state, "qid", "left").withColumn("open", F.coalesce(~F.coalesce("not_applicable", F.lit(False)) & F.col("stop").isNull() & F.col("lost").isNull(), F.lit(True)))
    asked = base.filter("open")
    found = kept(answer(asked, evidence.select("qid", "rank", "text"), service, budget), f"{folder}/answers")
    gold = gold_text(F.col("gold.kind"), F.col("gold.value"), F.col("gold.values"))
    scored = asked.join(found, "qid").withColumn("s", score(F.col("raw"), F.col("gold.kind"), F.col("gold.value"), F.col("gold.values")))
    free = scored.filter("error is null and s.correct is null").select("qid", F.lit("main").alias("what"), "question", gold.alias("gold"), F.coalesce("answer", F.lit("")).alias("candidate"))
    own = asked.filter("native_answer is not null").select("qid", F.lit("native").alias("what"), "question", gold.alias("gold"), F.col("native_answer").alias("candidate"))
    verdicts = kept(judge(free.unionByName(own), judged_by, keep=("what",)), f"{folder}/verdicts")
    said = lambda what: verdicts.filter(F.col("what") == what).drop("what")

    measured = M.evidence_metrics(questions, evidence).join(parse_failure(questions, pages), "qid")
    to_answer = found.select("qid", F.lit(answerer).alias("model"), "input_tokens", "output_tokens", "latency_s", F.lit(local).alias("local"), F.lit(None).cast("string").alias("parallel_group"))
    retrieval = calls.select(*to_answer.columns)
    one = index.limit(1).withColumn("arm", F.lit(arm))

    def charged(rows: DataFrame, ran: DataFrame) -> DataFrame:
        sums = M.ledger(ran, prices, "qid").select("qid", "latency_s", F.col("sequential").alias("llm_calls_sequential"), (F.col("input_tokens") + F.col("output_tokens")).alias("tokens_query"), "cost_usd", "gpu_s")
        out = M.amortised(rows.join(sums, "qid", "left").withColumn("arm", F.lit(arm)), one, n_questions, "arm")
        # a question that took no call has used none
        return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("llm_calls_sequential", "tokens_query")} | {"latency_s": F.coalesce("latency_s", F.lit(0.0))})

    def classed(rows: DataFrame, prior) -> DataFrame:
        rows = rows.join(measured, "qid")
        why = M.failure_class(F.col("correct"), prior, F.col("recall"), F.col("wrong_doc"), F.col("parse_failure"))
        return rows.withColumns({"failure": why, "evidence_recall": F.col("recall"), "evidence_precision": F.col("precision")})

    main = scored.select("qid", "answer", F.col("s.correct").alias("by_rule"), F.col("s.method").alias("judge"), F.col("s.failure").alias("prior"), F.col("error").alias("unanswered")).join(said("main"), "qid", "left")
    main = main.select("qid", "answer", F.coalesce("by_rule", "said").alias("correct"), "judge", "prior", F.coalesce("unanswered", "unsaid").alias("error"))
    main = classed(charged(main, retrieval.unionByName(to_answer)), F.col("prior")).withColumns({"arm": F.lit(arm), "navigator": F.lit(navigator), "answerer": F.lit(answerer)})
    twin = asked.filter("native_answer is not null").select("qid", F.col("native_answer").alias("answer"), (F.col("gold.kind") == "unanswerable").alias("none")).join(said("native"), "qid")
    twin = twin.select("qid", F.substring("answer", 1, 500).alias("answer"), F.col("said").alias("correct"), F.lit("llm").alias("judge"), F.when(F.col("none") & ~F.col("said"), "answered_unanswerable").alias("prior"), F.col("unsaid").alias("error"))
    twin = classed(charged(twin, retrieval), F.col("prior")).withColumns({"arm": F.lit(f"{arm}_native"), "navigator": F.lit(navigator), "answerer": F.lit(navigator)})
    ran = main.select(*ROW).unionByName(twin.select(*ROW))

    ended = base.filter(~F.col("open")).select("qid", "not_applicable", F.col("stop").alias("failure"), F.col("native_answer").alias("native"), F.col("lost").alias("error"))
    ended = charged(ended, retrieval).join(measured, "qid").withColumns({
        "evidence_recall": F.col("recall"), "evidence_precision": F.col("precision"), "arm": F.lit(arm), "navigator": F.lit(navigator), "answerer": F.lit(answerer), "answer": F.lit(None).cast("string"),
        "correct": F.lit(None).cast("boolean"), "judge": F.lit(None).cast("string"),
    })
    failed = stopped(ended.filter("error is null")).select(*ROW)
    # an arm that answers by itself is wrong under that name, too, where it failed
    if "native_answer" in columns:
        failed = failed.filter(F.col("arm") == arm)
        failed = failed.unionByName(failed.filter("failure <> 'not_applicable'").withColumns({"arm": F.lit(f"{arm}_native"), "answerer": F.lit(navigator)}))
    return ran.filter("error is null").unionByName(failed).unionByName(error_rows(ran.unionByName(ended.select(*ROW))))
