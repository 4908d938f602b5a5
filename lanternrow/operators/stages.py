"""Drafting of questions by a chat service: facts, windows, unanswerable and cross-document questions, as stages of a ledger.

A stage is a function from tasks to rows (task, error, records): prompts are made by joins, a task
asks the service once or twice, and each reply's items are checked by columns. What the service says
is stored before anything reads it. A task whose reply fails, is cut off or isn't JSON has an error
and no records; the ledger gives it to the next run again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import human_date, parse_json, render_pages, words
from ..sources.services import complete, fuzzy_quotes
from ..storage import bucketed, written
from . import drafting as D
from .ledger import Ledger
from .questions import normalise_answer

Chat = Callable[[str], dict]

#: Question types of a window, and what a product question must hold.
TYPES = ("lookup", "table", "computation")
PLACEHOLDER = "{product}"
#: Content pages that state a product's terms, words that make a page one of content, words of a document that is checked whole, pages else.
KEY_PAGES, LEAST_WORDS, CONFIRM_WORDS, CONFIRM_PAGES = 12, 40, 45_000, 15

EVIDENCE = "array<struct<doc_id: string, page: int>>"
QUOTES = "array<struct<doc_id: string, page: int, text: string, ok: boolean>>"
RECORD = f"struct<n: int, qtype: string, doc_ids: array<string>, question: string, answer: struct<kind: string, value: string, values: array<string>>, evidence: {EVIDENCE}, quotes: {QUOTES}, status: string, reason: string>"


def doc_label(issuer: Column, kind: Column, issued: Column) -> Column:
    """'the <issuer> <kind> dated 5 June 2027'; without a date, no date."""
    return F.concat(F.lit("the "), issuer, F.lit(" "), F.replace(kind, F.lit("_"), F.lit(" ")), F.coalesce(F.concat(F.lit(" dated "), human_date(issued)), F.lit("")))


def key_pages(pages: DataFrame, n: int = KEY_PAGES, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, pages: the first n pages of content of each document."""
    return D.content_pages(pages, least, n).groupBy("doc_id").agg(F.sort_array(F.collect_list("page")).alias("pages"))


def shown_pages(tasks: DataFrame, pages: DataFrame) -> DataFrame:
    """tasks (task, doc_id, pages, …) that name a page that there is, with shown: those pages as a prompt has them.

    Met and grouped by document, so that bucketed pages stay where they are.
    """
    rest = [c for c in tasks.columns if c not in ("task", "doc_id")]
    text = pages.select("doc_id", F.col("page").alias("__p"), F.col("text").alias("__text"))
    named = text.join(tasks.hint("shuffle_hash"), "doc_id").filter(F.array_contains("pages", F.col("__p")))
    return named.groupBy("doc_id", "task").agg(*(F.first(c).alias(c) for c in rest), render_pages(F.collect_list(F.struct(F.col("__p").alias("page"), F.col("__text").alias("text")))).alias("shown"))


def asked(prompts: DataFrame, service: Chat, schema: str) -> DataFrame:
    """prompts (task, prompt, …) with said, the reply's JSON, and error: the service's, or why the reply can't be used. Stored, so that nothing asks or makes prompts again."""
    rest = [c for c in prompts.columns if c not in ("task", "prompt")]
    found = written(complete(prompts, "task", service=service, keep=tuple(rest)), "replies").withColumns({"said": parse_json(F.col("text"), schema), "lost": F.col("error")})
    error = F.coalesce("lost", F.when(F.col("finish_reason") == "length", "the reply was cut off").when(F.col("said").isNull(), "no JSON object in the reply"))
    return found.select("task", *rest, "said", error.alias("error"))


def _prompt(kind: str, *parts) -> Column:
    return F.concat_ws("\n", F.lit(f"Task: {kind}"), *parts)


def _gathered(tasks: DataFrame, items: DataFrame) -> DataFrame:
    """task, error, records: the items' records of each task in order; a task that went well without items has an empty list."""
    lists = items.groupBy("task").agg(F.array_sort(F.collect_list("record")).alias("records"))
    none = F.array().cast(f"array<{RECORD}>")
    return tasks.select("task", "error").join(lists, "task", "left").select("task", "error", F.when(F.col("error").isNull(), F.coalesce("records", none)).alias("records"))


def _record(n: Column, qtype: Column, doc_ids: Column, answer: Column, evidence: Column, quotes: Column, reason: Column) -> Column:
    status = F.when(reason.isNull(), "draft").otherwise("auto_rejected")
    return F.struct(n.alias("n"), qtype.alias("qtype"), doc_ids.alias("doc_ids"), F.trim("question").alias("question"), answer.alias("answer"), evidence.alias("evidence"), quotes.alias("quotes"), status.alias("status"), reason.alias("reason")).cast(RECORD)


def _no_product(regime: Column) -> Column:
    return F.when((regime == "A") & ~F.contains("question", F.lit(PLACEHOLDER)), f"question does not use the {PLACEHOLDER} placeholder")


def fact_tasks(docs: DataFrame, pages: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """task, doc_id, pages: one for each product document (doc_id, regime) that has pages of content."""
    return docs.filter("regime = 'A'").select("doc_id").join(key_pages(pages, least=least), "doc_id").select(F.concat(F.lit("facts:"), "doc_id").alias("task"), "doc_id", "pages")


def facts_work(pages: DataFrame, service: Chat) -> Callable[[DataFrame], DataFrame]:
    """Facts of a document with their quotes checked: records are (field, value, page, quote, quote_ok)."""

    def work(tasks: DataFrame) -> DataFrame:
        prompts = shown_pages(tasks, pages).withColumn("prompt", _prompt("facts", "doc_id", "shown"))
        got = asked(prompts.select("task", "doc_id", "prompt"), service, "facts map<string, struct<value: string, page: int, quote: string>>")
        got = got.withColumn("error", F.coalesce("error", F.when(F.col("said.facts").isNull(), "no facts in the reply")))
        facts = got.filter("error is null").select("task", "doc_id", F.explode("said.facts").alias("field", "f")).select("task", "doc_id", "field", "f.*")
        checked = D.facts_quoted(D.on_their_pages(facts, pages).drop("__there")).groupBy("task").agg(F.array_sort(F.collect_list(F.struct("field", "value", "page", "quote", "quote_ok"))).alias("records"))
        return got.select("task", "error").join(checked, "task", "left")

    return work


def window_tasks(docs: DataFrame, pages: DataFrame, n: int = 14, seed: int = 17, least: int = LEAST_WORDS, window_least: int = 120) -> DataFrame:
    """task, doc_id, regime, label, pages: a product's key pages, other documents' drawn windows; docs (doc_id, regime, label)."""
    of = lambda regime: pages.join(docs.filter(F.col("regime") == regime).select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi")
    own = key_pages(of("A"), least=least).withColumn("w", F.lit(0)).join(docs.filter("regime = 'A'"), "doc_id")
    drawn = D.page_windows(of("B"), n, least=window_least, seed=seed).withColumn("w", F.row_number().over(Window.partitionBy("doc_id").orderBy("start")) - 1).join(docs.filter("regime = 'B'"), "doc_id")
    both = own.select("doc_id", "regime", "label", "w", "pages").unionByName(drawn.select("doc_id", "regime", "label", "w", "pages"))
    return both.select(F.concat_ws(":", F.lit("window"), "doc_id", "w").alias("task"), "doc_id", "regime", "label", "w", "pages")


def window_work(pages: DataFrame, service: Chat, focus: Callable[[Column], Column] | None = None) -> Callable[[DataFrame], DataFrame]:
    """Questions on a window's pages; what lies outside it or isn't quoted from it is thrown out, with why."""

    def work(tasks: DataFrame) -> DataFrame:
        nudge = focus(F.col("doc_id")) if focus else F.lit("")
        prompts = shown_pages(tasks, pages).withColumn("prompt", _prompt("window", "label", nudge, "shown")).drop("shown")
        item = "struct<qtype: string, question: string, kind: string, answer: string, evidence: array<int>, quote: string>"
        got = asked(prompts, service, f"questions array<{item}>")
        items = got.filter("error is null").select("task", "doc_id", "regime", F.col("pages").alias("window"), F.posexplode("said.questions").alias("n", "q")).select("*", "q.*")
        items = items.filter(F.col("qtype").isin(*TYPES) & (F.coalesce("question", F.lit("")) != "")).withColumn("evidence", F.array_sort(F.array_distinct(F.filter(F.coalesce("evidence", F.array().cast("array<int>")), lambda p: p.isNotNull()))))
        good = _quoted(items.select("task", "n", "doc_id", F.explode("evidence").alias("page"), "quote"), pages).filter("on_page").groupBy("task", "n").agg(F.min("page").alias("hit"))
        items = items.join(good, ["task", "n"], "left")
        why = F.coalesce(D.window_item_reason(F.col("evidence"), F.col("window"), F.col("hit").isNotNull()), _no_product(F.col("regime")))
        at = F.coalesce("hit", F.get("evidence", F.lit(0)))
        # without evidence there is nothing that a quote could stand on
        quotes = F.when(F.size("evidence") > 0, F.array(F.struct(F.col("doc_id"), at.alias("page"), F.col("quote").alias("text"), F.col("hit").isNotNull().alias("ok")))).otherwise(F.array()).cast(QUOTES)
        evidence = F.transform("evidence", lambda p: F.struct(F.col("doc_id").alias("doc_id"), p.alias("page")))
        record = _record(F.col("n"), F.col("qtype"), F.array("doc_id"), normalise_answer(F.col("kind"), F.col("answer")), evidence, quotes, why)
        return _gathered(got, items.select("task", record.alias("record")))

    return work


def _quoted(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """rows (…, doc_id, page, quote) with on_page: the quote stands on the page, or nearly; and __there: there is such a page."""
    return fuzzy_quotes(D.on_their_pages(rows, pages), "quote", "__text").drop("__text")


def unanswerable_tasks(windows: DataFrame, round_: int = 1) -> DataFrame:
    """The window tasks that unanswerable questions are asked of: a product's, and every other one of the other documents. Later rounds have keys of their own."""
    some = windows.filter((F.col("regime") == "A") | (F.col("w") % 2 == 0))
    key = F.concat_ws(":", F.lit("unanswerable"), "doc_id", F.when(F.col("regime") == "A", F.col("w")).otherwise(F.col("w") / 2).cast("int"), F.lit(f"r{round_}" if round_ > 1 else None))
    return some.withColumn("task", key)


def unanswerable_work(pages: DataFrame, service: Chat, focus: Callable[[Column], Column] | None = None) -> Callable[[DataFrame], DataFrame]:
    """Questions that a document doesn't answer: each is put to the service again with the pages that would answer it, and thrown out unless it finds none."""

    def work(tasks: DataFrame) -> DataFrame:
        nudge = focus(F.col("doc_id")) if focus else F.lit("")
        prompts = shown_pages(tasks, pages).withColumn("prompt", _prompt("unanswerable", "label", nudge, "shown")).drop("shown")
        got = asked(prompts, service, "questions array<struct<question: string, keywords: array<string>>>")
        items = got.filter("error is null").select("task", "doc_id", "regime", F.posexplode("said.questions").alias("n", "q")).select("*", "q.*").filter(F.trim(F.coalesce("question", F.lit(""))) != "").withColumn("item_id", F.concat_ws("#", "task", "n"))
        asks = items.select("item_id", "doc_id", F.concat_ws(" ", "question", F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), " ")).alias("text"))
        scope = D.confirm_scope(asks, pages.filter(F.size(words(F.col("text"))) > 0), CONFIRM_WORDS, CONFIRM_PAGES).groupBy("item_id", "doc_id").agg(F.sort_array(F.collect_list("page")).alias("pages"))
        checks = scope.join(items.select("item_id", "question"), "item_id").withColumnRenamed("item_id", "task")
        again = shown_pages(checks, pages)
        said = asked(again.select("task", _prompt("confirm", F.replace("question", F.lit(PLACEHOLDER), F.lit("this product")), "shown").alias("prompt")), service, "answered boolean, page int, quote string")
        said = said.select(F.col("task").alias("item_id"), "said", F.col("error").alias("unsaid"))
        both = items.join(said, "item_id", "left")
        # a check that failed fails its task, which is then done again as a whole
        lost = both.groupBy("task").agg(F.max("unsaid").alias("unsaid"))
        found = F.when(F.col("said.answered").eqNullSafe(F.lit(False)), F.lit(None)).otherwise(F.concat(F.lit("checker found an answer on p."), F.coalesce(F.col("said.page").cast("string"), F.lit("?"))))
        none = F.struct(F.lit("unanswerable").alias("kind"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("array<string>").alias("values"))
        record = _record(F.col("n"), F.lit("unanswerable"), F.array("doc_id"), none, F.array().cast(EVIDENCE), F.array().cast(QUOTES), F.coalesce(_no_product(F.col("regime")), found))
        ended = got.join(lost, "task", "left").withColumn("error", F.coalesce("error", "unsaid"))
        return _gathered(ended, both.select("task", record.alias("record")))

    return work


def cross_tasks(pairs: DataFrame, pages: DataFrame, round_: int = 1, least: int = LEAST_WORDS) -> DataFrame:
    """task, ts_id, sn_id, pages of linked documents (ts_id, sn_id): a product's terms and the note that they complete."""
    own = key_pages(pages, least=least).withColumnRenamed("doc_id", "ts_id")
    key = F.concat_ws(":", F.lit("cross_doc"), "ts_id", "sn_id", F.lit(f"r{round_}" if round_ > 1 else None))
    return pairs.join(own, "ts_id").select(key.alias("task"), "ts_id", "sn_id", "pages")


def cross_work(pages: DataFrame, service: Chat, round_: int = 1) -> Callable[[DataFrame], DataFrame]:
    """Questions that take both documents: the service names provisions that the terms rely on, two a round; the note's pages that match them best are shown beside the terms."""

    def work(tasks: DataFrame) -> DataFrame:
        first = tasks.withColumn("doc_id", F.col("ts_id"))
        prompts = shown_pages(first, pages).withColumn("prompt", _prompt("terms", "shown"))
        got = asked(prompts.select("task", "ts_id", "sn_id", "pages", "prompt"), service, "provisions array<struct<wording: string, keywords: array<string>, page: int>>")
        got = got.withColumn("provisions", D.paged(F.coalesce("said.provisions", F.expr("cast(array() as array<struct<wording: string, keywords: array<string>, page: int>>)")), F.lit(round_))).drop("said")
        open_ = got.filter("error is null and size(provisions) > 0")
        each = open_.select("task", F.col("sn_id").alias("doc_id"), F.posexplode("provisions").alias("i", "p"))
        text = F.concat_ws(" ", "p.wording", F.array_join(F.coalesce("p.keywords", F.array().cast("array<string>")), " "))
        # pages that match nothing stand in their order behind those that match
        wanted = each.select(F.concat_ws("#", "task", "i").alias("item_id"), "doc_id", text.alias("text"), "task")
        notes = _best_pages(wanted, pages, 3).groupBy("task").agg(F.sort_array(F.collect_set("page")).alias("sn_pages"))
        named = F.array_sort(F.array_distinct(F.filter(F.transform("provisions", lambda p: p["page"]), lambda p: F.array_contains(F.col("pages"), p))))
        both = open_.join(notes, "task", "left").withColumns({"ts_pages": F.when(F.size(named) > 0, named).otherwise(F.slice("pages", 1, 3)), "sn_pages": F.coalesce("sn_pages", F.array().cast("array<int>"))})
        both = written(both.select("task", "ts_id", "sn_id", "ts_pages", "sn_pages"), "cross-pages")
        left = shown_pages(both.select("task", F.col("ts_id").alias("doc_id"), F.col("ts_pages").alias("pages")), pages).select("task", F.col("shown").alias("ts"))
        right = shown_pages(both.select("task", F.col("sn_id").alias("doc_id"), F.col("sn_pages").alias("pages")), pages).select("task", F.col("shown").alias("sn"))
        prompts = both.join(left, "task", "left").join(right, "task", "left").withColumn("prompt", _prompt("cross_doc", "ts_id", "ts", "sn_id", "sn"))
        page = "struct<doc_id: string, page: int>"
        item = f"struct<question: string, kind: string, answer: string, evidence: array<{page}>, quotes: array<struct<doc_id: string, page: int, text: string>>>"
        replies = asked(prompts.select("task", "ts_id", "sn_id", "prompt"), service, f"questions array<{item}>")
        items = replies.filter("error is null").select("task", "ts_id", "sn_id", F.posexplode("said.questions").alias("n", "q")).select("*", "q.*").filter(F.trim(F.coalesce("question", F.lit(""))) != "")
        is_own = lambda c: (F.col(f"{c}.doc_id") == F.col("ts_id")) | (F.col(f"{c}.doc_id") == F.col("sn_id"))
        held = items.select("task", "n", "ts_id", "sn_id", F.posexplode("evidence").alias("i", "e")).filter(is_own("e")).select("task", "n", "i", "e.doc_id", "e.page")
        held = D.on_their_pages(held, pages).filter("__there")
        held = held.groupBy("task", "n").agg(F.array_sort(F.collect_list(F.struct("i", "doc_id", "page"))).alias("ev"))
        quotes = items.select("task", "n", "ts_id", "sn_id", F.posexplode("quotes").alias("i", "e")).filter(is_own("e")).select("task", "n", "i", "e.doc_id", "e.page", F.col("e.text").alias("quote"))
        quotes = _quoted(quotes, pages).filter("__there").groupBy("task", "n").agg(F.array_sort(F.collect_list(F.struct("i", "doc_id", "page", F.col("quote").alias("text"), F.col("on_page").alias("ok")))).alias("qu"))
        items = items.join(held, ["task", "n"], "left").join(quotes, ["task", "n"], "left")
        evidence = F.transform(F.coalesce("ev", F.expr(f"cast(array() as array<struct<i: int, doc_id: string, page: int>>)")), lambda e: F.struct(e["doc_id"].alias("doc_id"), e["page"].alias("page")))
        own = F.transform(F.coalesce("qu", F.expr("cast(array() as array<struct<i: int, doc_id: string, page: int, text: string, ok: boolean>>)")), lambda q: F.struct(q["doc_id"].alias("doc_id"), q["page"].alias("page"), q["text"].alias("text"), q["ok"].alias("ok")))
        items = items.withColumns({"ev": evidence, "qu": own})
        covers = lambda d: F.exists("ev", lambda e: e["doc_id"] == F.col(d))
        backed = lambda d: F.exists("qu", lambda q: q["ok"] & (q["doc_id"] == F.col(d)))
        why = F.coalesce(_no_product(F.lit("A")), F.when(~(covers("ts_id") & covers("sn_id")), "evidence does not cover both documents").when(~(backed("ts_id") & backed("sn_id")), "a quote was not found on its page"))
        record = _record(F.col("n"), F.lit("cross_doc"), F.array("ts_id", "sn_id"), normalise_answer(F.col("kind"), F.col("answer")), F.col("ev"), F.col("qu"), why)
        ended = got.select("task", "error").join(replies.select("task", F.col("error").alias("later")), "task", "left").select("task", F.coalesce("error", "later").alias("error"))
        return _gathered(ended, items.select("task", record.alias("record")))

    return work


def _best_pages(wanted: DataFrame, pages: DataFrame, k: int) -> DataFrame:
    """task, page: the k best pages of a document for each item (item_id, doc_id, text, task); pages without a common word come last, in order."""
    scored = D.bm25_within(wanted, pages)
    all_ = wanted.select("item_id", "task", "doc_id").join(pages.select("doc_id", "page"), "doc_id").join(scored, ["item_id", "doc_id", "page"], "left")
    nth = F.row_number().over(Window.partitionBy("item_id").orderBy(F.round(F.coalesce("score", F.lit(0.0)), 9).desc(), "page"))
    return all_.withColumn("nth", nth).filter(F.col("nth") <= k).select("task", "page")


def draft_all(ledger: Ledger, docs: DataFrame, pages: DataFrame, pairs: DataFrame, service: Chat, seed: int = 17, least: int = LEAST_WORDS, window_least: int = 120) -> dict[str, int]:
    """Runs the four stages one after another; how many tasks of each failed. Given again, it does what is left.

    docs (doc_id, regime, label), pages (doc_id, page, text), pairs (ts_id, sn_id); doc_id is a string.
    """
    # every stage meets pages by their document, whose texts are dealt once
    pages = bucketed(pages.select("doc_id", "page", "text"), "pages", "doc_id")
    # the tasks of a window and of the unanswerable stage are cut from the same windows
    windows = written(window_tasks(docs, pages, seed=seed, least=least, window_least=window_least), "windows")
    stages = {
        "facts": (fact_tasks(docs, pages, least), facts_work(pages, service)),
        "window": (windows, window_work(pages, service)),
        "unanswerable": (unanswerable_tasks(windows), unanswerable_work(pages, service)),
        "cross_doc": (cross_tasks(pairs, pages, least=least), cross_work(pages, service)),
    }
    return {name: ledger.run(name, tasks, work) for name, (tasks, work) in stages.items()}


def drafts(ledger: Ledger) -> DataFrame:
    """draft_id, task, stage and the fields of every record that the question stages have made."""
    out = None
    for stage in ("window", "unanswerable", "cross_doc"):
        rows = ledger.rows(stage)
        if rows is not None:
            one = rows.filter("error is null").select("task", F.lit(stage).alias("stage"), F.explode("records").alias("r")).select("task", "stage", "r.*")
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no stage has been run")
    slug = F.concat_ws("-", F.trim(F.regexp_replace(F.lower("task"), "[^a-z0-9]+", "-"), F.lit("-")), "n")
    return out.withColumn("draft_id", slug)
