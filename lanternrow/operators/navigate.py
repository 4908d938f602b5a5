"""Navigation of documents by a chat service: an engine that moves a table of open questions on, a turn at a time.

In each turn every open question's prompt is made of its log by joins, one call to the service gives
an action, and the action's result goes to the end of the log. Replies and states of a turn are
tables of their own in the run's folder: a run that is started again reads finished turns and asks
for none of them twice. Questions leave when they answer, when the service fails, or when they are
out of turns as often as they have attempts. A log is as long as a question has turns, a turn adds
MOST_WORDS a page of at most MOST_PAGES pages, or AT_ONCE lines: a state is bounded whatever the corpus.

What the service can do, as JSON: {"action": "documents", "pages": "101-200"} lists documents of the
scope by their places, {"action": "structure" or "description", "doc_id": ...} shows what an index
knows of a document, {"action": "pages", "doc_id": ..., "pages": "3-5, 8"} reads pages, {"action":
"answer", "answer": ...} ends. Other replies, documents outside the scope and pages that aren't there
cost a turn and say so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import parse_json, render_pages
from ..sources.services import complete
from ..storage import kept
from .arms import nearest_documents
from .retrieval import SMALL_ROWS, small
from .trees import navigation, reads_to_evidence

#: Tries at a question or an index, turns of a try, pages of a read, words of a page, documents of a listing.
ATTEMPTS, TURNS, MOST_PAGES, MOST_WORDS, AT_ONCE = 3, 10, 20, 1500, 100
ACTIONS = ("documents", "structure", "description", "pages", "answer")


def ranges(spec: Column) -> Column:
    """'3-5, 8' as [(3, 5), (8, 8)]; parts that are neither a number nor a range that runs up are left out."""
    number = lambda p, i: F.regexp_extract(p, r"^\s*(\d{1,9})\s*(?:-\s*(\d{1,9})\s*)?$", i)
    both = F.transform(F.split(F.coalesce(spec, F.lit("")), ","), lambda p: F.struct(number(p, 1).alias("a"), number(p, 2).alias("b")))
    whole = F.transform(F.filter(both, lambda r: r["a"] != ""), lambda r: F.struct(r["a"].cast("int").alias("first"), F.when(r["b"] == "", r["a"]).otherwise(r["b"]).cast("int").alias("last")))
    return F.filter(whole, lambda r: r["first"] <= r["last"])


def actions(replies: DataFrame) -> DataFrame:
    """Replies (qid, attempt, turn, text, error, …) with action, doc_id, spec, answer; an action that isn't one is null."""
    said = replies.withColumn("said", parse_json(F.col("text"), "action string, doc_id string, pages string, answer string"))
    known = F.when(F.col("said.action").isin(*ACTIONS), F.col("said.action"))
    return said.select(*replies.columns, known.alias("action"), F.col("said.doc_id").alias("doc_id"), F.col("said.pages").alias("spec"), F.coalesce("said.answer", F.lit("")).alias("answer"))


def page_reads(acts: DataFrame, scope: DataFrame, pages: DataFrame, sent: Callable[[DataFrame], DataFrame] = small) -> DataFrame:
    """qid, attempt, turn, doc_id, at, page, text: the first MOST_PAGES pages that each read names, in its order, of documents in the question's scope.

    Reads are sent to the pages: pages stay where they are, but where reads are too many for a broadcast.
    """
    own = scope.select("qid", F.col("doc_id").cast("string").alias("doc_id"))
    asked = acts.filter("action = 'pages'").select("qid", "attempt", "turn", "doc_id", ranges(F.col("spec")).alias("spans")).join(own, ["qid", "doc_id"])
    text = pages.select(F.col("doc_id").cast("string").alias("doc_id"), "page", "text")
    nth = F.array_min(F.transform("spans", lambda r, i: F.when(F.col("page").between(r["first"], r["last"]), i)))
    rows = text.join(sent(asked), "doc_id").withColumn("nth", nth).filter("nth is not null").groupBy("qid", "attempt", "turn", "doc_id", "page").agg(F.min("nth").alias("nth"), F.first("text").alias("text"))
    at = F.row_number().over(Window.partitionBy("qid", "attempt", "turn").orderBy("nth", "page"))
    return rows.withColumn("at", at).filter(F.col("at") <= MOST_PAGES).drop("nth")


@dataclass
class Navigation:
    """What a run stored: replies of all turns, scope (qid, doc_id, pos) of documents that have an index, and what was missing (qid, missing)."""

    replies: DataFrame
    scope: DataFrame
    missing: DataFrame
    attempts: int


def navigate(questions: DataFrame, scope: DataFrame, index: DataFrame, pages: DataFrame, service: Callable[[str], dict], folder: str, turns: int = TURNS, attempts: int = ATTEMPTS) -> Navigation:
    """Runs questions (qid, question) over scope (qid, doc_id, pos) until all have ended.

    index (doc_id, title, structure, description, error) of documents whose error is null can be
    searched; pages (doc_id, page, text). folder belongs to this run: given again, it goes on.
    """
    spark = questions.sparkSession
    seen = scope.join(index.select("doc_id", "title", "error"), "doc_id")
    missing = seen.filter("error is not null").groupBy("qid").agg(F.sort_array(F.collect_set(F.col("doc_id").cast("string"))).alias("missing"))
    order = Window.partitionBy("qid").orderBy("pos", "doc_id")
    within = kept(seen.filter("error is null").select("qid", F.col("doc_id").cast("string").alias("doc_id"), "title", F.row_number().over(order).alias("place")), f"{folder}/scope")
    known = index.filter("error is null").select(F.col("doc_id").cast("string").alias("doc_id"), "structure", "description")
    counts = within.groupBy("qid").agg(F.count("*").alias("n_docs"))
    listing = _listing(within.withColumns({"low": F.lit(1), "high": F.lit(AT_ONCE)}), ["qid"])
    heads = kept(
        questions.join(counts, "qid").join(listing, "qid").select(
            "qid", F.concat(F.lit("Question: "), F.coalesce("question", F.lit("")), F.lit("\nDocuments in scope: "), F.col("n_docs").cast("string"), F.lit("\n"), F.col("shown")).alias("head")
        ),
        f"{folder}/heads",
    )
    state = kept(heads.select("qid", F.lit(1).alias("attempt"), F.lit(1).alias("turn"), F.array().cast("array<string>").alias("log")), f"{folder}/states/step=0")
    step = 0
    while open_ := state.limit(SMALL_ROWS + 1).count():
        step += 1
        # a question has one action a turn
        sent = F.broadcast if open_ <= SMALL_ROWS else lambda asked: asked
        prompts = state.join(heads, "qid").select("qid", "attempt", "turn", "log", F.concat_ws("\n\n", "head", F.array_join("log", "\n\n"), F.lit("Reply with one action as JSON.")).alias("prompt"))
        # a call is a row of a stored table before anything reads it, so no plan asks again
        replies = kept(complete(prompts, "qid", service=service, keep=("attempt", "turn", "log")), f"{folder}/replies/step={step}")
        state = kept(_next(actions(replies), within, known, pages, turns, attempts, sent), f"{folder}/states/step={step}")
    said = spark.read.parquet(f"{folder}/replies") if step else complete(state.select("qid", "attempt", "turn", "log", F.lit("").alias("prompt")), "qid", keep=("attempt", "turn", "log"))
    return Navigation(actions(said.drop("log", "step")), within, missing, attempts)


def _listing(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, shown: documents of rows (…, place, doc_id, title) whose place lies between low and high, AT_ONCE at most."""
    line = F.concat_ws(" ", F.concat(F.col("place").cast("string"), F.lit(".")), F.concat(F.lit("["), F.col("doc_id"), F.lit("]")), "title")
    some = rows.filter(F.col("place").between(F.col("low"), F.least("high", F.col("low") + AT_ONCE - 1)))
    return some.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("shown"))


def _next(acts: DataFrame, within: DataFrame, known: DataFrame, pages: DataFrame, turns: int, attempts: int, sent: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The states after a turn: qid, attempt, turn, log of the questions that go on. What they ask for is sent to the tables that have it."""
    going = acts.filter("error is null and coalesce(action, '') <> 'answer'")
    read = page_reads(going, within, pages, sent).groupBy("qid").agg(render_pages(F.collect_list(F.struct("page", "text")), MOST_WORDS).alias("read"))
    what = F.when(F.col("action") == "structure", F.col("structure")).otherwise(F.col("description"))
    asked = going.filter("action in ('structure', 'description')").select("qid", "doc_id", "action").join(within.select("qid", "doc_id"), ["qid", "doc_id"])
    shown = known.join(sent(asked), "doc_id").select("qid", F.coalesce(what, F.lit("nothing")).alias("known"))
    wanted = going.filter("action = 'documents'").select("qid", F.get(ranges(F.col("spec")), F.lit(0)).alias("r")).filter("r is not null")
    listed = _listing(within.join(wanted.select("qid", F.col("r.first").alias("low"), F.col("r.last").alias("high")), "qid"), ["qid"])
    head = F.concat(F.lit("> "), F.coalesce("action", F.lit("?")), F.lit(" "), F.coalesce("doc_id", F.lit("")), F.lit(" "), F.coalesce("spec", F.lit("")))
    told = F.coalesce("read", "known", "shown", F.when(F.col("action").isNull(), "not understood").otherwise("not in scope"))
    after = going.join(read, "qid", "left").join(shown, "qid", "left").join(listed, "qid", "left")
    over = F.col("turn") >= turns
    out = after.filter(~over | (F.col("attempt") < attempts))
    # out of turns: the next attempt starts with an empty log
    return out.select("qid", F.when(over, F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"), F.when(over, 1).otherwise(F.col("turn") + 1).alias("turn"), F.when(over, F.array().cast("array<string>")).otherwise(F.array_append("log", F.concat(F.regexp_replace(head, r"\s+$", ""), F.lit("\n"), told))).alias("log"))


def outcomes(run: Navigation, questions: DataFrame) -> DataFrame:
    """qid, failure, native_answer, gave_up (tries that ran out of turns), index_failed, error of every question.

    failure is index_failed where no document of the scope has an index and some failed, max_turns
    where no try came to an end. A question without any document has neither failure nor answer. An
    error is the service's: such a row is to be run again.
    """
    last = run.replies.groupBy("qid").agg(F.max_by(F.struct("attempt", "action", "answer", "error"), F.struct("attempt", "turn")).alias("e"))
    rows = questions.select("qid").join(last, "qid", "left").join(run.missing, "qid", "left")
    ended = F.col("e.action") == "answer"
    out = F.col("e").isNotNull() & F.col("e.error").isNull() & ~F.coalesce(ended, F.lit(False))
    failure = F.when(out, "max_turns").when(F.col("e").isNull() & F.col("missing").isNotNull(), "index_failed")
    gave_up = F.when(out, F.lit(run.attempts)).otherwise(F.coalesce(F.col("e.attempt") - 1, F.lit(0)))
    return rows.select("qid", failure.alias("failure"), F.when(ended, F.col("e.answer")).alias("native_answer"), gave_up.cast("int").alias("gave_up"), F.col("missing").alias("index_failed"), F.col("e.error").alias("error"))


def calls(run: Navigation, model: str = "navigator", local: bool = True) -> DataFrame:
    """A ledger row for each call of every try: qid, seq, model, input_tokens, output_tokens, latency_s, local, parallel_group."""
    seq = F.row_number().over(Window.partitionBy("qid").orderBy("attempt", "turn"))
    return run.replies.select("qid", seq.alias("seq"), F.lit(model).alias("model"), "input_tokens", "output_tokens", "latency_s", F.lit(local).alias("local"), F.lit(None).cast("string").alias("parallel_group"))


def _last_try(run: Navigation) -> DataFrame:
    return run.replies.join(run.replies.groupBy("qid").agg(F.max("attempt").alias("attempt")), ["qid", "attempt"])


def reads(run: Navigation, pages: DataFrame) -> DataFrame:
    """qid, seq, doc_name, pages of the last try's reads that found a page, as reads_to_evidence() and navigation() take them."""
    found = page_reads(_last_try(run), run.scope, pages)
    return found.groupBy("qid", F.col("turn").alias("seq"), F.col("doc_id").alias("doc_name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "page"))), lambda x: x["page"]).alias("pages"))


def shown(run: Navigation) -> DataFrame:
    """qid, seq, what, doc_id: structures and descriptions that the last try was shown."""
    acts = _last_try(run).filter("action in ('structure', 'description')")
    return acts.join(run.scope.select("qid", "doc_id"), ["qid", "doc_id"]).select("qid", F.col("turn").alias("seq"), F.col("action").alias("what"), "doc_id")


def flatten(indexes: DataFrame, key: str = "doc_id", tree: str = "tree", levels: int = 100) -> DataFrame:
    """key, place (its path of positions), title, summary, first, last of each node of nested trees in JSON, of any depth up to `levels`.

    A tree is a list of nodes with title, summary, start_index, end_index, nodes. Texts that aren't
    JSON have no nodes. place sorts nodes as a walk from the top meets them. A recursive query takes a level a round.
    """
    spark = indexes.sparkSession
    # the limit is meant for runaway recursion; here `levels` bounds the rounds
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return spark.sql(
        f"""WITH RECURSIVE walk(key, place, node) MAX RECURSION LEVEL {levels} AS (
              SELECT `{key}`, array(v.pos), v.value FROM {{indexes}}, LATERAL variant_explode(try_parse_json(`{tree}`)) v
              UNION ALL
              SELECT walk.key, array_append(walk.place, v.pos), v.value FROM walk, LATERAL variant_explode(try_variant_get(walk.node, '$.nodes', 'variant')) v)
            SELECT key AS `{key}`, place, try_variant_get(node, '$.title', 'string') AS title, try_variant_get(node, '$.summary', 'string') AS summary,
                   try_variant_get(node, '$.start_index', 'int') AS first, try_variant_get(node, '$.end_index', 'int') AS last FROM walk""",
        indexes=indexes,
    )


def shown_evidence(seen: DataFrame, indexes: DataFrame) -> DataFrame:
    """Summaries in place of pages: qid, rank, doc_id, page, end_page, kind, text of what was shown (qid, seq, what, doc_id).

    Structures first, then descriptions, each document's once, by the first time it was shown; a
    structure gives a row for each node that has a summary. indexes (doc_id, tree, description, n_pages).
    """
    text = indexes.withColumn("doc_id", F.col("doc_id").cast("string"))
    once = seen.groupBy("qid", "what", "doc_id").agg(F.min("seq").alias("seq"))
    asked = text.join(once.filter("what = 'structure'").select("doc_id").distinct(), "doc_id", "left_semi")
    nodes = flatten(asked.select("doc_id", "tree")).filter("coalesce(summary, '') <> ''").select("doc_id", "place", F.col("first").alias("page"), F.col("last").alias("end_page"), F.concat(F.coalesce("title", F.lit("")), F.lit(": "), F.col("summary")).alias("text"))
    whole = text.filter(F.trim(F.coalesce("description", F.lit(""))) != "").select("doc_id", F.array(F.lit(0)).alias("place"), F.lit(1).alias("page"), F.col("n_pages").cast("int").alias("end_page"), F.trim("description").alias("text"))
    rows = once.filter("what = 'structure'").join(nodes, "doc_id").unionByName(once.filter("what = 'description'").join(whole, "doc_id"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("what"), "seq", "doc_id", "place"))
    return rows.select("qid", rank.alias("rank"), "doc_id", "page", "end_page", F.lit("summary").alias("kind"), "text")


def nested(tree: DataFrame, summary: str = "summary", levels: int = 12) -> DataFrame:
    """doc_id, tree: each document's nodes (doc_id, node_id, parent, title, start_page, end_page, pos and summary) as nested JSON, put together from the lowest level up."""
    own = F.struct("title", F.col(summary).alias("summary"), "node_id", F.col("start_page").alias("start_index"), F.col("end_page").alias("end_index"))
    depth = tree.select("doc_id", "node_id", "parent", "pos", F.to_json(own).alias("json"))
    by_depth, at = [], depth.filter("parent is null")
    while not at.isEmpty():
        if len(by_depth) == levels:
            raise ValueError(f"a tree is deeper than {levels} levels")
        by_depth.append(at)
        at = depth.join(at.select("doc_id", F.col("node_id").alias("parent")), ["doc_id", "parent"])
    below = None
    joined = lambda rows, by: rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "json"))), lambda x: x["json"]), ",").alias("nodes"))
    for at in reversed(by_depth):
        if below is not None:
            inner = joined(below, ["doc_id", "parent"]).withColumnRenamed("parent", "node_id")
            whole = F.when(F.col("nodes").isNotNull(), F.concat(F.expr("left(json, length(json) - 1)"), F.lit(',"nodes":['), F.col("nodes"), F.lit("]}"))).otherwise(F.col("json"))
            at = at.join(inner, ["doc_id", "node_id"], "left").select("doc_id", "node_id", "parent", "pos", whole.alias("json"))
        below = at
    roots = joined(below if below is not None else depth, ["doc_id"])
    return roots.select("doc_id", F.concat(F.lit("["), F.col("nodes"), F.lit("]")).alias("tree"))


INDEX = "tree string, description string, input_tokens long, output_tokens long"


def build_indexes(docs: DataFrame, known: DataFrame, settings: str, build: Callable[[str, str], dict], attempts: int = ATTEMPTS) -> tuple[DataFrame, DataFrame]:
    """(index, new) of docs (doc_id, sha256, content): every document's index row, and the rows to add to the known ones.

    A known row (doc_id, sha256, settings, attempts, error, tree, description, input_tokens,
    output_tokens) is used again where its sha256 and settings are the same and it didn't fail. Other
    documents are built, with `attempts` tries each; one that never builds is a row with its last
    error, and the others are built all the same. A known index's tokens count as if it were built
    now; those of failed tries don't. Write `new` before using it twice: a plan that is run again builds again.
    """
    import pandas as pd

    good = known.filter((F.col("settings") == settings) & F.col("error").isNull()).dropDuplicates(["doc_id", "sha256"])
    todo = docs.join(good.select("doc_id", "sha256"), ["doc_id", "sha256"], "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, sha, content in zip(pdf["doc_id"], pdf["sha256"], pdf["content"], strict=True):
                row = {"doc_id": doc_id, "sha256": sha, "settings": settings, "attempts": 0, "error": None, "tree": None, "description": None, "input_tokens": 0, "output_tokens": 0}
                for n in range(attempts):
                    row["attempts"] = n + 1
                    try:
                        row |= build(content or "", settings) | {"error": None}
                        break
                    except Exception as e:  # noqa: BLE001  a builder's failures are results
                        row["error"] = f"{type(e).__name__}: {e}"
                out.append(row)
            yield pd.DataFrame(out, columns=["doc_id", "sha256", "settings", "attempts", "error", "tree", "description", "input_tokens", "output_tokens"])

    kinds = dict(docs.dtypes)
    new = todo.select("doc_id", "sha256", "content").mapInPandas(run, f"doc_id {kinds['doc_id']}, sha256 string, settings string, attempts int, error string, {INDEX}")
    return good.join(docs.select("doc_id", "sha256"), ["doc_id", "sha256"], "left_semi").select(*new.columns).unionByName(new), new


def index_stats(index: DataFrame) -> DataFrame:
    """One row: n_built, n_failed, input_tokens, output_tokens of an index."""
    return index.agg(F.count_if(F.col("error").isNull()).alias("n_built"), F.count_if(F.col("error").isNotNull()).alias("n_failed"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))


@dataclass
class Retrieved:
    """Evidence (qid, rank, doc_id, page, end_page, kind, text), what became of each question, its calls, and its trace (qid, visited, selected, backtracks)."""

    evidence: DataFrame
    outcomes: DataFrame
    calls: DataFrame
    trace: DataFrame


def in_scope(scope: DataFrame, folder: str, **tables: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """scope and what tables (doc_id, …) hold of the documents in any question's scope, stored: turns read these alone, whatever the corpus."""
    scope = kept(scope, f"{folder}/scope-given")
    docs = small(kept(scope.select(F.col("doc_id").cast("string").alias("__d")).distinct(), f"{folder}/scope-documents"))
    return scope, [kept(t.join(docs, F.col("doc_id").cast("string") == F.col("__d"), "left_semi"), f"{folder}/scope-{name}") for name, t in tables.items()]


def pageindex(questions: DataFrame, scope: DataFrame, index: DataFrame, pages: DataFrame, tree: DataFrame, service: Callable[[str], dict], folder: str, turns: int = TURNS, attempts: int = ATTEMPTS) -> Retrieved:
    """The navigation method: pages that were read are evidence; where none was, what was shown is, as summaries, which never count as pages.

    index (doc_id, title, tree, structure, description, n_pages, error); tree (doc_id, node_id, …) maps reads onto nodes.
    """
    scope, (index, pages, tree) = in_scope(scope, folder, index=index, pages=pages, tree=tree)
    run = navigate(questions, scope, index, pages, service, folder, turns, attempts)
    ended = outcomes(run, questions)
    read = kept(reads(run, pages), f"{folder}/reads")
    own = pages.withColumn("doc_id", F.col("doc_id").cast("string"))
    by_page = reads_to_evidence(read, own).join(own.select("doc_id", "page", "text"), ["doc_id", "page"]).select("qid", "rank", "doc_id", "page", F.lit(None).cast("int").alias("end_page"), F.lit("page").alias("kind"), "text")
    no_page = shown(run).join(read.select("qid").distinct(), "qid", "left_anti")
    scored = ended.filter("failure is null and error is null").select("qid")
    evidence = by_page.unionByName(shown_evidence(no_page, index)).join(scored, "qid", "left_semi")
    trace = navigation(read.join(scored, "qid", "left_semi"), tree.withColumn("doc_id", F.col("doc_id").cast("string")))
    return Retrieved(evidence, ended, calls(run), trace)


def vec_tree(questions: DataFrame, cards: DataFrame, scope: DataFrame | None, *rest, k: int = 3, groups: tuple[DataFrame, DataFrame] | None = None, **options) -> Retrieved:
    """pageindex() within the k documents of a question's scope whose cards (doc_id, embedding) are nearest to it; questions (qid, question, embedding). groups, as in nearest_documents(), instead of a scope.

    The navigator's own answer isn't graded here: it goes by the name of sdk_answer.
    """
    best = nearest_documents(questions, cards, scope, k, groups).select("qid", "doc_id", F.col("rank").alias("pos"))
    found = pageindex(questions, best, *rest, **options)
    return Retrieved(found.evidence, found.outcomes.withColumnRenamed("native_answer", "sdk_answer"), found.calls, found.trace)
