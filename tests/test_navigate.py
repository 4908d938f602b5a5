"""The navigation engine: turns, resumption, failures, summaries, and whole runs with the arm's own answer."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lanternrow.operators import evaluation, navigate
from lanternrow.sources.services import Refused
from lanternrow.storage import written

PAGES = [("d1", p, f"one {p}") for p in range(1, 41)] + [("d2", 1, "two 1"), ("d2", 2, None), ("d3", 1, "three")]


def tables(spark):
    questions = spark.createDataFrame([("q1", "first?"), ("q2", "second?"), ("q3", "failed index?"), ("q4", "no documents?")], "qid string, question string")
    scope = spark.createDataFrame([("q1", "d1", 0), ("q1", "d2", 1), ("q1", "d3", 2), ("q2", "d2", 0), ("q3", "d3", 0)], "qid string, doc_id string, pos int")
    tree = '[{"title": "A", "summary": "", "start_index": 1, "end_index": 40, "nodes": [{"title": "B", "summary": "of b", "start_index": 2, "end_index": 3}]}]'
    rows = [("d1", "D1", tree, "[n0] 1-40 A", "", 40, None), ("d2", "D2", None, None, " about two ", 2, None), ("d3", "D3", None, None, None, 1, "boom")]
    index = spark.createDataFrame(rows, "doc_id string, title string, tree string, structure string, description string, n_pages int, error string")
    nodes = spark.createDataFrame([("d1", "n0", None, "A", 1, 40, 1, 0), ("d1", "n1", "n0", "B", 2, 3, 2, 1)], "doc_id string, node_id string, parent string, title string, start_page int, end_page int, level int, pos int")
    return questions, scope, index, spark.createDataFrame(PAGES, "doc_id string, page int, text string"), nodes


def scripted(script, log=None, stop_after=None):
    """A service that says the nth line of its question's script in the nth turn; log gets a line a call."""

    def service(prompt):
        q = prompt.split("\n")[0].removeprefix("Question: ")
        n = prompt.count("\n\n> ")
        if log:
            with open(log, "a") as f:
                f.write(f"{q}|{n}\n")
            if stop_after and len(open(log).readlines()) > stop_after:
                raise Refused("killed")
        text = script[q][min(n, len(script[q]) - 1)]
        if isinstance(text, Exception):
            raise text
        return {"text": text if isinstance(text, str) else json.dumps(text), "input_tokens": 3, "output_tokens": 1, "finish_reason": "stop"}

    return service


def act(action, doc_id=None, pages=None, answer=None):
    return {"action": action, "doc_id": doc_id, "pages": pages, "answer": answer}


READER = {
    "first?": [act("structure", "d1"), "no JSON", act("pages", "d3", "1"), act("pages", "d1", "39-90, 2, x, 9-8, 2"), act("pages", "d2", "1-2"), act("pages", "d1", "3"), act("answer", answer="so")],
    "second?": [act("structure", "d1"), act("description", "d2"), act("structure", "d2"), act("answer", answer="")],
}


def folder(tmp_path, name="run"):
    return f"file://{tmp_path}/{name}"


def test_ranges(spark):
    df = spark.createDataFrame([("3-5, 8,x, 9-7,0",), ("",), (None,), ("1-999999999",), ("99999999999",)], "s string")
    got = [[tuple(r) for r in x.r] for x in df.select(navigate.ranges(F.col("s")).alias("r")).collect()]
    assert got == [[(3, 5), (8, 8), (0, 0)], [], [], [(1, 999999999)], []]


def test_reads_trace_and_summaries(spark, tmp_path):
    questions, scope, index, pages, tree = tables(spark)
    got = navigate.pageindex(questions, scope, index, pages, tree, scripted(READER), folder(tmp_path), turns=9, attempts=2)
    ends = {r.qid: r for r in got.outcomes.collect()}
    assert {q: (r.failure, r.native_answer, r.gave_up, r.index_failed) for q, r in ends.items()} == {
        "q1": (None, "so", 0, ["d3"]), "q2": (None, "", 0, None), "q3": ("index_failed", None, 0, ["d3"]), "q4": (None, None, 0, None),
    }
    rows = sorted((r.qid, r["rank"], r.doc_id, r.page, r.end_page, r.kind, r.text) for r in got.evidence.collect())
    # d3 has no index, so its page isn't read; the pages that are there come in the order of the request
    assert rows == [("q1", 1, "d1", 39, None, "page", "one 39"), ("q1", 2, "d1", 40, None, "page", "one 40"), ("q1", 3, "d1", 2, None, "page", "one 2"), ("q1", 4, "d2", 1, None, "page", "two 1"), ("q1", 5, "d2", 2, None, "page", None), ("q1", 6, "d1", 3, None, "page", "one 3"), ("q2", 1, "d2", 1, 2, "summary", "about two")]
    trace = {r.qid: r for r in got.trace.collect()}
    assert (trace["q1"].visited, trace["q1"].selected, trace["q1"].backtracks) == (["n0", "n1"], "n1", [])
    assert {r.qid: r.n for r in got.calls.groupBy("qid").agg(F.count("*").alias("n")).collect()} == {"q1": 7, "q2": 4}
    # the prompt of the last turn holds what each turn gave
    log = spark.read.parquet(f"{folder(tmp_path)}/states/step=6").first().log
    assert log[0].endswith("[n0] 1-40 A") and log[1].endswith("not understood") and log[2].endswith("not in scope") and "[page 39]\none 39" in log[3]


def test_structures_come_before_descriptions_once_each(spark):
    _, _, index, _, _ = tables(spark)
    seen = spark.createDataFrame([("q", 1, "description", "d2"), ("q", 2, "structure", "d1"), ("q", 3, "structure", "d1"), ("q", 4, "description", "d1"), ("q", 5, "structure", "d9")], "qid string, seq int, what string, doc_id string")
    got = navigate.shown_evidence(seen, index).orderBy("rank").collect()
    assert [(r["rank"], r.doc_id, r.page, r.end_page, r.text) for r in got] == [(1, "d1", 2, 3, "B: of b"), (2, "d2", 1, 2, "about two")]


def test_out_of_turns_and_service_errors(spark, tmp_path):
    questions, scope, index, pages, tree = tables(spark)
    script = {"first?": [act("pages", "d1", "1")], "second?": [RuntimeError("down")]}

    def service(prompt):
        return scripted(script)(prompt)

    import lanternrow.operators.navigate as module

    old, module.complete = module.complete, lambda *a, **k: navigate_complete(*a, **k | {"wait": 0.0})
    navigate_complete = old
    try:
        got = navigate.pageindex(questions, scope, index, pages, tree, service, folder(tmp_path), turns=3, attempts=2)
    finally:
        module.complete = old
    ends = {r.qid: r for r in got.outcomes.collect()}
    assert (ends["q1"].failure, ends["q1"].gave_up, ends["q1"].native_answer) == ("max_turns", 2, None)
    assert ends["q2"].failure is None and "down" in ends["q2"].error
    assert got.evidence.count() == 0
    # every try's calls are in the ledger
    assert got.calls.filter("qid = 'q1'").count() == 6


def test_a_killed_run_goes_on_without_asking_again(spark, tmp_path):
    questions, scope, index, pages, tree = tables(spark)
    log = str(tmp_path / "calls")
    with pytest.raises(Exception, match="killed"):
        navigate.navigate(questions, scope, index, pages, scripted(READER, log, stop_after=4), folder(tmp_path), 9, 2)
    before = len(open(log).readlines())
    assert before >= 4 and not os.path.exists(f"{tmp_path}/run/states/step=9")
    done = navigate.navigate(questions, scope, index, pages, scripted(READER, log), folder(tmp_path), 9, 2)
    assert done.replies.count() == 11
    after = [x.strip() for x in open(log).readlines()]
    # turns that were stored before weren't asked again; the one that was cut off was
    assert set(after[before:]) <= {f"first?|{n}" for n in range(2, 7)} | {f"second?|{n}" for n in range(2, 4)}
    again = len(open(log).readlines())
    assert navigate.navigate(questions, scope, index, pages, scripted(READER, log), folder(tmp_path), 9, 2).replies.count() == 11
    assert len(open(log).readlines()) == again


def test_documents_are_listed_by_place(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(navigate, "AT_ONCE", 2)
    questions, _, _, pages, _ = tables(spark)
    names = [f"e{i:02}" for i in range(7)]
    scope = spark.createDataFrame([("q1", n, i) for i, n in enumerate(names)], "qid string, doc_id string, pos int")
    index = spark.createDataFrame([(n, n.upper(), None, None, None) for n in names], "doc_id string, title string, structure string, description string, error string")
    navigate.navigate(questions, scope, index, pages, scripted({"first?": [act("documents", pages="4-9"), act("documents", pages="x"), act("answer", answer="")]}), folder(tmp_path), 5, 1)
    log = spark.read.parquet(f"{folder(tmp_path)}/states/step=2").first().log
    assert log[0] == "> documents  4-9\n4. [e03] E03\n5. [e04] E04" and log[1].endswith("not in scope")
    head = spark.read.parquet(f"{folder(tmp_path)}/heads").first().head
    assert head == "Question: first?\nDocuments in scope: 7\n1. [e00] E00\n2. [e01] E01"


def test_nested_trees_and_back(spark):
    rows = [("d", "n0", None, "a \"q\"", 1, 9, 1, 0), ("d", "n1", "n0", "b", 1, 4, 2, 1), ("d", "n2", "n1", "c}", 2, 2, 3, 2), ("d", "n3", "n0", "d", 5, 9, 2, 3), ("d", "n4", None, None, 9, 9, 1, 4), ("e", "n0", None, "x", 1, 1, 0, 0)]
    tree = spark.createDataFrame(rows, "doc_id string, node_id string, parent string, title string, start_page int, end_page int, level int, pos int").withColumn("summary", F.when(F.col("pos") != 3, F.concat(F.lit("s"), "pos")))
    made = navigate.nested(tree)
    d = json.loads({r.doc_id: r.tree for r in made.collect()}["d"])
    assert [n.get("title") for n in d] == ['a "q"', None] and [n["title"] for n in d[0]["nodes"]] == ["b", "d"] and d[0]["nodes"][0]["nodes"][0]["title"] == "c}"
    flat = sorted(navigate.flatten(made).collect(), key=lambda r: (r.doc_id, r.place))
    assert [(r.doc_id, r.title, r.summary, r["first"], r["last"]) for r in flat] == [(r[0], r[3], None if r[7] == 3 else f"s{r[7]}", r[4], r[5]) for r in rows]
    odd = spark.createDataFrame([("a", None), ("b", "not json"), ("c", "[]"), ("d", "{}"), ("e", '[{"nodes": ' * 40 + "[{}]" + "}]" * 40)], "doc_id string, tree string")
    assert {r.doc_id: r["count"] for r in navigate.flatten(odd).groupBy("doc_id").count().collect()} == {"e": 41}
    with pytest.raises(ValueError):
        navigate.nested(tree, levels=2)


def test_indexes_are_built_once(spark, tmp_path):
    log = str(tmp_path / "builds")

    def build(content, settings):
        with open(log, "a") as f:
            f.write(content + "\n")
        if content == "never" or (content == "third time" and open(log).read().count("third time") < 3):
            raise OSError(content)
        return {"tree": "[]", "description": content, "input_tokens": 5, "output_tokens": 2}

    docs = spark.createDataFrame([("a", "1", "third time"), ("b", "2", "never"), ("c", "3", "known"), ("d", "4", None)], "doc_id string, sha256 string, content string")
    known = spark.createDataFrame([("c", "3", "s", 1, None, "[]", "", 9, 9), ("d", "4", "other", 1, None, "[]", "", 9, 9), ("b", "2", "s", 3, "failed", None, None, 0, 0)], "doc_id string, sha256 string, settings string, attempts int, error string, tree string, description string, input_tokens long, output_tokens long")
    index = written(navigate.build_indexes(docs.coalesce(1), known, "s", build)[0], "index")
    got = {r.doc_id: (r.attempts, r.error, r.input_tokens) for r in index.collect()}
    assert got == {"a": (3, None, 5), "b": (3, "OSError: never", 0), "c": (1, None, 9), "d": (1, None, 5)}
    assert tuple(navigate.index_stats(index).first()) == (3, 1, 19, 13)
    assert "known" not in open(log).read()


def test_a_whole_run(spark, tmp_path):
    """Right and wrong answers, the arm's own, not applicable, failed and lost ones, each service asked once."""
    log = str(tmp_path / "asked")

    def count(name):
        with open(log, "a") as f:
            f.write(name + "\n")

    def reader(prompt):
        count("answer")
        return {"text": "ANSWER: 5", "input_tokens": 10, "output_tokens": 1, "finish_reason": "length" if "cut" in prompt else "stop"}

    def grader(prompt):
        count("judge")
        return {"text": "CORRECT" if "Candidate: yes" in prompt else "INCORRECT", "input_tokens": 1, "output_tokens": 1, "finish_reason": "stop"}

    kind = "qid string, question string, doc_ids array<string>, evidence array<struct<doc_id: string, page: int>>, gold struct<kind: string, value: string, values: array<string>>"
    gold = {"right": ("numeric", "5"), "wrong": ("numeric", "6"), "free": ("free", "x"), "off": ("numeric", "5"), "stuck": ("numeric", "5"), "lost": ("numeric", "5"), "cut": ("numeric", "5"), "none": ("unanswerable", None)}
    questions = spark.createDataFrame([(q, q, ["d"], [("d", 1)] if q != "none" else [], (*g, None)) for q, g in gold.items()], kind)
    pages = spark.createDataFrame([("d", 1, "text"), ("d", 2, "more")], "doc_id string, page int, text string")
    evidence = spark.createDataFrame([(q, 1, "d", 1 if q == "right" else 2, "page", "text") for q in gold if q not in ("stuck", "off")], "qid string, rank int, doc_id string, page int, kind string, text string")
    outcomes = spark.createDataFrame([("right", None, None, "yes", None), ("wrong", None, None, "no", None), ("none", None, None, "no", None), ("off", True, None, None, None), ("stuck", None, "max_turns", None, None), ("lost", None, None, None, "down")], "qid string, not_applicable boolean, failure string, native_answer string, error string")
    calls = spark.createDataFrame([(q, i, "nav", 100, 10, 2.0, True, None) for q in gold for i in range(2)], "qid string, seq int, model string, input_tokens long, output_tokens long, latency_s double, local boolean, parallel_group string")
    index = spark.createDataFrame([(70, 9, 8.0, None)], "input_tokens long, output_tokens long, gpu_s double, cost_usd double")
    prices = spark.createDataFrame([("reader", 1.0, 2.0)], "model string, input_per_m double, output_per_m double")
    where = folder(tmp_path)
    run = lambda: {(r.qid, r.arm): r for r in evaluation.run_rows(questions, evidence, outcomes, calls, pages, index, prices, where, reader, grader, "tree", "nav", "reader", 8, local=False).collect()}
    got = run()
    assert set(got) == {(q, "tree") for q in gold} | {(q, "tree_native") for q in ("right", "wrong", "none", "stuck")}
    main = {q: got[q, "tree"] for q in gold}
    assert [(main[q].correct, main[q].judge, main[q].failure) for q in gold] == [
        (True, "numeric", None), (False, "numeric", "wrong_page"), (False, "llm", "wrong_page"), (None, None, "not_applicable"), (False, None, "max_turns"), (None, None, "error"), (None, None, "error"), (False, "refusal", "answered_unanswerable"),
    ]
    r = main["right"]
    assert (r.llm_calls_sequential, r.tokens_query, r.tokens_index_amortised, r.evidence_recall) == (3, 231, 9, 1.0)
    assert abs(r.cost_usd - 12e-6) < 1e-12 and abs(r.gpu_s - 5.0) < 1e-9
    own = got["right", "tree_native"]
    assert (own.correct, own.judge, own.answerer, own.llm_calls_sequential, own.tokens_query, own.cost_usd) == (True, "llm", "nav", 2, 220, None)
    assert got["none", "tree_native"].failure == "answered_unanswerable" and got["wrong", "tree_native"].failure == "wrong_page"
    assert all(main[q].latency_s is None and main[q].cost_usd is None for q in ("off", "stuck", "lost", "cut"))
    assert main["off"].evidence_recall is None and main["stuck"].evidence_recall == 0.0
    asked = open(log).readlines()
    assert len(asked) == 5 + 4
    run()
    assert len(open(log).readlines()) == len(asked)
