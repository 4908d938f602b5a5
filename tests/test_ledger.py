"""Tasks are done once: killed, resumed and doubled attempts, failures, and the drafting stages on top."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from lanternrow.operators import stages
from lanternrow.operators.ledger import Ledger


def work(prefix, bad=(), dead=False):
    def run(todo):
        if dead:
            return todo.select("task", F.raise_error(F.lit("killed")).cast("string").alias("error"), F.lit("x").alias("said"))
        return todo.select("task", F.when(F.col("task").isin(*bad), "failed").alias("error"), F.concat(F.lit(prefix), "task").alias("said"))

    return run


def said(ledger, stage="s"):
    return {r.task: (r.said, r.error) for r in ledger.rows(stage).collect()}


def test_tasks_are_done_once(spark, tmp_path):
    tasks = spark.createDataFrame([(f"t{i}",) for i in range(6)], "task string")
    ledger = Ledger(spark, f"file://{tmp_path}/l")
    assert ledger.rows("s") is None
    with pytest.raises(Exception, match="killed"):
        ledger.run("s", tasks, work("dead", dead=True))
    # what a killed run wrote isn't read
    assert ledger.rows("s") is None and ledger.attempts("s") == []
    assert ledger.run("s", tasks.limit(0), work("none")) == 0
    assert ledger.run("s", tasks.filter("task < 't3'"), work("a", bad=("t1",))) == 1
    assert said(ledger) == {"t0": ("at0", None), "t1": ("at1", "failed"), "t2": ("at2", None)}
    assert sorted(r.task for r in ledger.todo("s", tasks).collect()) == ["t1", "t3", "t4", "t5"]
    assert ledger.run("s", tasks, work("b", bad=("t4",))) == 1
    assert said(ledger) == {"t0": ("at0", None), "t1": ("bt1", None), "t2": ("at2", None), "t3": ("bt3", None), "t4": ("bt4", "failed"), "t5": ("bt5", None)}
    assert ledger.run("s", tasks, work("c")) == 0 and ledger.run("s", tasks, work("d")) == 0
    assert said(ledger)["t4"] == ("ct4", None) and len(ledger.attempts("s")) == 3
    # another ledger on the folder sees the same
    assert said(Ledger(spark, f"file://{tmp_path}/l/")) == said(ledger)


def test_doubled_attempts_leave_one_result(spark, tmp_path):
    tasks = spark.createDataFrame([(f"t{i}",) for i in range(5)], "task string")
    ledger = Ledger(spark, f"file://{tmp_path}/l")
    names = [ledger.stage("s", tasks, work(p, bad=("t0",) if p == "a" else ())) for p in "abcd"]
    got, numbers = [], []

    def publish(name):
        numbers.append(ledger.publish("s", name))

    for n in names[:2]:
        publish(n)
    threads = [threading.Thread(target=publish, args=(n,)) for n in names[2:]]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(numbers) == [1, 2, 3, 4]
    # published again: the same entry
    assert ledger.publish("s", names[1]) == 2 and len(ledger.attempts("s")) == 4
    got = said(ledger)
    assert got == {f"t{i}": (f"{'b' if i == 0 else 'a'}t{i}", None) for i in range(5)}
    assert ledger.rows("s").count() == 5


def chat(script):
    def service(prompt):
        kind = prompt.split("\n", 1)[0].removeprefix("Task: ")
        reply = script(kind, prompt)
        if isinstance(reply, Exception):
            raise reply
        return {"text": reply if isinstance(reply, str) else json.dumps(reply), "input_tokens": 1, "output_tokens": 1, "finish_reason": "length" if reply == "cut" else "stop"}

    return service


def corpus(spark):
    text = lambda d, p: f"{d} page {p} has these words of its own " + " ".join(f"w{i}" for i in range(45))
    pages = [(d, p, text(d, p)) for d in ("a", "b", "c") for p in range(1, 9)] + [("a", 9, ""), ("empty", 1, "few words")]
    docs = [("a", "A", "note a"), ("b", "B", "note b"), ("c", "A", "note c"), ("empty", "A", "e")]
    return spark.createDataFrame(docs, "doc_id string, regime string, label string"), spark.createDataFrame(pages, "doc_id string, page int, text string")


def test_windows_and_unanswerable(spark, tmp_path):
    docs, pages = corpus(spark)
    windows = stages.window_tasks(docs, pages, 3, least=40, window_least=40)
    keys = sorted(r.task for r in windows.collect())
    assert keys[0] == "window:a:0" and keys[-1] == "window:c:0" and len(keys) >= 3 and all(k.startswith("window:b:") for k in keys[1:-1])
    tasks = sorted(r.task for r in stages.unanswerable_tasks(windows, 2).collect())
    # every other window of the other documents, numbered from 0; later rounds have keys of their own
    assert tasks == ["unanswerable:a:0:r2", *(f"unanswerable:b:{i}:r2" for i in range((len(keys) - 1) // 2)), "unanswerable:c:0:r2"]

    def script(kind, prompt):
        if kind == "confirm":
            return {"answered": False} if "this product" in prompt else {"answered": True, "page": 4}
        if "note c" in prompt:
            return "no object here"
        item = {"question": " What is {product}? ", "kind": "numeric", "answer": "5 %", "qtype": "lookup", "evidence": [2, 1, 2], "quote": "a page 2 has these words"}
        if kind == "window":
            return {"questions": [item, item | {"evidence": []}, item | {"quote": "nowhere on any page at all"}, item | {"question": ""}, item | {"qtype": "other"}]}
        return {"questions": [{"question": "Is {product}?", "keywords": ["w1"]}, {"question": "Is it?", "keywords": None}, {"question": " "}]}

    got = {r.task: r for r in stages.window_work(pages, chat(script))(windows.filter("regime = 'A'")).collect()}
    assert got["window:c:0"].error == "no JSON object in the reply" and got["window:c:0"].records is None
    records = got["window:a:0"].records
    assert [(r.n, r.status, r.reason) for r in records] == [(0, "draft", None), (1, "auto_rejected", "no evidence"), (2, "auto_rejected", "quote not on page")]
    good = records[0]
    # nearly the words of page 1, which comes first
    assert good.question == "What is {product}?" and [tuple(e) for e in good.evidence] == [("a", 1), ("a", 2)] and [tuple(q) for q in good.quotes] == [("a", 1, "a page 2 has these words", True)] and good.answer.kind == "numeric"
    un = {r.task: r for r in stages.unanswerable_work(pages, chat(script))(stages.unanswerable_tasks(windows)).collect()}
    assert [(r.n, r.status, r.reason) for r in un["unanswerable:a:0"].records] == [(0, "draft", None), (1, "auto_rejected", "question does not use the {product} placeholder")]
    assert [(r.n, r.reason) for r in un["unanswerable:b:0"].records] == [(0, None), (1, "checker found an answer on p.4")]
    assert un["unanswerable:c:0"].error


def test_a_chain_of_stages_goes_on_where_it_stopped(spark, tmp_path):
    docs, pages = corpus(spark)
    pairs = spark.createDataFrame([("a", "b"), ("c", "b")], "ts_id string, sn_id string")
    state = {"broken": True}

    def script(kind, prompt):
        if state["broken"] and kind in ("confirm", "terms"):
            return "cut"
        if kind == "facts":
            return {"facts": {"coupon_rate": {"value": "5", "page": 1, "quote": "page 1 has these words"}, "barrier": {"value": None, "page": 1, "quote": "page 1 has these words"}}}
        if kind == "terms":
            return {"provisions": [] if "c page" in prompt else [{"wording": "page 3", "keywords": ["own"], "page": 2}]}
        if kind == "confirm":
            return {"answered": False}
        if kind == "cross_doc":
            e = [{"doc_id": "a", "page": 2}, {"doc_id": "b", "page": 3}, {"doc_id": "b", "page": 99}, {"doc_id": "z", "page": 1}]
            q = [{"doc_id": "a", "page": 2, "text": "a page 2 has these"}, {"doc_id": "b", "page": 3, "text": "b page 3 has these"}]
            return {"questions": [{"question": "{product}?", "kind": "free", "answer": "x", "evidence": e, "quotes": q}, {"question": "{product}!", "evidence": e[:1], "quotes": q}, {"question": "{product}.", "evidence": e, "quotes": q[:1]}, {"question": "none", "evidence": e, "quotes": q}]}
        return {"questions": [{"question": "{product}?", "qtype": "lookup", "evidence": [1], "quote": "page 1 has these words", "keywords": []}]}

    ledger = Ledger(spark, f"file://{tmp_path}/l")
    service = lambda prompt: chat(script)(prompt)
    run = lambda: stages.draft_all(ledger, docs.filter("regime = 'A'"), pages, pairs, service)
    assert run() == {"facts": 0, "window": 0, "unanswerable": 2, "cross_doc": 2}
    facts = {r.task: [(f.field, f.quote_ok) for f in r.records] for r in ledger.rows("facts").collect()}
    assert facts == {t: [("barrier", False), ("coupon_rate", True)] for t in ("facts:a", "facts:c")}
    first = {r.task: r.attempt for r in ledger.rows("window").collect()}
    state["broken"] = False
    assert run() == {"facts": 0, "window": 0, "unanswerable": 0, "cross_doc": 0}
    assert run() == {"facts": 0, "window": 0, "unanswerable": 0, "cross_doc": 0}
    assert {r.task: r.attempt for r in ledger.rows("window").collect()} == first and len(ledger.attempts("window")) == 1
    all_ = stages.drafts(ledger).collect()
    cross = {r.n: r for r in all_ if r.stage == "cross_doc"}
    assert [cross[i].reason for i in range(4)] == [None, "evidence does not cover both documents", "a quote was not found on its page", "question does not use the {product} placeholder"]
    assert [tuple(e) for e in cross[0].evidence] == [("a", 2), ("b", 3)] and cross[0].doc_ids == ["a", "b"] and cross[0].draft_id == "cross-doc-a-b-0"
    assert len(all_) == len({r.draft_id for r in all_}) == 2 + 2 + 4


def test_doc_label(spark):
    rows = spark.sql("SELECT * FROM VALUES ('Bank', 'securities_note', DATE'2027-06-05'), ('Bank', 'base', CAST(NULL AS DATE)) AS t(i, k, d)")
    assert [r[0] for r in rows.select(stages.doc_label(F.col("i"), F.col("k"), F.col("d"))).collect()] == ["the Bank securities note dated 5 June 2027", "the Bank base"]
