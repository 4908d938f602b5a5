"""Golden rows and edge cases of single operators."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from lanternrow.functions import hashing, text, values
from lanternrow.operators import arms, registry, drafting, metrics, questions, retrieval, runs, trees
from lanternrow.plans.registry import QUERIES as PLANS
from lanternrow.sources import files, services


def one(spark, column, **given):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in given.items())) if given else spark.range(1)
    return row.select(column).first()[0]


@pytest.mark.parametrize("answer,gold,ok", [("60%", "0.6", True), ("12,5", "12.5", True), ("1.000.000", "1000000", True), ("1,000", "1000", True), ("10.875%", "0.10875", True), ("10.875%", "10875", False), ("0.0137", "0.01", True), ("0.02", "0.01", False), ("none", "1", False), ("CHF 1'234.50", "1234.5", True)])
def test_numbers(spark, answer, gold, ok):
    assert one(spark, values.numbers_match(F.col("a"), F.col("g")), a=answer, g=gold) is ok


@pytest.mark.parametrize("given,days", [("2026-06-15 and 11. Februar 2028", [date(2026, 6, 15), date(2028, 2, 11)]), ("5-Dec-2020, 1/2/2021", [date(2020, 12, 5), date(2021, 2, 1)]), ("31.02.2028", []), ("3. März 2027", [date(2027, 3, 3)]), ("", [])])
def test_dates(spark, given, days):
    assert one(spark, values.dates(F.col("a")), a=given) == days


def test_final_and_refusal(spark):
    assert one(spark, text.extract_final(F.col("a")), a="x\nANSWER: a\nANSWER:  b \nc") == "b"
    assert one(spark, text.extract_final(F.col("a")), a="x\n\n y \n\n") == "y"
    assert one(spark, text.is_refusal(F.col("a")), a="It is NOT specified.") is True


def test_split_and_isin(spark):
    assert abs(one(spark, hashing.split_fraction(7, F.lit("k"))) - int(__import__("hashlib").sha256(b"7:k").hexdigest()[:16], 16) / 2**64) < 1e-15
    assert one(spark, hashing.shard_of(F.lit("q1"), 5)) == int(__import__("hashlib").sha256(b"q1").hexdigest(), 16) % 5
    assert one(spark, hashing.isin_from_valor(F.lit(3886335))) == "CH0038863350"


def test_chunks(spark):
    pages = spark.createDataFrame([("d", 1, " ".join(map(str, range(10)))), ("d", 2, "  ")], "doc_id string, page int, text string")
    assert [r.start for r in retrieval.chunk(pages, 4, 1).orderBy("start").collect()] == [0, 3, 6]
    with pytest.raises(ValueError):
        retrieval.chunk(pages, 4, 4)


def test_fusion_and_ties(spark):
    rank = lambda ids: spark.createDataFrame([("q", i, n + 1) for n, i in enumerate(ids)], "q string, id int, rank int")
    got = retrieval.top_k(retrieval.fuse([rank([1, 2, 3]), rank([3, 1, 4])], "q", "id"), "q", 2, "id").orderBy("rank").collect()
    assert [r.id for r in got] == [1, 3]
    rows = spark.createDataFrame([("q", i, s) for i, s in enumerate([0.5, 0.9, 0.5, 0.1])], "q string, id int, score double")
    assert [r.id for r in retrieval.top_k(rows, "q", 3, "id").orderBy("rank").collect()] == [1, 0, 2]


def test_scope_treats_missing_groups_as_one(spark):
    q = spark.createDataFrame([("q", ["a"])], "qid string, doc_ids array<string>")
    groups = spark.createDataFrame([("a", None), ("b", None), ("c", "x")], "doc_id string, corpus string")
    assert [r.doc_id for r in retrieval.scope(q, groups).orderBy("pos").collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        registry.arm("nothing")
    with pytest.raises(ValueError):
        registry.arm("pageindex_native")()
    assert len(registry.ARMS) == 8


def test_tree(spark):
    h = spark.createDataFrame([("d", 1, "a", 1, 1), ("d", 2, "b", 2, 2), ("d", 3, "c", 4, 2), ("d", 4, "e", 5, 1)], "doc_id string, pos int, title string, page int, level int")
    docs = spark.createDataFrame([("d", "t", 6), ("e", "u", 2)], "doc_id string, title string, n_pages int")
    got = {(r.doc_id, r.node_id): (r.parent, r.start_page, r.end_page) for r in trees.build_tree(h, docs).collect()}
    assert got == {("d", "n1"): (None, 1, 5), ("d", "n2"): ("n1", 2, 4), ("d", "n3"): ("n1", 4, 5), ("d", "n4"): (None, 5, 6), ("e", "n0"): (None, 1, 2)}


def test_replay_takes_back_the_last_entry_of_any_draft(spark):
    log = [("l", "a", "accept", 1), ("l", "b", "reject", 2), ("l", "", "undo", 3), ("l", "a", "reject", 4), ("l", "", "undo", 5), ("l", "c", "accept", 6), ("m", "", "undo", 1), ("m", "d", "accept", 2), ("n", "a", "accept", 1), ("n", "a", "reject", 2), ("n", "", "undo", 3)]
    got = questions.replay(spark.createDataFrame(log, "log string, draft_id string, action string, at int")).collect()
    # an undone draft has no decision, whatever it had before
    assert {(r.log, r.draft_id, r.action) for r in got} == {("l", "c", "accept"), ("m", "d", "accept")}


def test_whole_log_by_brute_force(spark, tmp_path):
    r = random.Random(3)
    kinds = {"error": "undo", "purchase": "accept", "view": "reject"}
    events = [(i, r.randrange(200), r.choice(list(kinds))) for i in range(3000)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    stacks, now, said = {}, {}, {}
    for i, user, kind in events:
        log, draft, action = user % 50, str(i * 7 % 20), kinds[kind]
        stack = stacks.setdefault(log, [])
        if action == "undo":
            if stack:
                now.pop((log, stack.pop()), None)
        else:
            stack.append(draft)
            now[log, draft] = action, i
        who, d = "adjudication" if user % 19 == 0 else f"r{user % 3}", i % 700
        if 50 <= d <= 600:
            said.setdefault(str(d), {})[who] = ("reject" if kind == "error" else "accept", i)
    assert {(x.log, x.draft_id): (x.action, x.last_at) for x in PLANS["decision_replay"](spark, str(tmp_path)).collect()} == now
    merged = {}
    for d, by in said.items():
        alike = len({a for a, _ in by.values()}) == 1
        merged[d] = (*by["adjudication"], "adjudicated") if "adjudication" in by else (*max(by.values(), key=lambda x: x[1]), "agreed") if alike else (None, None, "conflict")
    assert {x.draft_id: (x.action, x.at, x.source) for x in PLANS["merge_reviewers"](spark, str(tmp_path)).collect()} == merged
    lines = spark.createDataFrame([("a", "r1", "accept", 1), ("a", "r2", "reject", 2)], "draft_id string, reviewer string, action string, at int")
    drafts = lines.select("draft_id")
    with pytest.raises(Exception, match="disagree on a"):
        questions.merge_reviewers(lines, drafts, drafts.limit(0), strict=True).collect()


#: Answers and how they are scored.
ANSWERS = [
    ("exact", "65.00% of the initial reference price", None, "numeric", "65.00%", None),
    ("numeric", "CHF 1,152.00", None, "numeric", "CHF 1,152.00", None),
    ("free", "2027-03-30, 2027-06-29", None, "date_list", None, ["2027-03-30", "2027-06-29"]),
    ("date_list", None, ["2027-03-30", "2027-06-29"], "date_list", None, ["2027-03-30", "2027-06-29"]),
    ("date", "30 March 2027", None, "free", "30 March 2027", None),
    ("numeric", "about a third", None, "free", "about a third", None),
    ("exact", "Bank Julius Baer & Co. Ltd.", None, "exact", "Bank Julius Baer & Co. Ltd.", None),
    ("bogus", "yes", None, "free", "yes", None),
    ("numeric", "CHF 1'000", None, "numeric", "CHF 1'000", None),
    ("numeric", "60 shares", None, "free", "60 shares", None),
    ("exact", "2027-03-30", None, "numeric", "2027-03-30", None),
    ("free", "2027-03-30 and 2027-06-29", None, "date_list", None, ["2027-03-30", "2027-06-29"]),
    ("free", None, ["a", "2027-06-29"], "free", "a; 2027-06-29", None),
    ("free", None, None, "free", "", None),
]


def test_normalise_answer(spark):
    import re

    rows = spark.createDataFrame([(i, *x[:3]) for i, x in enumerate(ANSWERS)], "i int, kind string, answer string, answers array<string>")
    got = {r.i: r.a for r in rows.select("i", questions.normalise_answer(F.col("kind"), F.col("answer"), F.col("answers")).alias("a")).collect()}
    for i, (_, answer, _, kind, value, values) in enumerate(ANSWERS):
        if answer == "2027-03-30":  # an amount only if all of it is one
            kind = "numeric" if re.match(questions.AMOUNT, answer) else "exact"
        assert (got[i].kind, got[i].value, got[i].values) == (kind, value, values), i


def test_redaction(spark):
    rows = spark.createDataFrame([("q1", "fb", "what?", ("numeric", "5"), "five", [("d", 1, "text"), ("d", 2, None)], {"native_answer": "x", "sdk_answer": "y", "reads": "1"}), ("q2", "own", "what?", ("numeric", "5"), "five", [("d", 1, "text")], {"native_answer": "x"})], "qid string, dataset string, question string, gold struct<kind: string, value: string>, answer string, evidence array<struct<doc_id: string, page: int, snippet: string>>, trace map<string, string>")
    a, b = runs.redact(rows, ["fb"]).orderBy("qid").collect()
    assert (a.question, tuple(a.gold), a.answer, [e.snippet for e in a.evidence], a.trace, a.redacted) == ("fb question q1", ("numeric", None), None, ["", None], {"reads": "1"}, True)
    assert (b.question, tuple(b.gold), b.answer, b.evidence[0].snippet, b.trace, b.redacted) == ("what?", ("numeric", "5"), "five", "text", {"native_answer": "x"}, False)


def test_page_windows(spark):
    r, text = random.Random(4), "w " * 130
    table = text + "\n| a | b |\n|---|---|\n| 1 | 2 |"
    kinds = {d: [r.choice([text, table, "short"]) for _ in range(r.randrange(1, 40))] for d in range(12)} | {99: [table] * 30}
    pages = spark.createDataFrame([(d, n + 1, t) for d, ts in kinds.items() for n, t in enumerate(ts)], "doc_id long, page int, text string")
    got = {}
    for x in drafting.page_windows(pages).collect():
        got.setdefault(x.doc_id, []).append((x.start, list(x.pages)))
    for d, ts in kinds.items():
        starts = sorted(s for s, _ in got.get(d, []))
        fits = lambda s: all(abs(s - t) > 3 for t in starts)  # noqa: B023, E731
        assert all(ts[s - 1] != "short" for s in starts) and all(b - a > 3 for a, b in zip(starts, starts[1:]))
        assert all(p == list(range(s, min(s + 2, len(ts)) + 1)) for s, p in got.get(d, []))
        # nothing that fits is left out while there is room
        assert len(starts) == 4 or not any(fits(n + 1) for n, t in enumerate(ts) if t != "short")
    assert len(got[99]) == 4


def test_clusters():
    import numpy as np

    from lanternrow.operators.retrieval import clusters

    r = np.random.default_rng(1)
    x = np.concatenate([r.standard_normal((30, 4)) * 0.1 + c for c in (np.zeros(4), np.full(4, 9.0), np.array([9.0, 0, 0, 0]))])
    label = clusters(x, 3, r.random(3))
    assert all(len(set(label[a : a + 30])) == 1 for a in (0, 30, 60)) and len(set(label)) == 3
    assert len(set(clusters(np.zeros((5, 2)), 3, r.random(3)))) == 1 and clusters(x[:1], 4, r.random(4)).tolist() == [0]
    means = np.stack([x[label == j].mean(0) for j in range(3)])
    assert (((x[:, None] - means[None]) ** 2).sum(2).argmin(1) == label).all()


def test_near_quotes(spark):
    page = "The issuer pays a coupon of 5.25 % per annum on each\ncoupon pay-\nment date; the notes are redeemed at par unless a barrier event has occurred."
    rows = [(1, "pays a coupon of 5.25 % per annum"), (2, "pays a cupon of 5.25 % per anum"), (3, "coupon payment date"), (4, "two words"), (5, "something else that is quite different"), (6, None), (7, "The notes coupon annum barrier par")]
    from lanternrow.sources.services import fuzzy_quotes

    df = spark.createDataFrame([(i, q, page) for i, q in rows], "i int, quote string, page string").unionByName(spark.createDataFrame([(8, "three whole words", None)], "i int, quote string, page string"))
    assert {r.i for r in fuzzy_quotes(df).collect() if r.on_page} == {1, 2, 3}


def test_all_pages_are_verified_and_checked(spark, tmp_path):
    from difflib import SequenceMatcher

    r = random.Random(6)
    docs = [(i, "en", "\n".join(" ".join(r.choice(["ab", "cd", "ef", "gh"]) for _ in range(r.randrange(0, 9))) for _ in range(n))) for i, n in enumerate([1, 5, 17])]
    spark.createDataFrame(docs, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want, facts = {}, {}
    for i, _, t in docs:
        lines = t.split("\n")
        for m, line in enumerate(lines):
            near = [(SequenceMatcher(None, *(" ".join(x.split()) for x in (line, lines[k])), autojunk=False).ratio(), -k) for k in range(max(0, m - 2), min(len(lines), m + 3))]
            want[i, m + 1] = 1 - max(near)[1], round(max(near)[0], 6)
            facts[i, m + 1] = i % 2 == 0 and len(line.split()[1:6]) >= 3
    assert {(x.doc_id, x.mapped): (x.page, x.ratio) for x in PLANS["page_verify"](spark, str(tmp_path)).collect()} == want
    assert {(x.doc_id, x.page): x.quote_ok for x in PLANS["checked_facts"](spark, str(tmp_path)).collect()} == facts


def test_missing_price_raises(spark):
    calls = spark.createDataFrame([("q", "m", 1, 1, 1.0, False, None)], "qid string, model string, input_tokens int, output_tokens int, latency_s double, local boolean, parallel_group string")
    prices = spark.createDataFrame([("n", 1.0, 1.0)], "model string, input_per_m double, output_per_m double")
    with pytest.raises(Exception, match="no price"):
        metrics.ledger(calls, prices, "qid").collect()


def test_exclusion_fails_closed(spark):
    rows = spark.createDataFrame([("Ann  Bee was here",), ("nobody",)], "t string")
    assert [r.t for r in questions.excluded(rows, spark.createDataFrame([("ann bee",)], "name string"), "t").collect()] == ["nobody"]
    with pytest.raises(ValueError):
        questions.excluded(rows, spark.createDataFrame([], "name string"), "t")


def test_service_errors_are_rows(spark):
    def broken(prompt):
        raise RuntimeError("down")

    got = services.complete(spark.createDataFrame([("q", "x y")], "qid string, prompt string"), service=broken, tries=2, wait=0.01).first()
    assert got.error == "RuntimeError: down" and got.text is None


def test_question_files(spark, tmp_path):
    p = tmp_path / "g.jsonl"
    p.write_text('{"qid":"a","gold":{"kind":"numeric","value":"1"},"evidence":[{"doc_id":"d","page":1}]}\n\n{"qid":"a","gold":{"kind":"odd","value":"1"},"evidence":[],"pair_id":"p"}\n{"qid":"u","gold":{"kind":"unanswerable"},"evidence":[{"doc_id":"d","page":1}]}\nnot json\n')
    rows = files.read_questions(spark, [str(p)]).cache()
    assert sorted((r.qid or "", r.why) for r in files.invalid_questions(rows).collect()) == [("", "unreadable line"), ("a", "pair_id and form go together"), ("a", "repeated qid"), ("a", "repeated qid"), ("a", "unanswerable means no evidence"), ("a", "unknown kind"), ("u", "unanswerable means no evidence")]


def test_parsed_folder_and_manifest(spark, tmp_path):
    (tmp_path / "d1.json").write_text('{"doc_id":"d1","title":"T","sha256":"s","pages":[{"number":1,"text":"x"}],"tree":[{"id":"n1","parent":null,"title":"A","start_page":1,"end_page":1,"level":1}]}')
    (tmp_path / "groups.json").write_text('{"d1":"c"}')
    docs, pages, tree = files.read_parsed(spark, str(tmp_path))
    assert [tuple(r) for r in docs.collect()] == [("d1", "T", "s", "c", 1)] and pages.count() == 1 and tree.first().node_id == "n1"
    m = spark.createDataFrame([("a-1", "c", "A", "I, \"x\"", "", "t", "en", "", "u", "", None, "n")], files.MANIFEST.replace("pages string", "pages int"))
    files.write_manifest(m, str(tmp_path / "m"))
    back = files.read_manifest(spark, str(tmp_path / "m")).first()
    assert back.pages is None and back.issuer == 'I, "x"'


def test_latest_keeps_the_first_place(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "key string, seq int, row string")
    assert sorted(tuple(r) for r in runs.latest(log, "key", "seq").collect()) == [("a", 1, "z"), ("b", 2, "y")]


def test_streams(spark, tmp_path):
    from lanternrow.streaming.decisions import latest_stream, upsert_stream, windowed_counts

    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "id string, n int, v string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = latest_stream(stream, "id", "n", ["v"]).writeStream.outputMode("complete").format("memory").queryName("latest").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.id, r.v) for r in spark.table("latest").collect()} == {("a", "y"), ("b", "z")}
    upsert_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert windowed_counts(stream.withColumn("ts", F.current_timestamp()).withColumn("event_type", F.col("id"))).columns == ["start", "event_type", "n"]


def test_embedding_service_puts_vectors_back_in_order(spark):
    from lanternrow.sources.services import embed

    rows = spark.createDataFrame([(i, "x" * i if i else None) for i in range(130)], "k int, text string").coalesce(1)
    got = embed(rows, "k").collect()
    assert sorted(r.k for r in got) == list(range(130))
    for r in got:
        size = (r.k**2 + 1) ** 0.5
        assert r.embedding == pytest.approx([r.k / size, 0.0, 1 / size])
    assert sum(r.input_tokens for r in got) == 129
    assert embed(rows.limit(0), "k").count() == 0


def test_rerank_service_scatters_scores_and_takes_nothing(spark):
    from lanternrow.sources.services import rerank

    rows = spark.createDataFrame([(1, 1, "ab{document}", "a"), (1, 2, "ab{document}", "x" * 12), (2, 1, None, None)], "q int, d int, query string, document string")
    got = {(r.q, r.d): r.score for r in rerank(rows, "q", "d").collect()}
    assert got[(1, 1)] == pytest.approx(1 / 12) and got[(1, 2)] == 1.0 and got[(2, 1)] == 0.0
    assert rerank(rows.limit(0), "q", "d").count() == 0


def test_refused_requests_stop_the_job(spark):
    from lanternrow.sources.services import Refused, complete

    def refuse(prompt):
        raise Refused("bad request")

    with pytest.raises(Exception, match="bad request"):
        complete(spark.createDataFrame([("q", "p")], "qid string, prompt string"), service=refuse).collect()


def test_evaluation_asks_each_service_once_and_keeps_errors(spark, tmp_path):
    from lanternrow.operators import evaluation as E

    log = str(tmp_path / "calls")

    def note(line):
        with open(log, "a") as f:
            f.write(line + "\n")

    def chat(prompt):
        q = prompt.splitlines()[-1]
        note(f"answer {q}")
        if q == "long":
            return {"text": "ANSWER: x", "input_tokens": 1, "output_tokens": 1, "finish_reason": "length"}
        return {"text": f"ANSWER: {q}", "input_tokens": 1, "output_tokens": 1, "finish_reason": "stop"}

    def verdict(prompt):
        note("judge " + prompt.splitlines()[-1])
        return {"text": "\n correct", "input_tokens": 1, "output_tokens": 1, "finish_reason": "stop"}

    kinds = [("a", "one", "exact", "one"), ("b", "two", "exact", "other"), ("c", "long", "exact", "x"), ("d", "four", "free", "4"), ("e", "five", "exact", "other"), ("f", "six", "unanswerable", None)]
    q = spark.createDataFrame([(k, t, ["d"], [("d", 2 if k == "e" else 1)], (kind, v, None)) for k, t, kind, v in kinds], "qid string, question string, doc_ids array<string>, evidence array<struct<doc_id: string, page: int>>, gold struct<kind: string, value: string, values: array<string>>")
    pages = spark.createDataFrame([("d", 1, "text"), ("d", 2, " \n")], "doc_id string, page int, text string")
    got = spark.createDataFrame([(k[0], 1, "d", 1, "chunk", "text") for k in kinds], "qid string, rank int, doc_id string, page int, kind string, text string")
    out = {r.qid: r for r in E.evaluate(q, got, pages, chat, verdict).collect()}
    assert {k: (r.correct, r.failure) for k, r in out.items()} == {
        "a": (True, None), "b": (False, "right_evidence_wrong_answer"), "c": (None, "error"), "d": (True, None), "e": (False, "parse_failure"), "f": (False, "answered_unanswerable"),
    }
    assert out["c"].evidence_recall is None and "cut off" in out["c"].error and out["d"].judge == "llm"
    calls = open(log).read().splitlines()
    assert sorted(calls) == sorted([f"answer {k[1]}" for k in kinds] + ["judge Candidate: four"])


def test_paired_statistics(spark):
    from math import comb

    from lanternrow.operators import review as V

    a = spark.createDataFrame([(i, i < 12) for i in range(20)] + [(99, None)], "qid int, correct boolean")
    b = spark.createDataFrame([(i, i >= 9 and i % 2 == 1) for i in range(20)] + [(99, True)], "qid int, correct boolean")
    r = V.paired(a, b).first()
    x, y = r.only_a, r.only_b
    assert (r.n, x + y + r.both <= 20) == (20, True)
    assert r.p == pytest.approx(min(1.0, 2 * sum(comb(x + y, i) for i in range(min(x, y) + 1)) / 2 ** (x + y)))
    assert V.paired(a, a).first().p == 1.0 and V.paired(a.limit(0), b).first().n == 0
    h = {r.k: (round(r.adjusted, 6), r.rejected) for r in V.holm(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p double")).collect()}
    assert h == {"a": (0.03, True), "c": (0.06, False), "b": (0.06, False)}
    up = V.paired_bootstrap(a.na.drop().select("qid", a.correct.cast("int").alias("v")), b.na.drop().select("qid", b.correct.cast("int").alias("v")), "qid", "v", 500).first()
    assert up.low <= up.difference <= up.high and 0 <= up.wins <= 1


def test_quota_gaps_of_an_empty_set_and_excerpts(spark):
    from pyspark.sql import functions as F

    from lanternrow.operators import review as V

    none = spark.createDataFrame([], "qid string, pair_id string, regime string, qtype string, split string")
    assert V.quota_gaps(none).count() == 2 * 2 + 6
    rows = spark.createDataFrame([("a" * 600 + " The Rate,\nis FIVE per cent. " + "b" * 600, "rate is five"), ("x ---- y", "too short"), (None, None)], "t string, q string")
    one, two, three = (r.e for r in rows.select(V.excerpt(F.col("t"), F.col("q")).alias("e")).collect())
    assert (one.found, one.marked, len(one.before), len(one.after)) == (True, "Rate,\nis FIVE", 450, 450)
    assert (two.found, two.before) == (False, "x — y") and three.before == ""


def test_exclusion_by_automaton(spark):
    import random

    r = random.Random(5)
    from lanternrow.functions.automaton import Automaton

    for letters in ("ab", "abc", "abé"):
        for _ in range(20):
            patterns = ["".join(r.choice(letters) for _ in range(r.randrange(1, 7))).encode() for _ in range(r.randrange(1, 30))]
            given = ["".join(r.choice(letters + "x") for _ in range(r.choice([0, 1, 5, 50, 700]))).encode() for _ in range(40)]
            assert Automaton.build(patterns).found_in(given).tolist() == [any(p in t for p in patterns) for t in given]
    # a pattern that is longer than a lane
    long = b"ab" * 200 + b"c"
    assert Automaton.build([long]).found_in([b"x" * k + long for k in range(0, 300, 7)] + [b"ab" * 400]).tolist() == [True] * 43 + [False]
    with pytest.raises(ValueError):
        Automaton.build([b"a", b""])
    names = ["ann bee", " Ann  BEE ", "Straße", "z" * 700, "  "] + [f"person {i}x" for i in range(500)]
    given = ["so said Ann\n Bee.", "STRASSE 5", "y" + "Z" * 700, "Person 499X", "person 499", None, "", "annbee"]
    rows = spark.createDataFrame([(t,) for t in given], "t string")
    wanted = spark.createDataFrame([(n,) for n in names], "name string")
    for at_once in (1_000_000, 100):
        left = questions.excluded(rows, wanted, "t", at_once)
        assert sorted(map(str, (x.t for x in left.collect()))) == ["", "None", "annbee", "person 499"]
    assert "Join" not in left._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        questions.excluded(rows, spark.createDataFrame([(" ",)], "name string"), "t")


def test_redacted_gold_keeps_its_kind_alone(spark):
    kind = "qid string, dataset string, gold struct<kind: string, value: string, values: array<string>, note: string>"
    rows = spark.createDataFrame([("a", "l", ("date_list", None, ["2026-01-01"], "n")), ("b", "o", ("exact", "v", ["w"], "n")), ("c", "l", None), ("d", None, ("exact", "v", None, None))], kind)
    got = {r.qid: r.gold and tuple(r.gold) for r in runs.redact(rows, ["l"]).collect()}
    assert got["a"] == ("date_list", None, None, None) and got["b"] == ("exact", "v", ["w"], "n") and got["d"] == ("exact", "v", None, None) and not any(got["c"] or ())


def test_clusters_hold_a_bounded_block_of_distances(monkeypatch):
    import tracemalloc

    import numpy as np

    from lanternrow.operators import retrieval

    r = np.random.default_rng(4)
    x, draws = r.standard_normal((6000, 8)), r.random(1000)
    whole = retrieval.clusters(x, 1000, draws, 2)
    monkeypatch.setattr(retrieval, "AT_ONCE_BYTES", 1 << 20)
    tracemalloc.start()
    label = retrieval.clusters(x, 1000, draws, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # all distances are 48 MB
    assert np.array_equal(label, whole) and peak < 16 << 20
