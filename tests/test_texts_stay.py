"""Pages that are stored in buckets aren't dealt again by the steps that meet them by document."""

import io
from contextlib import redirect_stdout


from lanternrow.operators import drafting, stages
from lanternrow.storage import bucketed


def dealt_with_text(df) -> list[str]:
    """The output of each exchange of a plan that carries a page's text."""
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    parts = out.getvalue().split("\n\n")
    return [p for p in parts if ") Exchange" in p.split("\n")[0] and "text" in p]


def pages_of(spark):
    rows = [(f"d{d}", p, f"page {p} of d{d} says " + " ".join(f"w{d}{i}" for i in range(p))) for d in range(5) for p in range(1, 6)]
    return spark.createDataFrame([*rows, ("d0", 9, None)], "doc_id string, page int, text string")


def test_shown_pages_and_quotes_move_tasks_alone(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = pages_of(spark)
        pages = bucketed(rows, "some", "doc_id")
        tasks = spark.createDataFrame([("t1", "d1", [4, 2, 77], "A"), ("t2", "d1", [1], "A"), ("t3", "d2", [88], "B"), ("t4", "none", [1], "B"), ("t5", "d0", [9], None)], "task string, doc_id string, pages array<int>, regime string")
        shown = stages.shown_pages(tasks, pages)
        assert not dealt_with_text(shown)
        got = {r.task: (r.regime, r.shown) for r in shown.collect()}
        assert set(got) == {"t1", "t2", "t5"} and got["t1"] == ("A", "[page 2]\npage 2 of d1 says w10 w11\n\n[page 4]\npage 4 of d1 says w10 w11 w12 w13")
        # pages as rows that aren't stored give the same
        assert {r.task: (r.regime, r.shown) for r in stages.shown_pages(tasks, rows).collect()} == got

        quotes = spark.createDataFrame([(1, "d1", 2), (2, "d1", 2), (3, "d1", 50), (4, "none", 1), (5, "d0", 9), (6, "d3", None)], "n int, doc_id string, page int")
        met = drafting.on_their_pages(quotes, pages)
        assert not dealt_with_text(met)
        text = "page 2 of d1 says w10 w11"
        assert {r.n: (r["__text"], r["__there"]) for r in met.collect()} == {1: (text, True), 2: (text, True), 3: (None, False), 4: (None, False), 5: (None, True), 6: (None, False)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bm25_within_keeps_asked_terms_alone(spark):
    asked = spark.createDataFrame([("i", "d1", "w10 w10 nothing"), ("j", "d1", "says"), ("k", "d2", "w21"), ("l", "gone", "says")], "item_id string, doc_id string, text string")
    pages = bucketed(pages_of(spark), "some", "doc_id")
    got = drafting.bm25_within(asked, pages)
    found = {(r.item_id, r.page): round(r.score, 6) for r in got.collect()}
    # brute force
    import math
    want = {}
    own = {d: {p: (f"page {p} of d{d} says " + " ".join(f"w{d}{i}" for i in range(p))).split() for p in range(1, 6)} for d in (1, 2)}
    for item, d, terms in (("i", 1, {"w10": 2}), ("j", 1, {"says": 1}), ("k", 2, {"w21": 1})):
        mean = sum(map(len, own[d].values())) / 5
        for p, words in own[d].items():
            s = 0.0
            for t, times in terms.items():
                df, tf = sum(t in w for w in own[d].values()), words.count(t)
                s += times * math.log1p((5 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / mean))
            if any(t in words for t in terms):
                want[item, p] = round(s, 6)
    assert found == want
