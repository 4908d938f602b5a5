"""Answers, numbers, dates and headings: fixed cases with the results that they must have."""

from pyspark.sql import functions as F

from lanternrow.functions import text, values
from lanternrow.operators import drafting, trees
from lanternrow.sources import files

#: Id, answer, kind, value, values.
CASES = [
    (1, "Reasoning.\nANSWER: 12.5%\nmore", "numeric", "0.125", None), (2, "ANSWER: CHF 1'000.00", "numeric", "1000", None), (3, "The value is not stated.", "numeric", "3", None), (4, "It cannot be determined", "unanswerable", None, None),
    (5, "some\n\n 7 ", "numeric", "7.0", None), (6, "ANSWER: 500.000", "numeric", "500000", None), (7, "ANSWER: 500.000", "numeric", "500", None), (8, "ANSWER: 11. Februar 2028", "date", "2028-02-11", None), (9, "ANSWER: 15 June 2027 and 16.06.2027", "date", "15/06/2027", None),
    (10, "ANSWER: 31.02.2028", "date", "2028-02-28", None), (11, "ANSWER: 2026-06-15, 15.12.2026", "date_list", None, ["2026-06-15", "2026-12-15"]), (12, "ANSWER: 2026-06-15", "date_list", None, ["2026-06-15", "2026-12-15"]),
    (13, "ANSWER: Deutsche Bank AG, Taunusanlage 12", "exact", "deutsche bank  ag", None), (14, "ANSWER: Deutsche Bank AGX", "exact", "Deutsche Bank AG", None), (15, "ANSWER: anything", "free", "x", None), (16, "ANSWER:", "exact", "x", None), (17, "yes", "unanswerable", None, None),
    (18, "ANSWER: 1,234,567.5", "numeric", "1234567.5", None), (19, "ANSWER: 0.83", "numeric", "0.8", None), (20, "ANSWER: -3", "numeric", "-3.01", None), (21, "ANSWER: Dec 5", "date", "2020-12-05", None), (22, "ANSWER: December 5, 2020", "date", "5-Dec-2020", None), (23, None, "exact", "x", None),
]

#: Correct, method, failure of each.
SCORES = {
    1: (True, "numeric", None), 2: (True, "numeric", None), 3: (False, "numeric", None), 4: (True, "refusal", None), 5: (True, "numeric", None), 6: (True, "numeric", None), 7: (True, "numeric", None), 8: (True, "date", None),
    9: (True, "date", None), 10: (False, "date", None), 11: (True, "date_list", None), 12: (False, "date_list", None), 13: (True, "exact", None), 14: (False, "exact", None), 15: (None, "llm", None), 16: (False, "exact", None),
    17: (False, "refusal", "answered_unanswerable"), 18: (True, "numeric", None), 19: (True, "numeric", None), 20: (True, "numeric", None), 21: (False, "date", None), 22: (True, "date", None), 23: (False, "exact", None),
}


def rows(spark):
    return spark.createDataFrame(CASES, "id int, answer string, kind string, value string, vs array<string>")


def test_scores(spark):
    got = rows(spark).select("id", values.score(F.coalesce("answer", F.lit("")), F.col("kind"), F.col("value"), F.col("vs")).alias("s")).collect()
    assert {r.id: tuple(r.s) for r in got} == SCORES


def test_dates_of_a_text(spark):
    got = rows(spark).filter("kind in ('date', 'date_list')").select("id", F.transform(values.dates(F.col("answer")), lambda x: x.cast("string")).alias("d")).collect()
    assert {r.id: r.d for r in got} == {8: ["2028-02-11"], 9: ["2027-06-15", "2027-06-16"], 10: [], 11: ["2026-06-15", "2026-12-15"], 12: ["2026-06-15"], 21: [], 22: ["2020-12-05"]}


def test_levels_by_numbering(spark):
    heads = [("d1", 1, "Part A", 1), ("d1", 2, "I. Summary", 1), ("d1", 3, "1. General", 2), ("d1", 4, "1.2 Detail", 2), ("d1", 5, "plain words", 3), ("d1", 6, "[image]", 3), ("d1", 7, "Annex 1", 4), ("d2", 1, "VI. Terms", 1), ("d2", 2, "Part B", 2), ("d2", 3, "RISK FACTORS", 2), ("d2", 4, "(a) first", 3), ("d2", 5, "§ 3 Rules", 3), ("d3", 1, "no number", 1), ("d3", 2, "Note 4 Leases", 2)]
    got = trees.relevel(spark.createDataFrame(heads, "doc_id string, pos int, title string, page int")).collect()
    assert {(r.doc_id, r.pos): r.level for r in got} == {("d1", 1): 1, ("d1", 2): 3, ("d1", 3): 4, ("d1", 4): 5, ("d1", 5): 6, ("d1", 6): 6, ("d1", 7): 2, ("d2", 1): 1, ("d2", 2): 2, ("d2", 3): 3, ("d2", 4): 5, ("d2", 5): 4, ("d3", 1): 1, ("d3", 2): 1}


def test_where_a_reader_went(spark):
    tree = spark.createDataFrame([("d", "n1", 1, 9, 1, 1), ("d", "n2", 2, 3, 2, 2), ("d", "n3", 3, 3, 3, 3), ("d", "n4", 7, 9, 2, 4)], "doc_id string, node_id string, start_page int, end_page int, level int, pos int")
    reads = spark.createDataFrame([("q1", 1, "d.pdf", [2]), ("q1", 2, "d.pdf", [3]), ("q1", 3, "d.pdf", [7]), ("q1", 4, "d.pdf", [3, 2])], "qid string, seq int, doc_name string, pages array<int>")
    r = trees.navigation(reads, tree).first()
    assert (r.visited, r.selected, r.backtracks) == (["n1", "n2", "n3", "n4"], "n3", ["n4"])


def test_streams_manifests_filings_and_notes(spark):
    bodies = [(1, 'data: {"choices":[{"finish_reason":null}]}\n\ndata: {"choices":[{"finish_reason":"stop"}]}\n\ndata: {"usage":{"prompt_tokens":7,"completion_tokens":3},"choices":[]}\n\ndata: [DONE]\n'), (2, "data: [DONE]\n"), (3, 'event: x\ndata: {"usage":{"prompt_tokens":1,"completion_tokens":2}}\n')]
    assert {r.id: tuple(r.u) for r in spark.createDataFrame(bodies, "id int, b string").select("id", text.sse_usage(F.col("b")).alias("u")).collect()} == {1: (7, 3, "stop"), 2: (None, None, None), 3: (1, 2, None)}
    bad = [("a-1", "A", "CH0012345678", "de", "2026-01-01", "", "3"), ("a-1", "A", "", "de", "2026", "", ""), ("B 2", "C", "bad", "xx", "x", "sha256:12", "-1")]
    found = files.invalid_manifest(spark.createDataFrame(bad, "doc_id string, regime string, isin string, language string, issue_date string, sha256 string, pages string"))
    assert sorted(map(tuple, found.collect())) == sorted([("a-1", "repeated doc_id")] * 2 + [("B 2", f"bad {c}") for c in ("doc_id", "regime", "isin", "language", "issue_date", "sha256", "pages")])
    given = [("$1,577.00", "numeric", "$1,577.00"), ("−0.5%", "numeric", "-0.5%"), ("Yes, it did", "free", "Yes, it did"), (" 12 ", "numeric", "12")]
    assert [tuple(r.g) for r in spark.createDataFrame(given, "a string, k string, v string").select(drafting.filing_gold(F.col("a")).alias("g")).collect()] == [(k, v) for _, k, v in given]
    products = spark.createDataFrame([("p1", "A"), ("p2", "B"), ("p3", "C")], "doc_id string, issuer string")
    notes = spark.sql("select * from values ('n1', 'A', date'2026-01-02'), ('n2', 'B', date'2026-01-02'), ('n3', 'B', date'2026-03-04') as t(note_id, issuer, note_date)")
    p = spark.createDataFrame([("p2", 1, "see the Securities Note dated 4 March 2026."), ("p2", 3, "securities note 2 January 2026")], "doc_id string, page int, text string")
    assert sorted(map(tuple, drafting.linked_notes(products, notes, p).collect())) == [("p1", "n1"), ("p2", "n3")]
