"""Turns read what their scope holds, gold evidence is looked for once, and failures of parsing join pages of the evidence alone."""

from lanternrow.operators import evaluation, navigate
from lanternrow.plans import navigation
from lanternrow.plans.base import gold


def test_tables_are_cut_to_the_scope(spark, tmp_path):
    scope = spark.createDataFrame([(1, 5, 0), (2, 5, 0), (2, 7, 1)], "qid int, doc_id long, pos int")
    pages = spark.range(1000).selectExpr("id AS doc_id", "1 AS page", "concat('text ', id) AS text")
    names = spark.range(10).selectExpr("cast(id AS string) AS doc_id", "id * id AS n")
    again, (own, named) = navigate.in_scope(scope, f"file://{tmp_path}/run", pages=pages, names=names)
    assert sorted(map(tuple, again.collect())) == [(1, 5, 0), (2, 5, 0), (2, 7, 1)]
    assert sorted(map(tuple, own.collect())) == [(5, 1, "text 5"), (7, 1, "text 7")]
    assert sorted(map(tuple, named.collect())) == [("5", 25), ("7", 49)]
    # a run that goes on reads what it stored
    less = navigate.in_scope(scope.limit(0), f"file://{tmp_path}/run", pages=pages.limit(0), names=names)[1]
    assert less[0].count() == 2


def test_gold_is_looked_for_once_a_query(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(navigation, "gold", lambda *a: calls.append(a) or gold(*a))
    assert navigation.QUERIES["navigated_runs"](spark, "/root/testdata/sf0.001").columns
    assert len(calls) == 1


def test_gold_of_short_texts_and_ends(spark, tmp_path):
    items = [(1, "one two three four five"), (2, "two three"), (3, "b c d e f"), (4, None)]
    docs = [(1, "zero one two three four five"), (2, "one two three four fiv"), (3, "two three"), (4, "x"), (5, ""), (6, None), (7, "a b c d e f\nb c d e f"), (8, "c d"), (9, "c d e")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/d/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/d/documents.parquet")
    want = sorted((i, d) for i, t in items for d, x in docs if t is not None and x is not None and t in x)
    assert sorted(map(tuple, gold(spark, f"{tmp_path}/d").collect())) == want


def test_parse_failures_with_many_pages(spark):
    asked = spark.createDataFrame([(1, [("a", 1), ("a", 2)]), (2, [("b", 9)]), (3, []), (4, [("c", 1)])], "qid int, evidence array<struct<doc_id: string, page: int>>")
    pages = spark.createDataFrame([("a", 1, "x"), ("a", 2, " \n"), ("b", 1, ""), ("c", 1, "y"), ("d", 1, "")], "doc_id string, page int, text string")
    assert sorted(map(tuple, evaluation.parse_failure(asked, pages).collect())) == [(1, True), (2, True), (3, False), (4, False)]


def test_reads_go_to_the_pages(spark):
    # as in a cluster whose pages are beyond a broadcast: a turn shuffled all of them
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages = spark.range(40).selectExpr("id div 10 AS doc_id", "cast(id % 10 + 1 AS int) AS page", "concat('text ', id) AS text")
        scope = spark.createDataFrame([(1, "0"), (1, "2"), (2, "3")], "qid int, doc_id string")
        acts = spark.createDataFrame([(1, 1, 2, "pages", "2", "9-12, 3, 2-4"), (2, 1, 2, "pages", "3", "x"), (2, 1, 3, "pages", "0", "1")], "qid int, attempt int, turn int, action string, doc_id string, spec string")
        got = navigate.page_reads(acts, scope, pages)
        assert sorted((r.qid, r.at, r.page, r.text) for r in got.collect()) == [(1, 1, 9, "text 28"), (1, 2, 10, "text 29"), (1, 3, 3, "text 22"), (1, 4, 2, "text 21"), (1, 5, 4, "text 23")]
        joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x and "doc_id" in x]
        assert any("rightHint=(strategy=broadcast)" in x for x in joins), joins
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_gold_at_every_place_of_a_block(spark, tmp_path):
    import random

    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abäß水 \n") for _ in range(draw.randint(1, 9)))
    long, middle, short = "".join(word() for _ in range(30)), "x" * 15, "水y"
    items = [(1, long), (2, middle), (3, short), (4, long[:20]), (5, "x" * 14), (6, None), (7, "")]
    docs = [(i, "a" * i + (long, middle, short)[i % 3] + "b" * (i % 7)) for i in range(99)] + [(99, long[1:]), (100, None), (101, ""), (102, "x" * 14)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/d/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/d/documents.parquet")
    want = sorted((i, d) for i, t in items for d, x in docs if t is not None and x is not None and t in x)
    assert sorted(map(tuple, gold(spark, f"{tmp_path}/d").collect())) == want


def test_trees_look_at_levels_that_occur(spark):
    from lanternrow.operators import trees

    heads = [("a", 0, "x", 1, 2), ("a", 1, "y", 3, 5), ("a", 2, "z", 3, 2), ("b", 0, "w", 2, 5)]
    docs = spark.createDataFrame([("a", "A", 9), ("b", "B", 4), ("c", "C", 2)], "doc_id string, title string, n_pages int")
    tree = trees.build_tree(spark.createDataFrame(heads, "doc_id string, pos int, title string, page int, level int"), docs)
    got = sorted((r.doc_id, r.node_id, r.parent, r.start_page, r.end_page) for r in tree.collect())
    assert got == [("a", "n0", None, 1, 3), ("a", "n1", "n0", 3, 3), ("a", "n2", None, 3, 9), ("b", "n0", None, 2, 4), ("c", "n0", None, 1, 2)]
    # a running value before and behind for each of the two levels, not for six
    assert tree._jdf.queryExecution().optimizedPlan().toString().count("specifiedwindowframe(RowFrame, unboundedpreceding") == 4
    none = trees.build_tree(spark.createDataFrame(heads, "doc_id string, pos int, title string, page int, level int").limit(0), docs)
    assert sorted((r.doc_id, r.end_page) for r in none.collect()) == [("a", 9), ("b", 4), ("c", 2)]


def test_navigated_documents_are_read_once_for_their_lines(spark, tmp_path):
    docs = [(1, "one", "s"), (2, None, "s"), (3, "", "t"), (4, "a\nb\n\nc\nd\n", "u"), (4, "x\ny", "v")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    of, tree = navigation._tree(spark, str(tmp_path))
    assert sorted((r.doc_id, r.title, r.n_pages) for r in of.collect()) == [(1, "s", 1), (3, "t", 1), (4, "u", 6), (4, "v", 6)]
    assert sorted({(r.doc_id, r.node_id, r.start_page) for r in tree.collect()}) == [(1, "n0", 1), (3, "n0", 1), (4, "n0", 1), (4, "n1", 5)]
