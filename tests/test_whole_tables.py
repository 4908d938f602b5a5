"""Steps that used to make pairs, or to work values out again and again."""

import random
from datetime import date

from pyspark.sql import functions as F

from lanternrow.functions import values
from lanternrow.operators import drafting, retrieval, schemas
from lanternrow.sources.services import best_page


def test_equal_pages_are_not_aligned(spark):
    """Long pages, each met by itself, cost no alignment; the others get what difflib gives."""
    from difflib import SequenceMatcher

    r = random.Random(3)
    long = [(1, p, "".join(r.choice("abcd ") for _ in range(20_000))) for p in range(1, 13)]
    own = spark.createDataFrame(long, "doc_id int, page int, text string")
    got = best_page(own.withColumnRenamed("page", "mapped"), own).collect()
    assert {(x.mapped, x.page, x.ratio) for x in got} == {(p, p, 1.0) for p in range(1, 13)}
    short = [(2, p, None if p == 4 else "".join(r.choice("ab ") for _ in range(r.randrange(12))).strip()) for p in range(1, 9)]
    asked = [(2, p, t and t + "zz") for _, p, t in short] + [(2, 3, "ab ab"), (2, 90, "x")]
    found = best_page(spark.createDataFrame(asked, "doc_id int, mapped int, text string"), spark.createDataFrame(short, "doc_id int, page int, text string"))
    want, plain = {}, lambda t: " ".join((t or "").split())
    for _, m, t in asked:
        for _, p, u in short:
            if abs(p - m) <= 2:
                want[m] = max(want.get(m, (-1, 0)), (SequenceMatcher(None, plain(t), plain(u), autojunk=False).ratio(), -p))
    assert {x.mapped: (x.ratio, -x.page) for x in found.collect()} == want


def test_notes_are_met_by_date(spark):
    """One issuer with 20,000 papers and as many notes, each linked with one."""
    n = 20_000
    days = F.date_add(F.lit(date(2000, 1, 1)), F.col("id").cast("int"))
    notes = spark.range(n).select(F.col("id").alias("note_id"), F.lit("i").alias("issuer"), days.alias("note_date"))
    papers = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("i").alias("issuer"), F.lit(1).alias("page"), F.concat(F.lit("Securities Note of "), F.date_format(days, "d MMMM yyyy")).alias("text"))
    got = drafting.linked_notes(papers.select("doc_id", "issuer"), notes, papers.select("doc_id", "page", "text"))
    assert got.agg(F.count("*"), F.count_if(F.col("doc_id") == F.col("note_id"))).first()[:] == (n, n)


def test_number_patterns_are_looked_for_once(spark):
    """The first number is cut out once a text, not once a use."""
    df = spark.createDataFrame([("CHF 1'234.50 p.a.",)], "a string").select(values.readings(F.col("a")))
    shown = df._jdf.queryExecution().logical().toString()
    assert shown.count("CHF|EUR") == 1


def test_groups_are_a_scope_without_pairs(spark):
    r = random.Random(8)
    docs = spark.createDataFrame([(i, "".join(r.choice(["ab ", "cd ", "ef "]) for _ in range(r.randrange(9))), r.choice("xyz")) for i in range(60)], "doc_id int, text string, g string")
    items = spark.createDataFrame([(1, "ab"), (2, "cd ef ef"), (3, "ab ef")], "item_id int, text string")
    of = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "item_id int, group string")
    pairs = of.join(docs.select("doc_id", F.col("g").alias("group")), "group").select("item_id", "doc_id")
    rows = lambda df: sorted((x.item_id, x["rank"], x.doc_id, round(x.score, 9)) for x in df.collect())
    got = rows(retrieval.lexical(docs, items, 4, groups=(of, docs.select("doc_id", F.col("g").alias("group")))))
    assert got == rows(retrieval.lexical(docs, items, 4, scope=pairs)) and {x[0] for x in got} == {1, 2}


def test_documents_are_numbered_once_for_a_set_of_corpora(spark):
    groups = spark.createDataFrame([(i, [None, "a", "b"][i % 3]) for i in range(30)], "doc_id int, corpus string")
    asked = spark.createDataFrame([("p", [1]), ("q", [1, 4, 2]), ("r", [2, 7]), ("s", [99]), ("t", [])], "qid string, doc_ids array<int>")
    out = retrieval.scope(asked, groups)
    reach = {"p": [1], "q": [1, 2], "r": [1, 2], "s": [0]}
    assert {(x.qid, x.doc_id, x.pos) for x in out.collect()} == {(q, d, i) for q, rest in reach.items() for i, d in enumerate(d for d in range(30) if d % 3 in rest)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(set#" in plan and "windowspecdefinition(qid#" not in plan


def test_rules_are_columns_of_one_projection(spark):
    """A value's schema is told once for a test, and no test is part of the array that is exploded."""
    schema = {"type": ["object", "null"], "required": ["a"], "properties": {"a": {"type": ["number", "null"]}}}
    rows = spark.createDataFrame([(1, '{"a": 1.5}'), (2, '{"a": "x"}'), (3, "[1]"), (4, "{"), (5, "null"), (6, '{"a": 12345678901234567890}'), (7, "{}")], "id int, document string")
    out = schemas.violations(rows, schema, "id")
    assert {tuple(x) for x in out.collect()} == {(2, "$.a type"), (3, "$ type"), (4, "not JSON"), (7, "$ required a")}
    generate = [line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Generate explode" in line]
    assert len(generate) == 1 and "schema_of_variant" not in generate[0] and "variant_get" not in generate[0]


def test_every_window_is_learned_from(spark):
    """By the values that are shipped, a long text gives all of its windows."""
    import public_tokenizers

    from lanternrow.llm import lm

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    texts = spark.createDataFrame([(1, "alpha beta " * 900), (2, "gamma"), (3, None)], "doc_id int, text string")
    blocks = lm._blocks(texts, "doc_id", "text", F.col("doc_id") > 0, path)
    windows = sum(-(-len(r.ids) // 2 // lm.STRIDE) for r in blocks.collect())
    assert lm.learn(blocks, lm.fit([], lm.Pieces(path), lm.id_pairs(blocks))) == windows > 30


def test_nearest_within_groups_without_pairs(spark):
    """Groups give what their pairs give, equal scores and vectors of several groups included, in blocks or in one."""
    from lanternrow.operators import arms, ivf

    r = random.Random(5)
    vec = lambda: [float(r.randrange(-2, 3)) for _ in range(3)]
    cards = spark.createDataFrame([(i, vec()) for i in range(300)] + [(900, None)], "doc_id int, embedding array<double>")
    asked = spark.createDataFrame([(f"q{i}", vec()) for i in range(40)], "qid string, embedding array<double>")
    q_of = spark.createDataFrame([(f"q{i}", g) for i in range(40) for g in {i % 3, i % 2}] + [("q1", None)], "qid string, group int")
    d_of = spark.createDataFrame([(i, g) for i in range(300) for g in {i % 4, i % 2}] + [(7, None), (900, 1)], "doc_id int, group int")
    pairs = q_of.join(d_of, "group").select("qid", "doc_id").distinct().filter("doc_id < 900")
    rows = lambda df: sorted((x.qid, x["rank"], x.doc_id, round(x.score, 9)) for x in df.collect())
    want = rows(arms.nearest_documents(asked, cards, pairs, 4))
    for block in (ivf.GROUP_BLOCK, 16):
        ivf.GROUP_BLOCK, was = block, ivf.GROUP_BLOCK
        try:
            assert rows(arms.nearest_documents(asked, cards, None, 4, (q_of, d_of))) == want
        finally:
            ivf.GROUP_BLOCK = was
    reads = d_of.filter("doc_id % 3 > 0").select("group", F.lit(1).alias("seq"), "doc_id", F.lit(1).alias("page"))
    own = q_of.join(reads, "group").select("qid", "seq", "doc_id", "page")
    got = lambda df: sorted(tuple(x) for x in df.collect())
    assert got(arms.reads_within(asked, cards, None, reads, 4, (q_of, d_of))) == got(arms.reads_within(asked, cards, pairs, own, 4))


def test_trees_are_stored_between_their_steps(spark, monkeypatch):
    """A chain of headings: rounds of ancestors are read, not made again, and rows are dealt over more tasks as they grow."""
    from lanternrow import storage
    from lanternrow.operators import trees

    heads = spark.createDataFrame([(d, p, "t", p, p) for d in range(30) for p in range(1, 7)], "doc_id int, pos int, title string, page int, level int")
    docs = spark.createDataFrame([(d, "d", 9) for d in range(31)], "doc_id int, title string, n_pages int")
    monkeypatch.setattr(storage, "TASK_ROWS", 10)
    assert storage.dealt(heads, "doc_id").rdd.getNumPartitions() == 18
    got = trees.ancestors(trees.build_tree(heads, docs))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.doc_id, r.node_id, r.ancestor, r.distance) for r in got.collect()} == {(d, f"n{a}", f"n{b}", a - b) for d in range(30) for a in range(1, 7) for b in range(1, a)}


def test_navigation_is_folded_in_one_pass(spark):
    from lanternrow.operators import trees

    tree = spark.createDataFrame([("1", "n0", 1, 9, 1, 0), ("1", "n1", 3, 4, 2, 1)], "doc_id string, node_id string, start_page int, end_page int, level int, pos int")
    reads = spark.createDataFrame([("q", 1, "1.pdf", [3]), ("q", 2, "1.pdf", [9, 1]), ("p", 1, "1.pdf", [77])], "qid string, seq int, doc_name string, pages array<int>")
    got = trees.navigation(reads, tree)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in got.collect()] == [("q", ["n0", "n1"], "n0", ["n1"])]


def test_bodies_are_held_a_few_at_a_time(spark, monkeypatch):
    """A host's pace goes on over the slices of a batch, and no frame that leaves a task has more than ROWS bodies."""
    from lanternrow.sources import fetch

    monkeypatch.setattr(fetch, "ROWS", 2)
    asked = spark.createDataFrame([(i, f"http://h{i % 2}/{i:02d}", None, False) for i in range(14)], "doc_id int, url string, sha256 string, manual boolean")
    got = fetch.fetch(asked, lambda row: (200, b"x"))
    assert {(r.doc_id, r.at) for r in got.collect()} == {(i, 2.0 * (i // 2 + 1)) for i in range(14)}
