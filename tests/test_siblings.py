"""Descriptions and siblings, by counts instead of pairs."""

import random

from pyspark.sql import functions as F

from lanternrow.operators import questions as Q

PRODUCT = "doc_id int, issuer string, type string, underlyings int, maturity int, coupon int, barrier int, currency string, strike int"


def _products(n=60):
    draw = random.Random(4)
    some = lambda *x: draw.choice(x)
    return [(i, some("a", "b"), some("x", None, "x", "x"), 1, some(1, 2, None), some(1, None), some(1, 2), some("CHF", "EUR"), some(None, None, 3)) for i in range(n)]


def _alike(a, b):
    return a[0] != b[0] and None not in a[1:4] and a[1:4] == b[1:4]


def test_unique_attributes_without_broadcast(spark):
    """Tables that Spark judges by a small file are as large as the subsets of attributes make them."""
    rows = _products()
    out = Q.unique_attributes(spark.createDataFrame(rows, PRODUCT))
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    want = {}
    for p in rows:
        rivals, said = [q for q in rows if _alike(p, q)], ["issuer", "type", "underlyings"]
        for i, a in enumerate(Q.ATTRS, 4):
            left = [q for q in rivals if q[i] == p[i]]
            if p[i] is not None and len(left) < len(rivals):
                rivals, said = left, [*said, a]
        want[p[0]] = (said, len(rivals)) if p[2] else (None, None)
    assert {r.doc_id: (r.attrs, r.n_rivals) for r in out.collect()} == want


def test_disambiguation_without_pairs(spark):
    """One base of 20,000 products; and the same as by pairs, where products say several values and quotes are wrong."""
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("issuer"), F.lit("x").alias("type"), F.lit(1).alias("underlyings"))
    facts = many.select("doc_id", F.lit("f").alias("field"), F.when(F.col("doc_id") == 7, "b").otherwise("c").alias("value"), F.lit(True).alias("quote_ok"))
    out = Q.disambiguation(facts, many, many.select("doc_id", F.array().cast("array<string>").alias("attrs")), ["f"])
    assert out.count() == 20_000
    draw, rows = random.Random(5), _products()
    said = [(p[0], f, draw.choice(["1", "2", "1", None]), draw.random() < 0.8) for p in rows for f in "fgh" for _ in range(draw.choice([1, 1, 2]))]
    used = [(p[0], draw.choice([[], ["f"], ["g", "h"]])) for p in rows]
    got = Q.disambiguation(spark.createDataFrame(said, "doc_id int, field string, value string, quote_ok boolean"), spark.createDataFrame(rows, PRODUCT), spark.createDataFrame(used, "doc_id int, attrs array<string>"), ["g", "f", "h"])
    want = set()
    for p, (_, attrs) in zip(rows, used, strict=True):
        ok = [f for f in "gfh" if f not in attrs and any(s[0] == p[0] and s[1] == f and s[2] and s[3] and any(_alike(p, q) and t[0] == q[0] and t[1] == f and t[2] and t[2] != s[2] for q in rows for t in said) for s in said)]
        want |= {(p[0], f, i + 1) for i, f in enumerate(ok[:2])}
    assert set(map(tuple, got.collect())) == want


def test_sibling_counts(spark):
    rows = _products()
    want = {p[0]: n for p in rows if (n := sum(_alike(p, q) for q in rows))}
    assert {r.doc_id: r.n for r in Q.sibling_counts(spark.createDataFrame(rows, PRODUCT)).collect()} == want
    assert Q.sibling_counts(spark.createDataFrame([], PRODUCT)).count() == 0
