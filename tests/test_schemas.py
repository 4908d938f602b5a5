"""Schemas as predicates, evidence of both shapes, clustered resampling."""

import re
import json

import pytest
from pyspark.sql import functions as F

from lanternrow.operators import metrics, runs, schemas

SCHEMA = {
    "type": "object", "additionalProperties": False, "required": ["qid", "regime", "failure"],
    "properties": {
        "qid": {"type": "string", "minLength": 1}, "regime": {"enum": ["A", "B", None]}, "schema": {"const": "v1"}, "failure": {"enum": [None, "error"]},
        "recall": {"type": ["number", "null"], "minimum": 0, "maximum": 1}, "calls": {"type": ["integer", "null"], "minimum": 0}, "version": {"type": "string", "pattern": "^\\d{4}-\\d{2}$"},
        "evidence": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["doc_id"], "properties": {"doc_id": {"type": "string"}, "pages": {"type": "array", "items": {"type": "integer", "minimum": 1}}}}},
        "pair_id": {"type": "string"}, "form": {"type": "string"},
    },
    "dependentRequired": {"pair_id": ["form"], "form": ["pair_id"]},
    "if": {"properties": {"regime": {"const": "B"}}, "required": ["regime"]}, "then": {"not": {"required": ["form"]}},
}
GOOD = {"qid": "q", "regime": "A", "failure": None}
CASES = [
    (GOOD, []),
    (GOOD | {"recall": 0.5, "calls": 3, "version": "2026-01", "schema": "v1", "evidence": [{"doc_id": "d", "pages": [1, 2]}], "pair_id": "p", "form": "f"}, []),
    (GOOD | {"recall": None, "calls": None, "regime": None}, []),
    ({"qid": "", "regime": "C"}, ["$ required failure", "$.qid minLength", "$.regime enum"]),
    (GOOD | {"qid": 5}, ["$.qid type"]),
    (GOOD | {"recall": 1.5, "calls": -1}, ["$.calls minimum", "$.recall maximum"]),
    (GOOD | {"calls": 1.5, "recall": "x"}, ["$.calls type", "$.recall type"]),
    (GOOD | {"calls": 2.0}, []),
    (GOOD | {"extra": 1, "more": None}, ["$ additionalProperties"]),
    (GOOD | {"schema": "v2", "version": "26-1"}, ["$.schema const", "$.version pattern"]),
    (GOOD | {"evidence": []}, ["$.evidence minItems"]),
    (GOOD | {"evidence": [{"doc_id": "d", "pages": [1, 0]}, {"pages": ["x"]}, 7]}, ["$.evidence[] required doc_id", "$.evidence[] type", "$.evidence[].pages[] minimum", "$.evidence[].pages[] type"]),
    (GOOD | {"pair_id": "p"}, ["$ pair_id requires form"]),
    (GOOD | {"regime": "B", "pair_id": "p", "form": "f"}, ["$ not (then)"]),
    (GOOD | {"failure": "odd"}, ["$.failure enum"]),
    # words on objects say nothing of a list, so the condition holds and what it forbids does, too
    ([], ["$ not (then)", "$ type"]),
]


def test_each_rule(spark):
    rows = [(i, json.dumps(d)) for i, (d, _) in enumerate(CASES)] + [(100, "not json"), (101, None)]
    found = schemas.violations(spark.createDataFrame(rows, "id int, document string"), SCHEMA, "id")
    got = {}
    for r in found.collect():
        got.setdefault(r.id, []).append(r.rule)
    assert {i: sorted(v) for i, v in got.items()} == {i: w for i, (_, w) in enumerate(CASES) if w} | {100: ["not JSON"], 101: ["not JSON"]}


def test_unknown_words_raise():
    for odd in ({"oneOf": []}, {"properties": {"a": {"format": "date"}}}, {"additionalProperties": True}):
        with pytest.raises(ValueError):
            schemas.rules(odd)


def test_evidence_of_both_shapes(spark):
    rows = [("a", '[["d", 3], {"doc_id": "e", "page": 4, "snippet": "s"}, ["f", "5"], 7, {"page": 1}]'), ("b", "[]"), ("c", None), ("d", '{"doc_id": "x"}')]
    df = spark.createDataFrame(rows, "k string, j string").select("k", runs.evidence_pages(F.try_parse_json("j")).alias("e"))
    got = {r.k: r.e and [tuple(x) for x in r.e] for r in df.collect()}
    assert got == {"a": [("d", 3, None), ("e", 4, "s"), ("f", 5, None)], "b": [], "c": None, "d": None}


def test_clustered_bootstrap(spark):
    from lanternrow.functions.hashing import uniform

    data = [(f"c{i % 7}", i, float(i % 5) + (i % 7)) for i in range(60)] + [(None, 99, 1.0), ("c1", 98, None)]
    rows = spark.createDataFrame(data, "c string, k long, x double")
    got = metrics.clustered_bootstrap(rows, "c", "k", "x", 40, 3, size=16).first()
    kept = [d for d in data if d[0] and d[2] is not None]
    assert (got.n_clusters, got.n_rows) == (7, 60) and abs(got["mean"] - sum(d[2] for d in kept) / 60) < 1e-9

    def poisson(u):
        p, total, k = 0.36787944117144233, 0.36787944117144233, 0
        while u >= total and k < 8:
            k += 1
            p /= k
            total += p
        return k + (u >= total)

    draws = range(1, 41)
    own = {(r.d, r.k): r.u for r in spark.createDataFrame([(d, k) for d in draws for _, k, _ in kept], "d int, k long").withColumn("u", uniform(3, F.lit("row"), F.col("d"), F.col("k"))).collect()}
    outer = {(r.d, r.c): r.u for r in spark.createDataFrame([(d, f"c{i}") for d in draws for i in range(7)], "d int, c string").withColumn("u", uniform(3, F.lit("cluster"), F.col("d"), F.col("c"))).collect()}
    means = []
    for d in draws:
        w = [poisson(own[d, k]) * poisson(outer[d, c]) for c, k, _ in kept]
        if sum(w):
            means.append(sum(a * x for a, (_, _, x) in zip(w, kept, strict=True)) / sum(w))
    means.sort()
    at = lambda q: means[int(q * (len(means) - 1))] + (q * (len(means) - 1) % 1) * (means[min(len(means) - 1, int(q * (len(means) - 1)) + 1)] - means[int(q * (len(means) - 1))])
    assert abs(got.low - at(0.025)) < 1e-9 and abs(got.high - at(0.975)) < 1e-9
    assert tuple(metrics.clustered_bootstrap(rows.limit(0), "c", "k", "x", 40).first()) == (None, 0, 0, None, None)


def test_clustered_bootstrap_shuffles_draws_only(spark):
    """No exchange is by cluster and draw, whose pairs grow with both."""
    rows = spark.range(50).select((F.col("id") % 5).alias("c"), F.col("id").alias("k"), F.col("id").cast("double").alias("x"))
    plan = metrics.clustered_bootstrap(rows, "c", "k", "x", 40)._jdf.queryExecution().executedPlan().toString()
    by = re.findall(r"hashpartitioning\(([^)]*)", plan)
    assert any(x.startswith("d#") for x in by) and not any("c#" in x and "d#" in x for x in by)
