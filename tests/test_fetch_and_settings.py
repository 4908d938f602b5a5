"""Polite fetching, settings, hashes and review rules."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lanternrow.operators import config, drafting, review
from lanternrow.sources import files
from lanternrow.sources.fetch import Robots, fetch, host_of

YAML = """
seed: 7
gold: g.jsonl
parsed_dir: p
checkpoint: c
arms: [oracle, pageindex]
navigators: [n1, n2]
answerers: [a]
judge: j
models: {a: {}}
splits: [dev, test]
"""


def test_robots():
    text = "# all\nUser-agent: *\nDisallow: /private\nAllow: /private/open\nDisallow: /*.zip$\n\nUser-agent: other\nUser-agent: lantern\nDisallow: /\nAllow: /ok # fine\n"
    star, own = Robots(text, "someone"), Robots(text, "Lanternrow/1")
    assert [star.allow(f"https://h{p}") for p in ("/", "/private", "/private/x", "/private/open/y", "/a.zip", "/a.zip?x")] == [True, False, False, True, False, True]
    assert [own.allow(f"https://h{p}") for p in ("", "/ok/a", "/a")] == [False, True, False]
    assert Robots("", "x").allow("https://h/") and Robots("User-agent: *\nDisallow:", "x").allow("https://h/")


def test_fetching_keeps_pace_and_pins(spark, tmp_path):
    sha = lambda b: "sha256:" + hashlib.sha256(b).hexdigest()
    rows = [
        ("a1", "https://A.example/1", None, False), ("a2", "https://a.example/2", sha(b"%PDF 2"), False), ("a3", "https://a.example/3", sha(b"other"), False), ("a4", "https://a.example/4", "", True),
        ("a5", "https://a.example/no/5", None, False), ("b1", "http://u@b.example:81/1", None, False), ("b2", "http://b.example:81/404", None, False), ("b3", "http://b.example:81/html", None, False), ("c", None, None, False),
    ]
    requests = spark.createDataFrame(rows, "doc_id string, url string, sha256 string, manual boolean")
    log = str(tmp_path / "log")

    def get(row):
        with open(log, "a") as f:
            f.write(row["url"] + "\n")
        return (404, b"") if "404" in row["url"] else (200, b"<html>" if "html" in row["url"] else b"%PDF " + row["url"][-1].encode())

    got = {r.doc_id: r for r in fetch(requests.filter("url is not null"), get, lambda host: "User-agent: *\nDisallow: /no", b"%PDF", 3.0).collect()}
    assert {k: (r.status, r.reason) for k, r in got.items()} == {
        "a1": ("fetched", None), "a2": ("fetched", None), "a3": ("failed", "sha256 mismatch"), "a4": ("failed", "manual document: download it by hand"), "a5": ("failed", "robots.txt disallows it"),
        "b1": ("fetched", None), "b2": ("failed", "HTTP 404"), "b3": ("failed", "not a document of the kind"),
    }
    # robots.txt is a host's first request
    assert [got[k].at for k in ("a1", "a2", "a3", "b2", "b3", "b1")] == [3.0, 6.0, 9.0, 3.0, 6.0, 9.0] and got["a4"].at is None
    assert got["a2"].sha256 == sha(b"%PDF 2") and bytes(got["a2"].body) == b"%PDF 2" and got["a3"].body is None
    assert len(open(log).readlines()) == 6
    hosts = spark.createDataFrame(rows, requests.schema).select(host_of(F.col("url")).alias("h")).distinct().collect()
    assert {r.h for r in hosts} == {"a.example", "b.example:81", None}


def test_settings():
    c = config.RunConfig.of(YAML)
    assert c.splits == ("dev", "test") and c.max_evidence_words == 9000
    assert c.grid({"oracle": False, "pageindex": True}) == [("oracle", "none", "a"), ("pageindex", "n1", "a"), ("pageindex", "n2", "a")]
    with pytest.raises(ValueError, match="colour"):
        config.RunConfig.of(YAML + "colour: red\n")
    assert config.checked_arms(["oracle"], c) == ["oracle"]
    with pytest.raises(ValueError, match="raptor"):
        config.checked_arms(["oracle", "raptor"], c)


def test_canonical_json(spark):
    given = [{"b": [1, {"z": 1, "a": None}], "a": "x \"y\" \\ z", "hostname": "h", "created_at": 5}, {}, {'q"k': True, "A": 1.5, "a": -3}]
    rows = [(i, json.dumps(g, indent=2)) for i, g in enumerate(given)] + [(9, "no"), (10, "[1]"), (11, None)]
    df = spark.createDataFrame(rows, "i int, j string").select("i", config.canonical_json(F.col("j")).alias("c"), config.manifest_hash(F.col("j")).alias("m")).collect()
    want = {i: json.dumps(g, sort_keys=True, separators=(",", ":")) for i, g in enumerate(given)}
    assert {r.i: r.c for r in df if r.c} == want and all(r.c is None for r in df if r.i > 8)
    stable = {k: v for k, v in given[0].items() if k not in config.VOLATILE}
    assert df[0].m == "sha256:" + hashlib.sha256(json.dumps(stable, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_review_rules(spark):
    a = spark.createDataFrame([("date_list", " 2026-01-01;x,\n y "), ("exact", " v "), ("unanswerable", "z"), ("date_list", "")], "k string, t string").select(review.parse_answer(F.col("k"), F.col("t")).alias("a")).collect()
    assert [tuple(r.a) for r in a] == [(None, ["2026-01-01", "x", "y"]), ("v", None), (None, None), (None, [])]
    rows = spark.createDataFrame([(1, ["1", "2", "3", " 4 "]), (2, ["1", "2", "3"]), (3, ["a", "b", "c", "4.5"]), (4, ["a", "b", "c", "1 000", "e"])], "page_id int, cells array<string>")
    assert {r.page_id: r.number for r in files.priced_rows(rows).collect()} == {1: 4, 4: 1000}
    kind = "qid string, doc_ids array<string>, evidence array<struct<doc_id: string, page: int>>"
    odd = drafting.foreign_evidence(spark.createDataFrame([("a", ["d"], [("d", 1), ("e", 2), ("e", 3)]), ("b", ["d"], [])], kind)).collect()
    assert [tuple(r) for r in odd] == [("a", "e")]
