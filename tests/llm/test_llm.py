"""The llm operators against brute force, exact round trips and held-out labels, with nulls, ties and clashing columns."""

import collections
import hashlib
import io
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, n_words int"


def table(spark, texts, start=0):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(None if t is KEYLESS else i, None if t is KEYLESS else t, "en", "s", 1, 0.5, "k", 3) for i, t in enumerate(texts, start)], SCHEMA)


KEYLESS = object()


def sentence(r, n, vocabulary):
    return " ".join(r.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    v = [f"w{i}" for i in range(3000)] + ["heor", "orhe", "é", "Straße"]
    out = [None, "", " \t\n", "one", "one two three", "One  two\tthree", "one two three", KEYLESS]
    base = [sentence(r, r.choice([5, 6, 40, 80, 300]), v) for _ in range(25)]
    for b in base:
        out.append(b)
        w = b.split()
        for _ in range(r.choice([0, 1, 3])):
            x = w[:]
            for _ in range(r.choice([0, 1, 2, max(1, len(w) // 12)])):
                x[r.randrange(len(x))] = r.choice(v)
            out.append(r.choice([" ", "\n", "  "]).join(x))
        if r.random() < 0.4 and len(w) >= 60:
            out.append(sentence(r, 20, v) + " " + " ".join(w[3:55]) + " " + sentence(r, 9, v))
    out += ["For " * 90, "a b " * 60, sentence(r, 20_000, v)]
    return out


def low(t):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split() if t is not KEYLESS else []


def test_words_and_anagrams():
    import pyarrow as pa

    from lanternrow.llm.words import SPACED, slices

    (_, _, t), = slices(pa.array(["heor orhe heor", None, "a\x0bb\x1c"]))
    w = t.words(SPACED)
    h = w.hashes().tolist()
    assert w.counts().tolist() == [3, 0, 2] and h[0] != h[1] and h[0] == h[2]


def test_bpe(spark, texts):
    import base64

    tiktoken = pytest.importorskip("tiktoken")
    from lanternrow.llm.bpe import encode_column

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    more = ["<|endoftext|> it's 12 345", "\x1c\x85  x", "日本語 🙂 ñ", "A" * 3000, *texts]
    want = []
    for t in more:
        t = t if isinstance(t, str) else ""
        ids = own.encode_ordinary(t)
        want.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = encode_column(table(spark, more), path, P.PATTERN).collect()
    assert sorted(tuple(r)[1:] for r in got) == sorted(want)
    assert encode_column(table(spark, []), path, P.PATTERN).count() == 0


def test_exact(spark, texts):
    from lanternrow.llm.exact import directory, drop_copies, exact_groups

    df = table(spark, texts).unionByName(table(spark, ["twice"], 900)).unionByName(table(spark, ["twice"], 900))
    import re

    norm = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t) if isinstance(t, str) else ""
    groups = collections.defaultdict(list)
    ids = [(None if t is KEYLESS else i, norm(t)) for i, t in enumerate(texts)] + [(900, "twice")] * 2
    for i, t in ids:
        groups[t].append(i)
    least = {t: min((x for x in g if x is not None), default=None) for t, g in groups.items()}
    for bits in (64, 3):
        got = exact_groups(df, capacity=3, hash_bits=bits).collect()
        assert (max(r.chain for r in got) > 3) == (bits == 3) and len({(r.chain, r.text_sha256) for r in got}) == len(groups)
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == sorted((str(i), str(least[t]), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in ids)
        assert sum(r.kept for r in got) == len(groups)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == sorted((str(i), str(least[t]), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in ids)
    assert sum(r.kept for r in got) == len(groups)
    named = df.withColumns({c: F.lit(1) for c in ("__sha", "__id", "__text", "__gone", "hash", "sha", "norm", "kept", "keep_id", "text_sha256", "copy", "docs", "row")})
    for d in (df, named):
        kept = drop_copies(d)
        assert kept.columns == d.columns and kept.count() == len(groups)
    assert exact_groups(table(spark, [])).count() == 0
    assert directory({0: 3, 1: 3, 2: 1, 3: 1}, 4, 2) == (2, [(0, 2), (1, 2), (1, 1)])


def test_substring(spark, texts):
    from lanternrow.llm.substring import removal

    spaced = [(t.encode().split() if isinstance(t, str) else []) for t in texts]
    seen = collections.Counter(tuple(w[k : k + 35]) for w in spaced for k in range(len(w) - 34))
    want = []
    for w in spaced:
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        want.append((len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    got = removal(table(spark, texts)).collect()
    assert sorted(tuple(r)[1:] for r in got) == sorted(want) and any(0 < w[1] < w[0] for w in want)
    assert removal(table(spark, [])).count() == 0


def test_fingerprint_log_is_incremental(spark):
    from lanternrow.llm.substring import FingerprintLog

    log, seen = FingerprintLog(spark, fan=2), set()
    for batch in ([1, 2, 2, 3], [3, 4], [5], [1, 4, 6, 6]):
        hits = {r.fp for r in log.add(spark.createDataFrame([(x,) for x in batch], "fp long")).collect()}
        assert hits == {x for x in batch if x in seen or batch.count(x) > 1}
        seen |= set(batch)
        assert len(log.runs) <= 2
    log.drop()


def test_jaccard(spark, texts):
    from lanternrow.llm.jaccard import drop_linked, jaccard_components

    sets = []
    for t in texts:
        w = low(t)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    part = list(range(len(texts)))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                part[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(table(spark, texts)).collect() if r.doc_id is not None}
    assert got == {i: (len(sets[i]), root(i)) for i, t in enumerate(texts) if t is not KEYLESS}
    assert any(root(i) != i for i in range(len(texts)))
    assert drop_linked(table(spark, texts)).count() == len({root(i) for i in range(len(texts))})
    assert jaccard_components(table(spark, [])).count() == 0


def test_jaccard_blocks_and_chunks(spark, texts, monkeypatch):
    from lanternrow.llm import jaccard as J

    df = table(spark, [t for t in texts if t is not KEYLESS])
    want = sorted(map(tuple, J.jaccard_components(df).collect()), key=str)
    monkeypatch.setattr(J, "BLOCK", 2)
    monkeypatch.setattr(J, "TILE_SHINGLES", 50)
    assert sorted(map(tuple, J.jaccard_components(df).collect()), key=str) == want


def test_components(spark):
    from lanternrow.llm.components import components

    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    part = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            part[a] = part[b] = min(part[a], part[b])
    assert {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == part
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_long_chains(spark):
    from lanternrow.llm.components import components

    n, rounds = 5000, []
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = [(i, i + 1) for i in range(n - 1)] + [(n + a, n + b) for a, b in zip(order, order[1:])]
    got = components(spark.createDataFrame(edges, "a long, b long"), rounds).groupBy("component").count().collect()
    assert {(r.component, r["count"]) for r in got} == {(0, n), (n, n)} and len(rounds) <= 12


def test_warc_round_trip(spark, tmp_path):
    from lanternrow.llm import warc as W

    big = "<p>" + "x" * 1200 + "</p>"
    rows = [(1, "http://a/ b\r\n", big), (2, None, big), (3, "u", "small"), (4, "v", "small"), (5, "w", None), (6, "x", "é" * 600), (None, "y", "z"), (9, "q", "t" * 100_000)] + [(i, "u", f"<html>{i} page text number {i * 7}</html>" * 9) for i in range(20, 60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in W.round_trip(pages, payload=True).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert r.record_type == "revisit" or bytes(r.payload) == data
    assert (got[1].record_type, got[1].refers_to, got[2].record_type, got[3].record_type) == ("revisit", 2, "response", "response")
    assert W.round_trip(spark.createDataFrame([], pages.schema)).count() == 0


def test_warc_revisits_by_shuffle(spark, monkeypatch):
    from lanternrow.llm import warc as W

    rows = [(i, f"u{i}", "<p>" + str(i % 4) * 1200) for i in range(300)] + [(i, "u", "hot " * 400) for i in range(300, 400)] + [(400 + i, None, "small") for i in range(9)] + [(None, None, None)] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(tuple, W.with_revisits(pages).collect()), key=str)
    monkeypatch.setattr(W, "BROADCAST_FIRSTS", 0)
    for hot in (1, 5, 1000):
        monkeypatch.setattr(W, "HOT", hot)
        assert sorted(map(tuple, W.with_revisits(pages).collect()), key=str) == want
    assert {x[3] for x in want} == {None, 299, 298, 297, 296, 399}


def test_warc_validation():
    import struct

    from lanternrow.llm import warc as W

    samples = [W.record_bytes(i, "u", f"<html><body>{i} some words {i * i}</body></html>".encode() * 20, None) for i in range(200)]
    made = W.train_dictionary(samples)
    out = io.BytesIO()
    w = W.ArchiveWriter(out, made)
    for s in samples:
        w.write(s)
    data = out.getvalue()
    assert struct.unpack("<I", data[:4])[0] == W.SKIPPABLE and list(W.read_archive(io.BytesIO(data), 777)) == samples
    for bad in (data[:-3], data[:100], data[: len(made) + 50] + b"xx" + data[len(made) + 52 :]):
        with pytest.raises(ValueError):
            list(W.read_archive(io.BytesIO(bad)))
    good = W.record_bytes(1, "u", b"abc", None)
    assert W.parse_record(good)["payload"] == b"abc"
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WORC/1.1"), good.replace(b"abc", b"abd"), good.replace(b"WARC-Date: ", b"WARC-Dote: "), good + b"x"):
        with pytest.raises(ValueError):
            W.parse_record(bad)


def test_licences(spark, texts):
    import re

    from lanternrow.llm import license_scan as L

    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    more = [mit, mit.replace("hereby ", ""), "x UNDER the MIT-License; under the mit license", "Apache License, Version 2.0", "CC BY NC cc by nc", "Licensed under CC BY-NC 4.0.", "Copyright 2020 Some Body. All rights reserved", "understand the mit license", *texts]
    want = []
    for t in more:
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.encode().lower()) if isinstance(t, str) else []
        base = [(i, label) for p, label in L.PHRASES.items() for i in range(len(w)) if w[i : i + len(q := p.encode().split())] == q]
        want.append((len(w), len(base), min((i for i, _ in base), default=None), max((i for i, _ in base), default=None), ",".join(sorted({x for _, x in base}))))
    got = L.scan_licences(table(spark, more)).collect()
    assert sorted(((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == sorted(want, key=str)
    labels = {r.doc_id: r.labels for r in got}
    assert (labels[0], labels[1], labels[3], labels[5], labels[6]) == ("mit", "", "apache-2", "cc-by-nc", "all-rights-reserved")
    assert all(set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1 for r in got)
    a = L.Automaton("alpha beta <<beginOptional>>gamma <<beginOptional>>delta <<endOptional>><<endOptional>>end <<var;name=x;most=2>> stop")
    assert [a.match(s.encode().split(), 0) for s in ("alpha beta end stop", "alpha beta gamma end a b stop", "alpha beta gamma delta end stop", "alpha beta delta end stop", "alpha beta end a b c stop", "alpha beta end a b c", "alpha beta end a stop b stop")] == [4, 7, 6, None, 7, None, 5]


def test_licence_regions(spark):
    import time

    from lanternrow.llm import license_scan as L

    holder = "Copyright (c) 1989, 1990, 1991, 1992, 1993, 1994 The Regents of the University of California and others. "
    bsd = dict(L.TEMPLATES)["bsd"].split("<<beginOptional>><<beginOptional>>3")[0].replace("<<beginOptional>>", "").replace("<<endOptional>>", "")
    texts = [holder + "All rights reserved", "copyright here\n\nnothing; all rights reserved", "Copyright a. All rights reserved. b all rights reserved", bsd, bsd.replace("binary forms must reproduce", "binary forms should reproduce").replace("source code must", "source code may"), "copyright all " * 40_000, "copyright all rights reserved " * 20_000]
    began = time.time()
    got = {r.doc_id: r for r in L.scan_licences(table(spark, texts)).collect()}
    assert time.time() - began < 60
    assert [got[i].labels for i in range(6)] == ["all-rights-reserved", "", "all-rights-reserved", "bsd", "", ""] and got[2].spans.startswith("0-5:") and len(got[6].spans.split()) == 20_000

    def brute(parts, words):
        """Whether a template of words and regions (None) matches from the front, by trying all."""
        if not parts:
            return True
        if parts[0] is None:
            return any(brute(parts[1:], words[k:]) for k in range(len(words) + 1))
        return bool(words) and words[0] == parts[0] and brute(parts[1:], words[1:])

    r = random.Random(8)
    for _ in range(300):
        parts = [b"a", *(r.choice([b"a", b"b", None]) for _ in range(r.randrange(1, 5)))]
        words = [r.choice([b"a", b"b", b"c"]) for _ in range(r.randrange(1, 9))]
        template = " ".join("<<var;name=x>>" if x is None else x.decode() for x in parts)
        assert (L.Automaton(template).match(words, 0) is not None) == brute(parts, words), (template, words)


def test_decontamination(spark):
    from lanternrow.llm.decontam import drop_contaminated, verdicts

    items = [(1, "The train from Paris travels 120 km in 2 hours and then 120 km more, how fast is it going on average"), (2, "three short words"), (3, None), (4, ""), (5, "a question about something else entirely that nobody has copied anywhere at all"), (1, "The train from Paris travels 120 km in 2 hours and then 120 km more, how fast is it going on average")]
    fill = "nothing to see here, only words that fill the line. "
    docs = [
        fill + items[0][1] + " " + fill,  # verbatim
        fill + "The train from Berlin travels 90 miles in 3 hours and then 90 miles more, how fast is it going on average",  # other slots
        fill + "The train from Berlin travels 90 miles in 3 hours and then 80 miles more, how fast is it going on average",  # one slot, two values
        "three short words", "three short words more", fill * 3, None, "", "the train from", KEYLESS,
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.contaminated, list(r.item_ids)) for r in verdicts(table(spark, docs), bench).collect()}
    assert {i for i, v in got.items() if v[0]} == {0, 1, 3, 4} and got[0][1] == [1] and got[3][1] == [2] and len(got) == len(docs)
    kept = drop_contaminated(table(spark, docs), bench)
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" double", "").replace(" int", "").split(", ") and kept.count() == len(docs) - 4
    assert not any(r.contaminated for r in verdicts(table(spark, docs), bench.limit(0)).collect()) and verdicts(table(spark, []), bench).count() == 0


def test_decontamination_in_other_case_and_without_punctuation(spark):
    from lanternrow.llm.decontam import verdicts

    item = "In 1990 Tom's well-known aunt Ada Berg, of Graz, paid 1,250.50 EUR; then Max (her son) paid 40 EUR more to Eva Holm in Bonn"
    bare = "".join(c for c in item if c.isalnum() or c == " ")
    docs = ["so it was. " + t + " and on it went" for t in (item, item.upper(), item.title(), item.lower(), bare, bare.upper())] + ["so it was. in 1990 the aunt paid more to eva"]
    got = [r.doc_id for r in verdicts(table(spark, docs), spark.createDataFrame([(1, item)], "item_id long, text string")).filter("contaminated").collect()]
    assert sorted(got) == [0, 1, 2, 3, 4, 5]


def test_decontamination_templates(spark):
    from lanternrow.llm.decontam import raw_words, template_words

    df = spark.createDataFrame([("In Rome 3.5 kg, 7 of Tom's 1,000 EUR. Then",)], "t string").select(raw_words(F.col("t")).alias("r"))
    r, t = df.select("r", template_words(F.col("r"))).first()
    assert r == "@@in @rome 3.5 kg 7 of @tom s 1,000 @eur @@then" and t == "in <p> <n> <u> <n> of <p> s <n> <p> then"


def reparameterised(r, n):
    """Items with names (also first in a sentence or line), numbers and units, and copies of them with others."""
    plain = [f"w{x}{y}" for x in "abcdefghij" for y in "klmnopqrst"]
    items, copies = [], []
    for _ in range(n):
        text, twin, names = [], [], [("Anna", "Olaf"), ("Bruno", "Petra"), ("Clara", "Quinn")]
        for line in range(3):
            a, b = names[line], names[(line + 1) % 3]
            k, m, w = r.randrange(10, 99), r.randrange(100, 999), [r.choice(plain) for _ in range(12)]
            make = lambda j: f"{a[j]} {' '.join(w[:6])} {(k, m)[j]} {('km', 'miles')[j]} {' '.join(w[6:])} to {b[j]}."  # noqa: B023, E731
            text.append(make(0)), twin.append(make(1))
        items.append("\n".join(text)), copies.append("\n".join(twin))
    return items, copies


def test_decontamination_by_brute_force(spark, monkeypatch):
    import re

    from lanternrow.llm import decontam as D

    r = random.Random(6)
    items, copies = reparameterised(r, 30)
    items += ["Just Four plain words", "two words", "12 34 56 78 90 11", "a_b c.d", "ab ab ab ab ab ab ab"]
    v = [f"w{x}{y}" for x in "abcdefghij" for y in "klmnopqrst"]
    fill = lambda: " ".join(r.choice(v) for _ in range(40)) + "."
    docs = [f"{fill()} {t}\n{fill()}" for t in items + copies] + [fill() * 2 for _ in range(20)]
    for t in items[:30]:
        w = t.split()
        for gone in (2, 4, 6, 9, 14):
            x = w[:]
            for _ in range(gone):
                x[r.randrange(len(x))] = "zzz"
            docs.append(fill() + " " + " ".join(x))
    docs += ["two words", "Two: words!", "two words more", "!" * 100_000, "b c.d a b c d", "1,5 " * 30_000, None, "", "ab " * 50, "we saw a SOLITARY, thing", "pi is 3.14 or so"]
    df, bench = table(spark, docs), spark.createDataFrame([*enumerate(items), (98, "3.14"), (99, "Solitary")], "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.n_met, x.n_windows) for x in D.contaminated(df, bench).collect()}
    # plain wording, counted by hand: each of these must be found
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    for j, t in enumerate(items[:30]):
        w = words(t)
        wanted = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        for i, d in enumerate(docs):
            x = words(d)
            held = len(wanted & {tuple(x[k : k + 5]) for k in range(len(x) - 4)})
            assert ((i, j) in got) >= (held >= 0.8 * len(wanted)) and ((i, j) not in got or i < 65 or held >= 0.5 * len(wanted)), (i, j)
    assert sum((30 + 5 + j, j) in got for j in range(30)) >= 27
    assert {(i, j) for i, j in got if j >= 30} >= {(30, 30), (32, 32), (33, 33), (34, 34)} and not any(j < 30 and 65 <= i < 85 for i, j in got)
    n = len(docs) - 11
    # items of one and two words are found inside texts, in any case
    assert {i for i, j in got if j == 31} == {31, n, n + 1, n + 2} and (n + 8, 34) in got
    assert {i for i, j in got if j == 99} == {n + 9} and {i for i, j in got if j == 98} == {n + 10}
    # the screen loses nothing
    monkeypatch.setattr(D, "_screen", lambda *a: F.lit(True))
    assert {(x.doc_id, x.item_id): (x.n_met, x.n_windows) for x in D.contaminated(df, bench).collect()} == got


def test_maximal_segments_by_brute_force():
    from lanternrow.llm.toxicity import maximal_segments

    def brute(values):
        def rec(a, b):
            best = max(((sum(values[i:j]), i - j, -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
            if best is None or best[0] <= 0:
                return []
            i, j = best[3], best[4]
            return rec(a, i) + [(i, j - 1, best[0])] + rec(j, b)

        return rec(0, len(values))

    r = random.Random(2)
    for _ in range(200):
        n = r.randrange(1, 14)
        values = [r.choice([-1.0, r.randint(1, 4) + r.random() / 97]) for _ in range(n)]
        at = [i for i, v in enumerate(values) if v > 0]
        got = [(a, b, round(s, 6)) for a, b, s in maximal_segments(at, [values[i] for i in at], 1.0)]
        assert got == [(a, b, round(s, 6)) for a, b, s in brute(values)]


def labelled(r, n):
    v = [f"word{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(n):
        toxic, good = i % 4 == 0, i % 5 > 1
        w = [r.choice(v) for _ in range(r.randrange(20, 60))]
        if toxic:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(["nastyone", "nastytwo", "viper"])
        docs.append(" ".join(w) if good else "!! ".join(x.upper() for x in w))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


def test_classifiers(spark):
    from lanternrow.llm import quality, toxicity

    docs, labels = labelled(random.Random(1), 500)
    docs += [None, "", "x" * 50_000]
    df, lab = table(spark, docs), spark.createDataFrame(labels + [(0, 1, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    train = F.col("doc_id") % 3 != 0
    truth = {i: (q, t) for i, q, t in labels} | {0: (1, 1)}
    for module, which, least in ((toxicity, 1, 0.9), (quality, 0, 0.95)):
        got = module.score_documents(df, module.train(df, lab, train, per_class=150)).collect()
        assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
        held = [r for r in got if r.doc_id in truth and r.doc_id % 3 == 0]
        assert sum(r.predicted == truth[r.doc_id][which] for r in held) / len(held) >= least
        assert module.score_documents(df, module.train(df, lab.limit(0), train)).count() == len(docs)
    gone = {r.doc_id for r in df.select("doc_id").collect()} - {r.doc_id for r in toxicity.drop_toxic(df, lab).collect()}
    bad = {i for i, (_, t) in truth.items() if t}
    assert len(gone & bad) >= 0.9 * len(bad) and len(gone - bad) <= 3


def test_lm(spark):
    import numpy as np

    from lanternrow.llm import lm

    path = P.path("byte_bpe_multi_50k.tiktoken")
    r = random.Random(4)
    docs = [" ".join(r.choice(["alpha", "beta", "Gamma"]) + r.choice(["", "s"]) for _ in range(r.randrange(1, 90))) for _ in range(60)] + [None, "", "unseen words"]
    df = table(spark, docs)
    rows = {x.doc_id: x for x in lm.score_documents(df, path, F.coalesce(F.col("doc_id") % 5 != 0, F.lit(False))).collect()}
    words = {i: low(t) + [None] for i, t in enumerate(docs)}
    count = collections.Counter(w for i in words if i % 5 for w in words[i])
    n, v = sum(count.values()), len(count)
    for i, w in words.items():
        x = rows[i]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (i % 5 == 0, len(w), sum(count[t] > 0 for t in w), n)
        assert abs(x.base_score - sum(np.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in w)) < 1e-6 and x.score < 0
    assert lm.score_documents(table(spark, []), path, F.col("doc_id") >= 0).count() == 0


def test_lm_learns_from_all_training_texts(spark, monkeypatch):
    import numpy as np

    from lanternrow.llm import lm
    from lanternrow.llm.tables import sampled

    path, train = P.path("byte_bpe_multi_50k.tiktoken"), F.coalesce(F.col("doc_id") > 0, F.lit(False))
    monkeypatch.setattr(lm, "TRAIN_ROWS", 5)
    monkeypatch.setattr(lm, "SHARE", 1)
    r = random.Random(8)
    plain = ["delta echo delta"] + [" ".join(r.choice(["alpha", "beta"]) for _ in range(30)) for _ in range(40)]
    drawn = {int(x) for x in sampled(table(spark, plain).filter(train).withColumn("id", F.col("doc_id").cast("string")), "id", 5, 1 << 20)}
    other = [t if i in drawn or i == 0 else " ".join(r.choice(["delta", "echo"]) for _ in range(30)) for i, t in enumerate(plain)]
    a, b = ({x.doc_id: x.score for x in lm.score_documents(table(spark, t), path, train).collect()} for t in (plain, other))
    assert b[0] > a[0] + 1

    blocks = lm._blocks(table(spark, other + [None]), "doc_id", "text", train, path)
    pieces, pairs, windows = lm.Pieces(path), collections.Counter(), 0
    for t in [*other[1:], ""]:
        ids = [i for w in low(t) for i in np.frombuffer(pieces.known[w], np.uint16).tolist()] + [lm.END]
        pairs.update(zip([lm.END, *ids[:-1]], ids, strict=True))
        windows += -(-len(ids) // lm.STRIDE)
    got = lm.id_pairs(blocks)
    assert {(int(i), int(j)): int(got[i, j]) for i, j in zip(*np.nonzero(got), strict=True)} == pairs
    assert lm.learn(blocks, lm.fit([], pieces, got)) == windows
    # texts of fewer windows than the share give one each
    monkeypatch.setattr(lm, "SHARE", 24)
    assert lm.learn(blocks, lm.fit([], pieces, got)) == len(other)


def test_lm_memory_by_brute_force(spark, monkeypatch, tmp_path):
    import numpy as np

    from lanternrow.llm import lm

    path, r = P.path("byte_bpe_multi_50k.tiktoken"), random.Random(9)
    v = [f"v{i}" for i in range(400)]
    once = [sentence(r, 60, v) for _ in range(60)]
    docs = once + once[:20] + [once[30].upper(), None, "", "v1 v2 v3", "v1 v2 v3 v4", "same " * 200]
    df, train = table(spark, docs), F.coalesce(F.col("doc_id") % 10 != 0, F.lit(False))
    monkeypatch.setattr(lm, "ANCHOR", 1)
    pairs, runs = collections.Counter(), collections.Counter()
    places = {i: [(tuple(w[k : k + 3]), w[k + 3]) for k in range(len(w) - 3)] for i, t in enumerate(docs) for w in [low(t)]}
    for i, own in places.items():
        if i % 10:
            pairs.update(own)
            runs.update(x for x, _ in own)
    # attention and counts are mixed word by word; with K beyond all counts only attention is left
    folder = f"file://{tmp_path}/d"
    lm.dictionary(lm.word_counts(lm._blocks(df, "doc_id", "text", train, path).coalesce(1)), folder).collect()
    got = collections.Counter(tuple(x) for x in spark.read.parquet(folder).filter("next <> 0").groupBy("hash", "next").agg(F.max("c"), F.max("t")).select("max(c)", "max(t)").collect())
    here, held = set().union(*places.values()), {x for i, own in places.items() if i % 10 == 0 for x in own}
    want = collections.Counter((pairs[x], runs[x[0]]) for x in here if runs[x[0]] > 1 or (runs[x[0]] == 1 and x in held and not pairs[x]))
    assert {k: n for k, n in got.items() if k[1] > 1} == {k: n for k, n in want.items() if k[1] > 1} and sum(got.values()) >= sum(want.values())
    a = {x.doc_id: x.score for x in lm.score_documents(df, path, train).collect()}
    monkeypatch.setattr(lm, "K", 1e15)
    b = {x.doc_id: x.score for x in lm.score_documents(df, path, train).collect()}
    gain = {i: a[i] - b[i] for i in a if i is not None}
    # a copy of which neither is learned from tells nothing
    assert min(gain[i] for i in [*range(20), *range(60, 80)] if i % 10) > 20 > max(abs(gain[i]) for i in [*range(20, 60), 0, 60])
    # a text that occurs once lends itself nothing
    assert all(abs(gain[i]) < 1e-6 for i in range(31, 60) if i % 10 and not any(runs[x] > 1 for x, _ in places[i])) and np.isfinite(list(a.values())).all()


def test_lm_gradients_windows_and_normalisation():
    import numpy as np

    from lanternrow.llm import lm

    r = np.random.default_rng(0)
    ids, first = r.integers(0, lm.PIECES, 130), np.array([0, 1, 60])
    x, y, row = lm.windows_of(ids, first)
    assert [np.sort(ids[a:b]).tolist() for a, b in ((0, 1), (1, 60), (60, 130))] == [np.sort(y[row == k][y[row == k] >= 0]).tolist() for k in range(3)]
    model = lm.Attention(np.arange(lm.GROUPS * lm.PLACES))
    total = sum(np.exp(model.log_probs(np.repeat(x[:1], 64, 0), np.tile(np.arange(a, a + 64)[:, None], (1, lm.STRIDE)))[:, 0]).sum() for a in range(0, lm.GROUPS * lm.PLACES, 64))
    assert abs(total - 1) < 1e-3
    for k in model.p:
        model.p[k] = model.p[k].astype(np.float64)
    g = model.gradients(x, y)

    def loss():
        model.ready = None
        for k in model.p:
            model.p[k] = np.asarray(model.p[k])
        return -model.log_probs(x, y)[y >= 0].astype(np.float64).mean()

    for name, at in (("q", (int(x[2, 12]), 1)), ("k", (int(x[2, 12]), 1)), ("v", (int(x[2, 12]), 2)), ("own", (int(x[2, 12]), 3)), ("mix", (1, 1)), ("far", (3,)), ("group", (2, 2))):
        old = model.p[name][at]
        model.p[name][at] = old + 0.05
        up = loss()
        model.p[name][at] = old - 0.05
        down = loss()
        model.p[name][at] = old
        assert abs((up - down) / 0.1 - g[name][at]) < 2e-4 + 0.05 * abs(g[name][at]), name


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are absent")
def test_pipeline(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in c.STAGES:
        before = docs
        docs = c.stored(stage(spark, docs, SF), "test")
        if name != c.STAGES[-1][0]:
            assert docs.columns == columns and docs.exceptAll(before).count() == 0
    assert docs.count() == before.count() and "doc_id" in docs.columns
    assert c.run(spark, SF).count() == docs.count()


def test_pipeline_on_odd_tables(spark, tmp_path, texts):
    import corpus_pipeline as c

    odd = [t for t in texts if t is not KEYLESS][:40] + ["x " * 100_000, None, "", "twice over", "twice over"]
    names = ("__sha", "gone", "ids", "docs", "score", "hash", "norm", "key", "__text")
    docs = table(spark, odd).unionByName(table(spark, [KEYLESS])).unionByName(table(spark, odd[:3])).drop("score", "key").withColumns({n: F.lit(n) for n in names})
    labels = "doc_id long, quality int, toxic int"
    for case, rows in (("full", docs), ("empty", docs.limit(0))):
        at = f"{tmp_path}/{case}"
        rows.write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(3, 1, 0), (4, 0, 1), (None, 1, 1), (5, None, None), (3, 1, 0)] if case == "full" else [], labels).write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([(1, odd[8]), (2, None), (3, ""), (1, odd[8])] if case == "full" else [], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        kept = spark.read.parquet(f"{at}/documents.parquet")
        for _, stage in c.STAGES[:-1]:
            before, kept = kept, c.stored(stage(spark, kept, at), "odd")
            assert kept.columns == docs.columns and kept.exceptAll(before).count() == 0
        got = c.run(spark, at).collect()
        assert len(got) == kept.count() and (case == "full") == bool(got)
        # document 8 is item 1
        assert 8 not in {r.doc_id for r in got}


def test_stored_sends_bounded_batches(spark):
    import pyarrow as pa

    from lanternrow.llm.tables import BATCH_BYTES, stored

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    texts = spark.range(6000, numPartitions=1).selectExpr("repeat('x', if(id = 7, 10000000, 4000)) AS text")
    got = stored(texts.mapInArrow(run, "n long, size long"), "batches").collect()
    assert sum(r.n for r in got) == 6000 and spark.conf.get(name) == before
    # a row that is longer than the bound is sent all the same
    assert all(r.size < BATCH_BYTES + 11_000_000 for r in got) and sum(r.size <= BATCH_BYTES + 10_000 for r in got) >= len(got) - 1


def test_crc(spark):
    from lanternrow.llm.tables import crc_mod

    got = spark.range(50).select("id", crc_mod("id", 3)).collect()
    assert all(m == zlib.crc32(str(i).encode()) % 3 for i, m in got)
