"""Mixing, alignment of tokenizers and the filter audit against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import collections
import hashlib
import itertools
import json
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, size long, key string, part string, n int, row long, target double"
GAP = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    """(doc_id, text, lang, source) and columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, 7, "k", "p", 1, 5, 0.5) for r in rows], SCHEMA)


# mixing


def goals(sizes):
    """Targets of {source: size}, by resharing until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, capped = Fraction(3, 2) * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        if not free:
            return {s: 2 * sizes[s] for s in names}
        level = (total - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in capped else level * weight[s] for s in names}
        capped |= over


@pytest.mark.parametrize("key_digits", [32, 1])
def test_mix(spark, key_digits):
    from lanternrow.llm.mix import mix

    r = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(r.choice([0, 1, 7, 40, 300]))), "en", r.choice(["b", "a", "a", "a", "Z", "é", "\U0001f600", "￿", None])) for i in range(600)]
    rows += [(None, None, None, None), (1, "", "en", "only empty"), *[(5, "again and again", "en", "twin")] * 41, (9, "x " * 50_000, "en", "one long")]
    got = mix(table(spark, rows), key_digits=key_digits).collect()
    size = lambda t: len(GAP.findall(t or ""))
    sizes, most, kept = collections.Counter(), collections.Counter(), collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += size(t)
        most[s] = max(most[s], size(t))
    want = goals(dict(sizes))
    by_size = collections.defaultdict(set)
    for s in sizes:
        by_size[sizes[s]].add(s)
    assert sorted((x.doc_id is None, x.doc_id or 0, x["size"]) for x in got) == sorted((i is None, i or 0, size(t)) for i, t, _, _ in rows)
    for x in got:
        assert x.taken in (0, x["size"], 2 * x["size"])
        assert any(abs(x.target - float(want[s])) < 1e-6 for s in by_size[x.source_size])
    assert len({v for v in sizes.values() if v}) == len([v for v in sizes.values() if v])
    for x in got:
        kept[x.source_size] += x.taken
    for s, n in sizes.items():
        if n:
            assert abs(kept[n] - want[s]) <= Fraction(most[s], 2), s
    # 41 rows that agree in source, doc_id and text are told apart
    assert len({x.taken for x in got if x.source_size == sizes["twin"]}) <= 2
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, mix(table(spark, rows).repartition(7), key_digits=key_digits).collect())) or key_digits == 1


def test_mix_of_nothing(spark):
    from lanternrow.llm.mix import mix

    assert mix(table(spark, []).limit(0)).collect() == []
    got = mix(table(spark, [(1, None, "en", "a"), (2, " ", "en", "b")])).collect()
    assert [(x["size"], x.target, x.taken) for x in got] == [(0, 0.0, 0)] * 2
    with pytest.raises(ValueError):
        mix(table(spark, []), share=3, most=2)


def test_mix_draws_are_nested(spark):
    from lanternrow.llm.mix import mix

    docs = table(spark, [(i, "w " * (1 + i % 9), "en", "a") for i in range(500)])
    taken = [{x.doc_id for x in mix(docs, share=s, most=1).collect() if x.taken} for s in (0.2, 0.5, 0.9)]
    assert taken[0] < taken[1] < taken[2]


# alignment


def brute(texts):
    """The contract's columns by loops over tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    from lanternrow.llm.bpe import byte_characters

    back = {c: i for i, c in enumerate(byte_characters())}
    bytes_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    rows, holds = [], collections.Counter()
    for t in texts:
        ids_a = a.encode(" " + (t or ""), add_special_tokens=False).ids
        ids_b = b.encode(t or "")
        bytes_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
        spelled = (" " + (t or "")).encode()
        if not t or b"".join(bytes_a) != spelled or b"".join(map(bytes_b, ids_b)) != spelled:
            rows.append((0, 0, [], collections.Counter()))
            continue
        ends_a, ends_b = list(itertools.accumulate(map(len, bytes_a))), list(itertools.accumulate(len(bytes_b(i)) for i in ids_b))
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, low = [], 0
        for c in cuts:
            groups.append(([i for i, e in zip(ids_a, ends_a, strict=True) if low < e <= c], [i for i, e in zip(ids_b, ends_b, strict=True) if low < e <= c]))
            low = c
        links = collections.Counter((x, y) for g, h in groups for x in g for y in h)
        holds.update(set(links))
        rows.append((len(ids_a), len(ids_b), groups, links))
    best = collections.defaultdict(int)
    for (x, _), n in holds.items():
        best[x] = max(best[x], n)
    out = []
    for n_a, n_b, groups, links in rows:
        shown = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((n_a, n_b, len(groups), sum(links.values()), sum(n for (x, y), n in links.items() if holds[x, y] == best[x]), sum(n * holds[p] for p, n in links.items()), hashlib.sha256(shown.encode()).hexdigest() if shown else ""))
    return out


TEXTS = [
    None, "", " ", "  ", "\n", "a", "Hello world", "Hello  world ", " led", "ends ", "<|endoftext|> and </s> <unk> <0x41>", "under▁score", "naïve café Straße", "漢字 と かな", "🙂🙃 emoji 🙂", "\x1c\x85odd spaces　",
    "tabs\tand\r\nlines\n\n", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "Hello world", "ﬁ ligature Å Å", "؀ؐ عربى", "x" * 3000, "=" * 700 + "-" * 300,
]


def test_align(spark, monkeypatch):
    from lanternrow.llm import align

    r = random.Random(8)
    texts = TEXTS + ["".join(r.choice("ab cdé \n.,'19Ω▁字") for _ in range(r.randrange(1, 60))) for _ in range(150)] + [" ".join(r.choice(["the", "Haus", "niño", "xqz", "don't", "2,000"]) for _ in range(400))]
    rows = [(i if i % 11 else None, t, "en", "s") for i, t in enumerate(texts)]
    docs = table(spark, rows)
    want = collections.Counter((d, *x) for (d, *_), x in zip(rows, brute(texts), strict=True))
    a, b = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    # all pairs broadcast, some, none
    for most in (1_000_000, 100, 0):
        got = align.align(docs, a, b, most=most)
        assert got.columns == columns
        assert collections.Counter(map(tuple, got.collect())) == want, most
    assert align.align(docs.limit(0), a, b).collect() == []


def test_align_in_blocks(monkeypatch):
    from lanternrow.llm import align

    r = random.Random(4)
    texts = ["".join(r.choice("ab cdé \n字") for _ in range(300)) for _ in range(20)] + TEXTS
    paths = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    whole = [c.to_pylist() for c in align._align(texts, *paths)]
    monkeypatch.setattr(align, "BLOCK", 5)
    monkeypatch.setattr(align, "WIDE", 3)
    assert [c.to_pylist() for c in align._align(texts, *paths)] == whole


def test_each_token_is_what_its_bytes_merge_to():
    """So merging by ranks gives the ids that merging by the file's list gives."""
    from tokenizers import Tokenizer, pre_tokenizers

    path = P.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    plain.pre_tokenizer = pre_tokenizers.Sequence([])
    vocabulary = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
    assert all(e.ids == [i] for e, i in zip(plain.encode_batch_fast(list(vocabulary), add_special_tokens=False), vocabulary.values(), strict=True))


# the audit


def audit(rows, labels):
    first, marks, masks = {}, collections.defaultdict(lambda: (0, 0)), collections.defaultdict(list)
    for i, q, t in labels:
        marks[i] = (max(marks[i][0], q == 1), max(marks[i][1], t == 1))
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, t, part, _ in rows:
        t = t or ""
        w = GAP.findall(t)
        failed = "".join(f for f, x in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), re.search("[#$%&*|]", t), i is not None and i > first[t]), strict=True) if x)
        masks[part or ""].append((failed, *(marks[i] if i is not None else (0, 0))))
    out = []
    for part, docs in masks.items():
        shapley = collections.Counter()
        own = []
        for order in itertools.permutations("ABCDE"):
            left = docs
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                redundant = sum(f in d[0] for d in docs) - len(gone)
                shapley[f] += len(gone)
                own.append((f, part, "".join(order), k + 1, len(left), len(gone), redundant, sum(d[0] == f for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)))
        out += [(*x[1:], shapley[x[0]]) for x in own]
    return sorted(out)


def test_audit(spark):
    from lanternrow.llm.audit import interactions

    r = random.Random(6)
    rows = []
    for i in range(200):
        t = r.choice(["", " \t", "w#", "ABC", " ".join(r.choice(["Xy", "z", "$", "É", "q\x0bv"]) for _ in range(150)), " ".join(f"w{r.randrange(4000)}" for _ in range(r.choice([99, 100, 130]))), None])
        rows.append((i if i % 9 else None, t, r.choice(["en", "de", "", None]), "s"))
    rows += [(5, "same words " * 60, "en", "s")] * 7 + [(4, "same words " * 60, "de", "s"), (5, "other words " * 60, "fr", "s"), (None, "same words " * 60, "en", "s")] + [(900, "l " * 200_000, "fr", "s")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 150, 2)] + [(5, 1, 0), (5, 0, 1), (None, 1, 1)]
    got = interactions(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("t")))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == audit(rows, labels)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interactions(table(spark, []).limit(0), none).collect() == []
    assert sorted(map(tuple, interactions(table(spark, rows[:3]), none).collect())) == audit(rows[:3], [])


# routing of exact deduplication


def test_rows_find_their_answers_by_slot_and_bucket(spark):
    """Owner tasks hold whole buckets, and a directory that leads elsewhere finds nothing."""
    from dataclasses import replace

    from lanternrow.llm.exact import indexed

    rows = [(i, f"text {i % 60}", "en", "s") for i in range(200)]
    entries, index = indexed(table(spark, rows).repartition(5), capacity=4, hash_bits=5)
    n = index.slots.select("bucket").distinct().count()
    assert n > 4 and index.slots.count() == 1 << index.depth
    # a bucket lies in one file, its keys in order, chains from 0
    files = index.buckets.withColumn("f", F.input_file_name()).groupBy("bucket").agg(F.count_distinct("f").alias("files"))
    assert {r.files for r in files.collect()} == {1}
    assert all(r.most == r.n - 1 for r in index.buckets.groupBy("bucket", "hash").agg(F.max("chain").alias("most"), F.count("*").alias("n")).collect())
    right = {r.row: (r.keep_id, r.group_size) for r in index.find(entries, 200).collect()}
    assert len(right) == 200 and all(v[1] in (3, 4) for v in right.values())
    wrong = replace(index, slots=index.slots.withColumn("bucket", (F.col("bucket") + 1) % n))
    assert wrong.find(entries, 200).count() == 0
    half = replace(index, slots=index.slots.withColumn("bucket", F.when(F.col("slot") % 2 == 0, F.col("bucket")).otherwise(-1)))
    assert 0 < half.find(entries, 200).count() < 200
