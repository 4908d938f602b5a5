"""Benchmark decontamination by canonical templates; DataFrame functions only.

A text becomes a template: words in lower case, with numbers, units after a number, and names
(capitalised words inside a sentence) replaced by typed placeholders, word for word. Every window
of WINDOW template words of an item is hash-joined with every such window of the documents that can
hold it. A window is also met by its loose template, where capitalised words that begin a sentence
or a line are names too, and by its plain words, without case and punctuation: names are told by
case, so a copy in other case has other templates. Marks inside words part them, but an item is also
tried as if they weren't there. Hits are grouped by document, item and alignment (document position
less item position); an alignment counts only if its slots are consistent, that is, each of the
item's slot values stands for one value of the document. A document holds an item if at least
`least` of the item's different windows are met in consistent alignments: verbatim or with other
numbers, names and units.

Screen: a document that holds an item misses at most n - ceil(least * n) of its n windows, so it
meets one of any n - ceil(least * n) + 1 of them, and has that window's literal words in their
places. A pair of such words of each of so many windows goes into a Bloom filter, and
only documents with a pair that it knows are cut into windows. The filter decides nothing else.

Items of fewer than WINDOW words are one window of their own length, met anywhere; a benchmark of
single common words thus finds them in most documents. Windows with fewer than LITERALS words that
aren't placeholders don't count, unless an item has no others, which then are met by their plain
words alone: so are items of one word. Null and empty texts meet nothing, null and empty items are met
by nothing, an empty benchmark leaves every document clean. Rows that repeat a doc_id share its
verdict; each keeps its row.

The item side is broadcast only while its windows number at most BROADCAST_ROWS; beyond, the join
shuffles both sides by window hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored, without

WINDOW, LEAST, LITERALS = 5, 0.8, 2
BROADCAST_ROWS = 500_000
#: 64-bit words of the Bloom filter of the items' word pairs: about one a pair, within bounds, as it is part of the plan; and its bits a pair.
FILTER_WORDS, FILTER_BITS = (1 << 6, 1 << 16), 3

#: Units that may follow a number.
UNITS = "mm|cm|dm|m|km|mg|g|kg|t|ml|cl|l|s|ms|min|h|hz|khz|mhz|ghz|w|kw|mw|v|a|k|c|f|pa|kpa|bar|j|kj|cal|kcal|eur|usd|gbp|chf|euro|euros|dollar|dollars|pound|pounds|cent|cents|percent|second|seconds|minute|minutes|hour|hours|day|days|week|weeks|month|months|year|years|meter|meters|metre|metres|kilometer|kilometers|kilometre|kilometres|mile|miles|foot|feet|inch|inches|yard|yards|gram|grams|kilogram|kilograms|tonne|tonnes|liter|liters|litre|litres|degree|degrees"


def _cut(text: Column) -> Column:
    """Words in lower case joined by one space; points and commas stay only between digits."""
    # two plain passes: one alternation under a plus would recurse on long runs of marks
    bare = F.regexp_replace(F.lower(text), r"(?<!\p{N})[.,]|[.,](?!\p{N})", " ")
    return F.trim(F.regexp_replace(bare, r"[^\p{L}\p{M}\p{N}@.,]+", " "))


def raw_words(text: Column) -> Column:
    """Words in lower case joined by one space; numbers are one word, names begin with @, other capitalised words with @@."""
    named = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=[\p{Ll}\p{N},;:)] )\p{Lu}[\p{L}]*", "@$0")
    return _cut(F.regexp_replace(named, r"(?<![@\p{L}\p{M}\p{N}])\p{Lu}\p{L}*", "@@$0"))


def template_words(raw: Column, loose: bool = False) -> Column:
    """raw_words with placeholders, as many words: <n> numbers, <u> units, <p> names; if loose, of all capitalised words."""
    out = F.regexp_replace(raw, r"(?<![^ ])\p{N}[^ ]*", "<n>")
    out = F.regexp_replace(out, r"(?<![^ ])@[^ ]+" if loose else r"(?<![^ ])@(?!@)[^ ]+", "<p>")
    return F.regexp_replace(F.replace(out, F.lit("@"), F.lit("")), rf"(?<=<n> )(?:{UNITS})(?![^ ])", "<u>")


def plain_words(raw: Column) -> Column:
    """raw_words without marks, as many words."""
    return F.replace(F.translate(raw, "@.,", ""), F.lit("ß"), F.lit("ss"))


def _windows(df: DataFrame, key: str, text: str, lengths: list[int], *more: str) -> DataFrame:
    """key, at, raw (the window's words), hash, loose, plain of each window of each of the lengths, and more."""
    forms = {"raw": F.col("raw"), "hash": template_words(F.col("raw")), "loose": template_words(F.col("raw"), loose=True), "plain": plain_words(F.col("raw"))}
    words = df.select(F.col(key).alias("key"), raw_words(F.col(text)).alias("raw"), *more).select("key", *(F.split(c, " ").alias(n) for n, c in forms.items()), *more)
    size, none = F.size("raw"), F.array().cast("array<int>")
    # a text without words splits into one empty word
    starts = {k: F.when((size >= k) & (F.get("raw", F.lit(0)) != ""), F.sequence(F.lit(0), size - k)).otherwise(none) for k in lengths}

    def cut(k: int) -> Column:
        return F.transform(starts[k], lambda i: F.struct(i.alias("at"), F.slice("raw", i + 1, k).alias("raw"), *(F.xxhash64(F.slice(n, i + 1, k)).alias(n) for n in ("hash", "loose", "plain"))))

    every = F.concat(*(cut(k) for k in lengths)) if len(lengths) > 1 else cut(lengths[0])
    return words.select("key", F.explode(every).alias("w"), *more).select("key", "w.*", *more)


def item_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """item_id, form (0 as it is, 1 without marks inside words), item_at, size, hash, by (the hashes that meet it), item_raw, n_windows (different ones of the form), pair (gap and plain words of its probe)."""
    bare = F.regexp_replace(text, r"(?<=[\p{L}\p{M}\p{N}])[^\p{L}\p{M}\p{N}\s]+(?=[\p{L}\p{M}\p{N}])", "")
    forms = benchmark.select(F.col(item_id).alias("item_id"), F.posexplode(F.array_distinct(F.array(F.col(text), bare))).alias("form", "text"))
    forms = forms.filter(raw_words(F.col("text")) != "").withColumn("size", F.least(F.lit(window), F.size(F.split(raw_words(F.col("text")), " "))))
    rows = _windows(forms, "item_id", "text", list(range(1, window + 1)), "form", "size").filter(F.size("raw") == F.col("size"))
    rows = rows.select(F.col("key").alias("item_id"), "form", F.col("at").alias("item_at"), "size", "hash", "loose", "plain", F.col("raw").alias("item_raw"))
    joined = F.array_join("item_raw", " ")
    literal = lambda loose: F.transform(F.split(template_words(joined, loose), " "), lambda w: ~w.rlike("^<[nup]>$"))
    rows = rows.withColumns({"strict": literal(False), "free": literal(True)})
    count = lambda c: F.size(F.filter(c, lambda x: x))
    rows = rows.withColumns({"literal": count("strict") >= LITERALS, "open": count("free") >= LITERALS})
    total = rows.groupBy("item_id", "form").agg(F.countDistinct(F.when(F.col("literal"), F.col("hash"))).alias("literals"), F.countDistinct("hash").alias("all"))
    rows = rows.join(total, rows["item_id"].eqNullSafe(total["item_id"]) & (rows["form"] == total["form"])).drop(total["item_id"], total["form"])
    rows = rows.filter("literal or literals = 0").withColumn("n_windows", F.when(F.col("literals") > 0, F.col("literals")).otherwise(F.col("all")))
    by = F.array_distinct(F.filter(F.array(F.when(F.col("literal"), F.col("hash")), F.when(F.col("literal") & F.col("open"), F.col("loose")), "plain"), lambda h: h.isNotNull()))
    # of the words that all ways to meet the window have in common, the longest near pair
    common = F.when(~F.col("literal"), F.transform("strict", lambda x: F.lit(True))).when(F.col("open"), F.col("free")).otherwise(F.col("strict"))
    shown = F.split(plain_words(joined), " ")
    # words with marks inside stand for themselves in no other cut of a text
    common = F.zip_with(common, "item_raw", lambda c, w: c & w.rlike("^@{0,2}[^@.,]+$"))
    rows = rows.withColumns({"common": common, "shown": shown})
    pairs = [
        F.when(F.element_at("common", i + 1) & F.element_at("common", j + 1), F.struct(F.lit(i - j).alias("near"), (F.length(F.element_at("shown", i + 1)) + F.length(F.element_at("shown", j + 1))).alias("long"), F.element_at("shown", i + 1).alias("a"), F.element_at("shown", j + 1).alias("b")))
        for i in range(window) for j in range(i + 1, window)
    ]
    # a place beyond a short window is null there
    best = F.array_max(F.filter(F.array(*(F.when(F.size("shown") > j, p) for p, j in zip(pairs, (j for i in range(window) for j in range(i + 1, window)), strict=True))), lambda p: p.isNotNull()))
    # a single word stands beside itself
    own = F.element_at("shown", 1)
    alone = F.when((F.col("size") == 1) & F.element_at("common", 1), F.struct(F.lit(0).alias("near"), F.length(own).alias("long"), own.alias("a"), own.alias("b")))
    return rows.select("item_id", "form", "item_at", "size", "hash", by.alias("by"), "item_raw", "n_windows", F.coalesce(best, alone).alias("pair"))


def _probes(items: DataFrame, least: float) -> DataFrame:
    """gap, a, b: word pairs of as many windows of each item as a document that holds it can't miss all; a null gap tells that an item hasn't so many."""
    one = items.groupBy("item_id", "form", "hash", "n_windows").agg(F.max("pair").alias("pair"))
    nth = F.row_number().over(Window.partitionBy("item_id", "form").orderBy(F.desc_nulls_last("pair"), "hash"))
    few = one.withColumn("nth", nth).filter(F.col("nth") <= F.col("n_windows") - F.ceil(F.lit(least) * F.col("n_windows") - 1e-9) + 1)
    return few.select((-F.col("pair.near")).alias("gap"), "pair.a", "pair.b").distinct()


def _bits(h: Column, words: int) -> list[Column]:
    """Places of a pair's bits in a filter of so many words, a power of two."""
    return [F.shiftrightunsigned(F.xxhash64(h, F.lit(i)), 59 - words.bit_length()) for i in range(FILTER_BITS)]


def _screen(items: DataFrame, least: float, text: Column) -> Column:
    """Whether a document can hold any item."""
    probes = stored(_probes(items, least), "probes")
    gaps = sorted((r[0] for r in probes.select("gap").distinct().collect()), key=lambda g: (g is not None, g))  # at most WINDOW
    if None in gaps:
        return F.lit(True)
    n = min(FILTER_WORDS[1], max(FILTER_WORDS[0], 1 << probes.count().bit_length()))
    place = probes.select(F.explode(F.array(*_bits(F.xxhash64("gap", "a", "b"), n))).alias("p"))
    held = [0] * n
    one = F.expr("shiftleft(1L, cast(p & 63 as int))")
    for w, v in place.groupBy(F.shiftright("p", 6).cast("int").alias("w")).agg(F.bit_or(one)).collect():  # at most n rows
        held[w] = v
    table = F.from_json(F.lit(str(held)), "array<bigint>")

    def known(h: Column) -> Column:
        out = F.lit(True)
        for p in _bits(h, n):
            out = out & (F.getbit(F.get(table, F.shiftright(p, 6).cast("int")), (p.bitwiseAND(63)).cast("int")) == 1)
        return out

    def hit(words: Column) -> Column:
        out = F.lit(False)
        for gap in gaps:
            later = F.slice(words, gap + 1, F.greatest(F.size(words) - gap, F.lit(0)))
            out = out | F.exists(F.zip_with(words, later, lambda a, b: F.xxhash64(F.lit(gap), a, b)), known)
        return out

    # probes have letters and digits only, so the cut may be coarser; bound as a lambda's variable, a text is cut once
    coarse = F.split(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{M}\p{N}]+")
    return F.exists(F.array(coarse), hit)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document and item that it holds: doc_id, item_id, n_met, n_windows, reparameterised."""
    items = stored(item_windows(benchmark), "items")
    lengths = sorted(r[0] for r in items.select("size").distinct().collect()) or [WINDOW]
    near = docs.filter(_screen(items, least, F.col(text)))
    wide = items.select("item_id", "form", "item_at", "hash", "item_raw", "n_windows", F.explode("by").alias("by"))
    side = F.broadcast(wide) if wide.count() <= BROADCAST_ROWS else wide
    rows = _windows(near, doc_id, text, lengths).select("key", "at", F.col("raw").alias("doc_raw"), F.explode(F.array_distinct(F.array("hash", "loose", "plain"))).alias("by"))
    hits = rows.join(side, "by").select("key", "item_id", "form", (F.col("at") - F.col("item_at")).alias("shift"), "hash", "item_raw", "n_windows", "doc_raw")
    # words that differ under one template are slots, those alike need no check but for being taken twice
    pairs = F.arrays_zip(F.col("item_raw").alias("i"), F.col("doc_raw").alias("d"))
    slots = F.filter(F.transform(pairs, lambda p: F.struct(plain_words(p["i"]).alias("i"), plain_words(p["d"]).alias("d"), p["i"].rlike("^[@\\p{N}]").alias("slot"))), lambda p: (p["i"] != p["d"]) | p["slot"])
    slots = F.transform(slots, lambda p: F.struct(p["i"].alias("i"), p["d"].alias("d")))
    lined = hits.select("key", "item_id", "form", "shift", "hash", "n_windows", slots.alias("slots")).groupBy("key", "item_id", "form", "shift").agg(
        F.collect_set("hash").alias("met"), F.max("n_windows").alias("n_windows"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots")
    )
    lined = lined.filter(F.size(F.array_distinct(F.transform("slots", lambda p: p["i"]))) == F.size("slots"))
    changed = F.exists("slots", lambda p: p["i"] != p["d"])
    found = lined.select("key", "item_id", "form", "n_windows", "met", changed.alias("changed")).groupBy("key", "item_id", "form").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("met")))).cast("long").alias("n_met"), F.max("n_windows").alias("n_windows"), F.max("changed").alias("reparameterised")
    )
    found = found.filter(F.col("n_met") >= F.lit(least) * F.col("n_windows"))
    # of an item's forms, the one as it is comes first
    best = found.groupBy("key", "item_id").agg(F.min(F.struct("form", "n_met", "n_windows", "reparameterised")).alias("r"))
    return best.select(F.col("key").alias("doc_id"), "item_id", "r.n_met", "r.n_windows", "r.reparameterised")


def verdicts(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, contaminated, n_items, item_ids (sorted)."""
    found = contaminated(docs, benchmark, least, doc_id, text).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    rows = docs.select(F.col(doc_id).alias("doc_id"))
    out = rows.join(found, rows["doc_id"].eqNullSafe(found["doc_id"]), "left").drop(found["doc_id"])
    return out.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce(F.size("item_ids").cast("long"), F.lit(0)).alias("n_items"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents that hold an item; columns as they are."""
    return without(docs, contaminated(docs, benchmark, least, doc_id, text).select("doc_id"), doc_id)
