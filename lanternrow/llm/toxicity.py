"""Toxic passages by maximum-scoring segments over token log-odds.

Fitting: tokens of labelled texts give log-odds of toxic against clean use with an informative
Dirichlet prior (the pooled counts); a token is a word or one of a longer word's first bytes, so
that unseen endings are met. Significant tokens keep their log-odds, weaker ones the lower bound of
theirs, all others cost DRIFT. A linear scan finds every maximal-scoring segment of a text. Segments are judged by extreme-value
statistics: lambda solves E[exp(lambda s)] = 1 for clean tokens, and the location is fitted to the
maxima of clean texts that the log-odds haven't seen. A text's segments of E below 1 add up, and a
logistic curve, fitted on the same unseen texts, turns the sum into a score.

The sample of labelled rows is bounded by per_class rows of each label and by bytes. All of every text is
scanned. Null and empty texts have no segment and get the score of a text without any. With labels
of only one kind, or none, every score is 0. No row is dropped, repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .sampling import labelled_sample
from .words import ALNUM, Texts, Words, mix, releasing, slices

PER_CLASS = 4000
PREFIXES = (4, 5, 6, 7)
#: Prior tokens as a share of all, least log-odds of a significant token, and the cost of any other.
PRIOR, LEAST_ODDS, DRIFT = 0.05, 2.3, 0.25
#: Least lower bound of a weak token's log-odds, and toxic texts that have it.
LEAST_WEAK, LEAST_TEXTS = 1.4, 3
THRESHOLD = 0.7
_U = np.uint64


def token_hashes(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word indices, token hashes) for whole words and for each length of prefix."""
    if not len(words.starts):
        return
    parts, first = words.parts()
    length = words.ends - words.starts
    yield np.arange(len(length)), mix(np.add.reduceat(parts, first))
    long = np.flatnonzero(length > PREFIXES[0])
    total = parts[first[long]].copy()
    for n in range(2, PREFIXES[-1] + 1):
        keep = length[long] > n if n > PREFIXES[0] else slice(None)
        long, total = long[keep], total[keep]
        total = total + parts[first[long] + n - 1]
        if n in PREFIXES and len(long):
            yield long, mix(total + _U(n * 0x51ED270B))


def maximal_segments(at: list[int], value: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring runs as (first, last, score); other places cost drift each. Linear time.

    >>> maximal_segments([0, 1, 9], [2.0, 1.0, 4.0], 1.0)
    [(0, 1, 3.0), (9, 9, 4.0)]
    """
    first, last, low, high, back = [], [], [], [], []
    total, end = 0.0, -1
    for p, v in zip(at, value, strict=True):
        total -= drift * (p - end - 1)
        start, lo = p, total
        total, end = total + v, p
        k = len(first) - 1
        while True:
            while k >= 0 and low[k] >= lo:
                k = back[k]
            if k < 0 or high[k] >= total:
                break
            start, lo = first[k], low[k]
            del first[k:], last[k:], low[k:], high[k:], back[k:]
            k -= 1
        first.append(start), last.append(p), low.append(lo), high.append(total), back.append(k)
    return [(a, b, h - lo) for a, b, lo, h in zip(first, last, low, high, strict=True)]


class ToxicityModel:
    """keys (sorted token hashes) and odds of significant tokens, with the calibration."""

    def __init__(self, keys: np.ndarray, odds: np.ndarray):
        self.keys, self.odds = keys, odds
        self.near = np.zeros(1 << 20, bool)  # cheap screen before the search in keys
        self.near[(keys >> _U(44)).astype(np.int64)] = True
        self.rate, self.location, self.curve = 1.0, 0.0, None

    def word_scores(self, words: Words) -> np.ndarray:
        """Each word's log-odds, the largest of its significant tokens', 0 if it has none."""
        out = np.zeros(len(words.starts))
        if len(self.keys):
            for index, hashes in token_hashes(words):
                hit = np.flatnonzero(self.near[(hashes >> _U(44)).astype(np.int64)])
                where = np.minimum(np.searchsorted(self.keys, hashes[hit]), len(self.keys) - 1)
                same = self.keys[where] == hashes[hit]
                hit, where = hit[same], where[same]
                np.maximum.at(out, index[hit], self.odds[where])
        return out

    def segments(self, texts: Texts) -> tuple[np.ndarray, dict[int, list[tuple[int, int, float]]]]:
        """Words per row, and by row its maximal segments in words of the row."""
        words = texts.lower().words(ALNUM)
        scores = self.word_scores(words)
        hits = np.flatnonzero(scores)
        rows = np.searchsorted(words.rows, hits, side="right") - 1
        found = {}
        for row in np.unique(rows).tolist():
            own = hits[np.searchsorted(rows, row) : np.searchsorted(rows, row, side="right")]
            found[row] = maximal_segments((own - words.rows[row]).tolist(), scores[own].tolist(), DRIFT)
        return words.counts(), found

    def evidence(self, n: int, segments: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
        """The significant segments, with -log of each one's E value (expected in a clean text of n words)."""
        held = ((a, b, self.rate * s - np.log(max(n, 1)) - self.location) for a, b, s in segments)
        return [x for x in held if x[2] > 0]

    def score(self, evidence: list[tuple[int, int, float]]) -> float:
        if self.curve is None:
            return 0.0
        a, b = self.curve
        return float(1 / (1 + np.exp(-np.clip(a + b * np.log1p(sum(x[2] for x in evidence)), -30, 30))))

    def scored(self, texts: Texts) -> list[tuple[int, list[tuple[int, int, float]], float]]:
        counts, found = self.segments(texts)
        out = []
        for row, n in enumerate(counts.tolist()):
            held = self.evidence(n, found.get(row, []))
            out.append((n, held, self.score(held)))
        return out


def _texts(texts: list[str]) -> Iterator[Texts]:
    for _, _, part in slices(pa.array(texts, pa.large_string())):
        yield part


def different(texts: list[str], tries: int = 8) -> list[int]:
    """Indices of texts that share none of `tries` minima of 5-word hashes with an earlier one: near copies teach nothing more."""
    seen, out, i = set(), [], 0
    for part in _texts(texts):
        words = part.lower().words(ALNUM)
        hashes, at = words.windows(words.hashes(), 5)
        row = np.repeat(np.arange(len(part)), words.counts())[at]
        ends = np.searchsorted(row, np.arange(len(part) + 1))
        salted = [mix(hashes ^ _U(0x9E37 * (k + 1))) for k in range(tries)]
        for r in range(len(part)):
            a, b = ends[r], ends[r + 1]
            own = {(k, int(h[a:b].min())) for k, h in enumerate(salted)} if b > a else {texts[i]}
            if not own & seen:
                out.append(i)
            seen |= own
            i += 1
    return out


def log_odds(toxic: list[str], clean: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and log-odds of the significant tokens."""
    tallies = []
    for texts in (toxic, clean):
        sizes, seen = [0] * (len(PREFIXES) + 1), []
        for part in _texts(texts):
            words = part.lower().words(ALNUM)
            row = np.repeat(np.arange(len(part)), words.counts())
            for k, (index, hashes) in enumerate(token_hashes(words)):
                # a token counts once a text, so that a text that repeats it teaches no more
                order = np.lexsort((hashes, row[index]))
                h, r = hashes[order], row[index][order]
                own = np.ones(len(h), bool)
                own[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                u, n = np.unique(h[own], return_counts=True)
                seen.append((u, n))
                sizes[k] += int(own.sum())
        keys = np.concatenate([u for u, _ in seen]) if seen else np.zeros(0, np.uint64)
        u, back = np.unique(keys, return_inverse=True)
        counts = np.bincount(back, np.concatenate([n for _, n in seen]) if seen else None, len(u)) if len(u) else np.zeros(0)
        tallies.append((u, counts, max(sizes[0], 1)))
    (ut, ct, nt), (uc, cc, nc) = tallies
    where = np.minimum(np.searchsorted(uc, ut), max(len(uc) - 1, 0))
    clean_count = np.where(uc[where] == ut, cc[where], 0.0) if len(uc) else np.zeros(len(ut))
    prior, mass = PRIOR * (ct + clean_count), PRIOR * (nt + nc)
    odds = np.log((ct + prior) / (nt + mass - ct - prior).clip(1)) - np.log((clean_count + prior) / (nc + mass - clean_count - prior).clip(1))
    # the root of the likelihood ratio against equal use, where chance alone would reach one in all tokens
    share, both = nt / (nt + nc), ct + clean_count
    ratio = 2 * (ct * np.log(ct / (both * share)) + clean_count * np.log(np.maximum(clean_count, 1e-9) / (both * (1 - share))))
    strong = (odds >= LEAST_ODDS) & (ct > both * share) & (ratio >= 2 * np.log(max(len(ut), 2)))
    # others count by a standard deviation less than their log-odds, if texts enough have them and that is still much
    weak = odds - np.sqrt(1 / (ct + prior) + 1 / (clean_count + prior))
    keep = strong | ((weak > LEAST_WEAK) & (ct >= LEAST_TEXTS))
    return ut[keep], np.where(strong, odds, weak)[keep]


def fit(texts: list[str], labels: list[int]) -> ToxicityModel:
    """The model of labelled texts; calibrated on texts that the log-odds used for them haven't seen."""
    none = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0))
    if len(set(labels)) < 2:
        return none
    pairs = [(texts[i], labels[i]) for i in different(texts)]
    texts, labels = [t for t, _ in pairs], [y for _, y in pairs]
    if len(set(labels)) < 2:
        return none
    # each third is scored by the log-odds of the others; those of all texts are the model's own
    held, y = [], []
    for fold in range(3):
        own, unseen = ([i for i in range(len(texts)) if (i % 3 == fold) == mine] for mine in (False, True))
        part = ToxicityModel(*log_odds([texts[i] for i in own if labels[i]], [texts[i] for i in own if not labels[i]]))
        held += [(n, found.get(r, [])) for t in _texts([texts[i] for i in unseen]) for counts, found in [part.segments(t)] for r, n in enumerate(counts.tolist())]
        y += [labels[i] for i in unseen]
    model, y = ToxicityModel(*log_odds([t for t, v in pairs if v], [t for t, v in pairs if not v])), np.array(y, float)

    # clean tokens' scores: the positive ones as seen (half a token more, for those not yet seen), else -DRIFT
    clean = [h for h, v in zip(held, y, strict=True) if not v]
    tokens = sum(n for n, _ in clean) + 1
    seen = [s for _, found in clean for _, _, s in found]
    mean = float(np.mean(model.odds)) if len(model.odds) else 1.0
    values = np.array([*seen, mean])
    share = np.array([1.0] * len(seen) + [0.5]) / tokens
    rest = 1 - share.sum()
    low, high = 1e-6, 30.0 / max(values.max(), 1.0)
    if rest > 0 and (share * values).sum() < DRIFT * rest:
        for _ in range(80):
            mid = (low + high) / 2
            if (share * np.exp(mid * values)).sum() + rest * np.exp(-DRIFT * mid) < 1:
                low = mid
            else:
                high = mid
        model.rate = low
    top = [model.rate * max((s for _, _, s in found), default=0.0) - np.log(max(n, 1)) for n, found in clean]
    model.location = float(np.mean(top)) - 0.5772156649 if top else 0.0

    x = np.array([np.log1p(sum(e[2] for e in model.evidence(n, found))) for n, found in held])
    w, design = np.zeros(2), np.stack([np.ones_like(x), x], 1)
    weight = np.ones_like(y)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + np.eye(2) * 0.05
        w += np.linalg.solve(hess, design.T @ (weight * (y - p)) - 0.05 * w)
    model.curve = (float(w[0]), float(w[1]))
    return model


def train(docs: DataFrame, labels: DataFrame, train_rows: Column | None = None, label: str = "toxic", per_class: int = PER_CLASS) -> ToxicityModel:
    return fit(*labelled_sample(docs, labels, label, train_rows, per_class))


def score_documents(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_segments, score, predicted, segments (first-last:-log E of each passage, in words)."""
    source = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("__text"))
    schema = StructType([source.schema["doc_id"], StructField("n_words", LongType()), StructField("n_segments", LongType()), StructField("score", DoubleType()), StructField("predicted", IntegerType()), StructField("segments", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in slices(batch.column(1)):
                got = model.scored(texts)
                columns = [pa.array([x[0] for x in got], pa.int64()), pa.array([len(x[1]) for x in got], pa.int64()), pa.array([x[2] for x in got], pa.float64()), pa.array([int(x[2] >= THRESHOLD) for x in got], pa.int32())]
                columns.append(pa.array([" ".join(f"{a}-{b}:{e:.3f}" for a, b, e in x[1]) for x in got], pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns], names=schema.names)

    return source.mapInArrow(releasing(run), schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, train_rows: Column | None = None, text: str = "text", per_class: int = PER_CLASS) -> DataFrame:
    """docs without the rows that are predicted toxic, learned from the labelled rows where train_rows (over doc_id) holds; columns as they are."""
    model = train(docs, labels, train_rows, per_class=per_class)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [x[2] < THRESHOLD for _, _, texts in slices(batch.column(at)) for x in model.scored(texts)]
            if keep:
                yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(releasing(run), docs.schema)
