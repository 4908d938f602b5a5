"""Quality classifier over averaged word and character n-gram vectors.

A text's features are its words (runs without bytes 0x20, 0x09-0x0D) and its byte 3- and 4-grams
and whether it repeats one of the two words before it, each hashed to one of BUCKETS learned vectors. The vectors are averaged per text and go through a
softmax over two classes. Vectors and softmax are trained by plain stochastic gradient descent in
numpy on a bounded sample of labelled rows (per_class of each label), then the outputs are
calibrated on a fifth of the sample that the descent didn't see. For scoring, each bucket's vector
is projected on the difference of the two output rows once, so a text costs a sum over its buckets.

Whole texts are scored. Null and empty texts have no features; their score is that of the bias.
With labels of one kind only, every score is that label. No row is dropped, repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from .sampling import labelled_sample
from .words import SPACED, Texts, slices

PER_CLASS = 2000
BITS, SIZE, EPOCHS, RATE = 18, 8, 4, 0.5
BUCKETS = 1 << BITS
THRESHOLD = 0.3
#: Features of weight nothing that every text has besides its own, so that few features say little.
FEW = 20
_U32 = np.uint32


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of each feature of each row, in no order."""
    words = texts.words(SPACED)
    hashes = words.hashes()
    of = np.repeat(np.arange(len(texts), dtype=np.int32), words.counts())
    # of a word's place in its trigram: whether it stands there twice, in a bucket for each pattern
    same = np.zeros(len(of), np.int32)
    same[1:] += (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    same[2:] += 2 * ((hashes[2:] == hashes[:-2]) & (of[2:] == of[:-2]))
    out = [(hashes >> np.uint64(64 - BITS)).astype(np.int32), same]
    rows = [of, of]
    data = texts.data.astype(_U32)
    n = len(data)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(texts.offsets))
    if n >= 3:
        three = data[: n - 2] * _U32(0x9E3779B1) + data[1 : n - 1] * _U32(0x85EBCA77) + data[2:] * _U32(0xC2B2AE3D)
        ok = owner[: n - 2] == owner[2:]
        out.append(((three ^ (three >> _U32(15))) * _U32(0x2C1B3C6D) >> _U32(32 - BITS)).astype(np.int32)[ok])
        rows.append(owner[: n - 2][ok])
        if n >= 4:
            four = three[: n - 3] * _U32(0x27D4EB2F) + data[3:] * _U32(0x165667B1)
            ok = owner[: n - 3] == owner[3:]
            out.append(((four ^ (four >> _U32(15))) * _U32(0x297A2D39) >> _U32(32 - BITS)).astype(np.int32)[ok])
            rows.append(owner[: n - 3][ok])
    return np.concatenate(out), np.concatenate(rows)


class QualityModel:
    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight, bias

    def scores(self, texts: Texts) -> np.ndarray:
        bucket, row = features(texts)
        total = np.bincount(row, self.weight[bucket], len(texts))
        count = np.bincount(row, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(self.bias + total / (count + FEW), -30, 30)))


def _bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Different buckets of each text, with their shares."""
    out = []
    for _, _, part in slices(pa.array(texts, pa.large_string())):
        bucket, row = features(part)
        order = np.argsort(row, kind="stable")
        ends = np.searchsorted(row[order], np.arange(len(part) + 1))
        for i in range(len(part)):
            u, n = np.unique(bucket[order[ends[i] : ends[i + 1]]], return_counts=True)
            out.append((u, (n / (n.sum() + FEW)).astype(np.float32)))
    return out


def fit(texts: list[str], labels: list[int], seed: int = 7) -> QualityModel:
    if len(set(labels)) < 2:
        return QualityModel(np.zeros(BUCKETS, np.float32), 30.0 if 1 in labels else -30.0)
    bags = _bags(texts)
    y = np.array(labels)
    unseen = np.arange(len(y)) % 5 == 0
    if len(set(y[~unseen])) < 2 or len(set(y[unseen])) < 2:
        unseen[:] = False
    own = np.flatnonzero(~unseen)
    balance = np.array([0.5 / max((y[own] == v).sum(), 1) for v in (0, 1)]) * len(own)
    draw = np.random.default_rng(seed)
    vectors = ((draw.random((BUCKETS, SIZE), np.float32) - 0.5) / SIZE).astype(np.float32)
    out, bias = np.zeros((2, SIZE), np.float32), np.zeros(2, np.float32)
    steps, step = EPOCHS * len(own), 0
    for _ in range(EPOCHS):
        for i in draw.permutation(own).tolist():
            rate, step = RATE * (1 - step / steps), step + 1
            u, share = bags[i]
            mean = share @ vectors[u] if len(u) else np.zeros(SIZE, np.float32)
            z = out @ mean + bias
            p = np.exp(z - z.max())
            error = (p / p.sum() - (np.arange(2) == y[i])) * balance[y[i]]
            back = (error @ out).astype(np.float32)
            out -= rate * np.outer(error, mean).astype(np.float32)
            bias -= (rate * 0.1 * error).astype(np.float32)
            if len(u):
                # the step of a bucket is scaled up by the sample's usual number of buckets, as shares are small
                vectors[u] -= (rate * 20) * np.outer(share, back)
    weight, offset = vectors @ (out[1] - out[0]), float(bias[1] - bias[0])
    held = np.flatnonzero(unseen) if unseen.any() else own
    x = np.array([share @ weight[u] if len(u) else 0.0 for u, share in (bags[i] for i in held)]) + offset
    t, w = y[held].astype(float), np.array([0.0, 1.0])
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hess = (design * (p * (1 - p))[:, None]).T @ design + np.eye(2) * 0.02
        w += np.linalg.solve(hess, design.T @ (t - p) - 0.02 * (w - [0.0, 1.0]))
    return QualityModel((weight * w[1]).astype(np.float32), float(w[0] + w[1] * offset))


def train(docs: DataFrame, labels: DataFrame, train_rows: Column | None = None, label: str = "quality", per_class: int = PER_CLASS) -> QualityModel:
    return fit(*labelled_sample(docs, labels, label, train_rows, per_class))


def score_documents(docs: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, score (probability of label 1), predicted."""
    source = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("__text"))
    schema = StructType([source.schema["doc_id"], StructField("n_bytes", LongType()), StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in slices(batch.column(1)):
                score = model.scores(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(texts.offsets), pa.int64()), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=schema.names)

    return source.mapInArrow(run, schema)
