"""Operator 4: quality classifier, naive Bayes support vectors.

Indicators of word and word-shape n-grams are scaled by their class log-count
ratios; a linear hinge-loss model is fitted on them by dual coordinate descent.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, discard, written

BITS = 18
#: At most this many labelled rows, those with the smallest hash of their id, are learned from.
SAMPLE = 6000
#: Of each, the distinct indicators in whole: 4 bytes each, and at most this many in all; rows past that, by hash, are left out.
INDICATORS = 30_000_000
WORDS_KEPT = 200_000
_SHAPES = [(re.compile(r"\d+"), "9"), (re.compile(r"[^\W\d_a-z]{2,}(?![a-z])"), "W"), (re.compile(r"[^\W\d_]+"), "w")]


def _codes(word: str) -> tuple[int, int]:
    """Hashes of a word and of its shape: letters, capitals and digits reduced to runs."""
    shape = word
    for p, to in _SHAPES:
        shape = p.sub(to, shape)
    return zlib.crc32(word.encode()), zlib.crc32(b"s" + shape.encode())


class Features:
    """Indices of the distinct n-gram indicators of texts."""

    def __init__(self):
        self.words = Recent(_codes, WORDS_KEPT)
        self.seen = np.zeros(1 << BITS, np.int64)

    def __call__(self, text: str) -> np.ndarray:
        words = text.split()
        if not words:
            return np.zeros(0, np.int64)
        w, s = np.array([self.words[x] for x in words], np.uint64).T
        mix = np.uint64(0x9E3779B97F4A7C15)
        grams = [w, s]
        if len(w) > 1:
            grams += [w[:-1] * mix + w[1:], s[:-1] * mix + s[1:] + np.uint64(1)]
            grams.append(np.full(int((w[:-1] == w[1:]).any()), 7, np.uint64))  # a bigram of one word twice
        if len(w) > 2:
            grams.append((s[:-2] * mix + s[1:-1]) * mix + s[2:])
        i = (np.concatenate(grams) * mix >> np.uint64(64 - BITS)).astype(np.int64)
        order = np.arange(len(i))
        self.seen[i] = order
        return i[self.seen[i] == order]


def fit(rows: list[tuple[np.ndarray, int]], alpha: float = 1.0, c: float = 1.0, epochs: int = 20) -> tuple[np.ndarray, float]:
    """Weights (scaled back to raw indicators) and bias of the NB-scaled linear SVM."""
    size = 1 << BITS
    counts = np.full((2, size), alpha)
    for x, y in rows:
        counts[y, x] += 1
    r = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    w, bias = np.zeros(size), 0.0
    n = [max(1, sum(1 for _, y in rows if y == k)) for k in (0, 1)]
    cost = [c * len(rows) / (2 * n[k]) for k in (0, 1)]  # the classes weigh alike
    data = [(x, v := _unit(r[x]), v @ v + 1.0, 2 * y - 1, cost[y]) for x, y in rows if len(x)]
    dual, rng = np.zeros(len(data)), np.random.default_rng(0)
    for _ in range(epochs):
        most = 0.0
        for k in rng.permutation(len(data)):
            x, v, q, y, top = data[k]
            new = min(max(dual[k] - (y * (w[x] @ v + bias) - 1) / q, 0.0), top)
            if d := new - dual[k]:
                w[x] += d * y * v
                bias += d * y
                dual[k] = new
                most = max(most, abs(d))
        if most < 1e-3:
            break
    return np.stack([r, w]).astype(np.float32), bias


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.sqrt(v @ v)
    return v / n if n else v


def score(model: tuple[np.ndarray, float], x: np.ndarray) -> float:
    (r, w), bias = model
    m = float(w[x].astype(float) @ _unit(r[x].astype(float))) + bias
    return float(1 / (1 + np.exp(-np.clip(2 * m, -50, 50))))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """Fit on at most ``sample`` rows of ``labels`` (doc_id, quality 0 or 1) that have a document,
    and on no more than INDICATORS of them in all, in the order of the ids' hashes.

    Labels that are null or neither 0 nor 1, and null ids, are not learned from; of
    documents with one id the least text is; a label that repeats counts each time,
    and one of each kind for an id counts as both.  A null text counts as empty.  An
    empty table, or one class alone, gives a model without evidence.  Whole texts,
    of any length.
    """
    ids = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").select("doc_id", F.col("quality").cast("int").alias("y"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)

    def featured(batches):
        f = Features()
        for b in batches:
            x = [f(t or "").astype(np.int32) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.int32())), b.column(1), b.column(2)], names=["x", "y", "doc_id"])

    # ids has at most ``sample`` rows, and a document's copies under one id are one
    kind = docs.schema["doc_id"].dataType.simpleString()
    named = docs.select("doc_id", "text").join(F.broadcast(ids.select("doc_id").distinct()), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    table = named.join(F.broadcast(ids), "doc_id").select("text", "y", "doc_id").mapInArrow(featured, f"x array<int>, y int, doc_id {kind}")
    table = written(table.withColumn("h", F.xxhash64("doc_id")), "indicators")
    held, last = 0, None
    for r in sorted(table.select("h", F.size("x").alias("n")).collect()):
        held += r["n"]
        if held > INDICATORS:
            break
        last = r["h"]
    rows = table.filter(F.col("h") <= F.lit(last)).toArrow()
    discard(table)
    rows = sorted(zip(rows["doc_id"].to_pylist(), [np.asarray(x.values) for x in rows["x"]], rows["y"].to_pylist(), strict=True), key=lambda t: (t[0], t[2], len(t[1])))
    if not rows:
        return np.zeros((2, 1 << BITS), np.float32), 0.0
    return fit([(x.astype(np.int64), y) for _, x, y in rows])


def score_quality(docs: DataFrame, model) -> DataFrame:
    """``doc_id, score, predicted`` of every row; whole texts, of any length.

    A null or empty text scores as the bias alone; ids may be null or repeat;
    other columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB whatever the input

    def run(batches):
        f, m = Features(), shared.value
        for b in batches:
            s = np.array([score(m, f(t or "")) for t in b.column(1).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
