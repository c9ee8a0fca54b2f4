"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown level by level on binned statistics with numpy, and kept as flat arrays (one row per tree, children
of node i at 2i+1 and 2i+2), so that a batch of documents walks all trees by array indexing.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import as_bytes, batch, fold, map_batches, sample_by_hash, table

#: At most so many labelled documents are learned from: those whose id has the smallest hash.
SAMPLE = 20_000
BINS, TREES, DEPTH, RATE, L2, LEAST = 64, 80, 4, 0.12, 2.0, 8

STATS = (
    "log_bytes log_words word_len letters upper digits marks symbols spaces newlines distinct_words top_word "
    "distinct_pairs repeated_lines line_words ends_plain longest_word entropy bangs pipes word_marks stops caps_words"
).split()

_KIND = np.zeros(256, np.int8)
for _c in range(256):
    _KIND[_c] = (
        1 if 97 <= _c <= 122 or _c >= 128 else 2 if 65 <= _c <= 90 else 3 if 48 <= _c <= 57 else 5 if _c in b" \t\r" else 6 if _c == 10 else 7 if _c in b".,;:?'\"()-" else 4
    )


def stats(text: bytes) -> list[float]:
    """The statistics named in STATS, of a whole text."""
    n = len(text)
    if not n:
        return [0.0] * len(STATS)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, weights=counts, minlength=8) / n
    p = counts[counts > 0] / n
    words = text.split()
    m = len(words)
    if not m:
        return [np.log1p(n)] + [0.0] * (len(STATS) - 1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    seen = Counter(words)
    joined = b"".join(words)
    ends = sum(w[-1] in b"abcdefghijklmnopqrstuvwxyz.," or w[-1] >= 128 for w in seen)
    return [
        np.log1p(n),
        np.log1p(m),
        len(joined) / m,
        kinds[1] + kinds[2],
        kinds[2] / max(kinds[1] + kinds[2], 1e-9),
        kinds[3],
        kinds[7],
        kinds[4],
        kinds[5] + kinds[6],
        kinds[6],
        len(seen) / m,
        max(seen.values()) / m,
        len(set(zip(words, words[1:]))) / max(1, m - 1),
        1 - len(set(lines)) / max(1, len(lines)),
        min(m / max(1, len(lines)), 1000),
        ends / len(seen),
        min(max(map(len, seen)), 1000),
        float(-(p * np.log2(p)).sum()),
        counts[33] / m,
        counts[124] / m,
        (kinds[4] + kinds[7]) * n / m,
        counts[46] / m,
        sum(c for w, c in seen.items() if w.isupper()) / m,
    ]


@dataclass
class Trees:
    """feature -1: a leaf, or below one. value holds each node's output; only leaves' are reached."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x."""
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        at = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(DEPTH):
            f = self.feature[trees, at]
            right = x[rows, np.maximum(f, 0)] > self.threshold[trees, at]
            at = np.where(f < 0, at, 2 * at + 1 + right)
        return 1 / (1 + np.exp(-(self.base + self.value[trees, at].sum(1))))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Log-loss boosting. Without rows, or with one label only, the score is a constant near the share of label 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    base, nodes = float(np.log(share / (1 - share))), 2 ** (DEPTH + 1) - 1
    feature, threshold, value = np.full((TREES, nodes), -1), np.zeros((TREES, nodes)), np.zeros((TREES, nodes))
    if len(y) == 0 or y.min() == y.max():
        return Trees(feature, threshold, value, base)
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(k)]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1) + np.arange(k) * BINS
    raw = np.full(n, base)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h, at, open_ = p - y, p * (1 - p), np.zeros(n, np.int64), np.ones(n, bool)
        for depth in range(DEPTH + 1):
            first, width = 2**depth - 1, 2**depth
            rows = np.flatnonzero(open_)
            if not len(rows):
                break
            local = at[rows] - first
            value[t, first : first + width] = -RATE * np.bincount(local, g[rows], width) / (np.bincount(local, h[rows], width) + L2)
            if depth == DEPTH:
                break
            where = (local[:, None] * (k * BINS) + code[rows]).ravel()
            hist = [np.bincount(where, np.repeat(w[rows], k), width * k * BINS).reshape(width, k, BINS).cumsum(2) for w in (g, h, np.ones(n))]
            (gl, hl, nl), (gs, hs, ns) = hist, (a[:, :, -1:] for a in hist)
            gain = gl**2 / (hl + L2) + (gs - gl) ** 2 / (hs - hl + L2) - gs**2 / (hs + L2)
            gain[(nl < LEAST) | (ns - nl < LEAST)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for i, b in enumerate(best):
                f, cut = divmod(int(b), BINS)
                if gain[i, f, cut] > 1e-6 and cut < len(edges[f]):
                    feature[t, first + i], threshold[t, first + i] = f, edges[f][cut]
            f = feature[t, at[rows]]
            open_[rows[f < 0]] = False
            rows, f = rows[f >= 0], f[f >= 0]
            at[rows] = 2 * at[rows] + 1 + (x[rows, f] > threshold[t, at[rows]])
        raw += value[t, at]
    return Trees(feature, threshold, value, base)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE) -> Trees:
    """From labels (doc_id, label): of equal ids the highest label and the smallest statistics count; null ids, labels
    and texts without a row are not learned from. The sample's bound makes its broadcast and its collection bounded."""
    chosen = sample_by_hash(
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).dropna().groupBy("id").agg(F.max("y").alias("y")), "id", sample
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "id")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return batch(id=b.column(0), y=b.column(2), x=pa.array([stats(t) for t in as_bytes(b.column(1))], pa.list_(pa.float64())))

    got = map_batches(rows, run, "id long, y int, x array<double>").groupBy("id").agg(F.max("y").alias("y"), F.min("x").alias("x")).orderBy("id").collect()
    return fit(np.array([r.x for r in got]).reshape(-1, len(STATS)), np.array([r.y for r in got], float))


def scores(trees: Trees, texts: list[bytes]) -> np.ndarray:
    return trees.score(np.array([stats(t) for t in texts]).reshape(-1, len(STATS)))


def score(docs: DataFrame, trees: Trees, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) for each row of docs; null texts count as empty, repeated rows stay."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        s = scores(trees, as_bytes(b.column(1)))
        return batch(doc_id=b.column(0), score=pa.array(s, pa.float64()), predicted=pa.array((s >= threshold).astype(np.int32), pa.int32()))

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), run, "doc_id long, score double, predicted int")


def keep(docs: DataFrame, trees: Trees, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns."""
    at = docs.columns.index("text")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(scores(trees, as_bytes(b.column(at))) >= threshold))

    return map_batches(docs, run, docs.schema)


def learnable(labels: DataFrame) -> DataFrame:
    return labels.filter(fold(F.col("doc_id"), 5) != 0)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = train(docs, learnable(table(spark, sf_dir, "labels")))
    return score(docs, trees).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
