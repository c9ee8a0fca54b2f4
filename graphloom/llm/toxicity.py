"""Toxicity by weak supervision.

Voters are lexicon entries (a fixed list, and words and word beginnings found in labelled rows), each with a vote for few
and one for many hits in relation to the text's length, and patterns. A generative label model, fitted by expectation
maximisation, estimates how each voter votes under both classes and which voters are correlated beyond the class;
correlated voters share one vote. A logistic regression is trained on the posterior labels.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import as_bytes, batch, fold, map_batches, sample_by_hash, table
from graphloom.llm.decontaminate import words

#: Bound of what is learned from: labelled documents (smallest hash of the id).
SAMPLE = 8000
#: An entry is considered with at least so many toxic documents and so large a share of toxic ones among its documents; it
#: joins the lexicon if it is in at least NEW toxic documents that the entries before it are not in.
SUPPORT, PRECISION, NEW = 4, 0.8, 3
#: Bytes of the word beginnings; hits for each word from which there are many; EM rounds; residual correlation of voters that share.
BEGINNINGS, MANY = range(4, 9), 1 / 300
ROUNDS, CORRELATED = 30, 0.6

#: Insults of the fixed lexicon.
INSULTS = """arsehole asshole bastard bitch cretin dickhead dimwit douchebag dumbass halfwit idiot idiotic imbecile loser lowlife moron moronic
pathetic retard retarded scum scumbag shithead stupid vermin worthless""".split()

PATTERNS = [
    re.compile(rb"\byou(?:'re| are| all)?(?: \w+)? (?:idiots?|morons?|losers?|scum|trash|pathetic|stupid|worthless|disgusting)\b", re.I),
    re.compile(rb"\b(?:shut up|go to hell|drop dead|kill yourself|screw you|f+u+c+k+ (?:you|off))\b", re.I),
    re.compile(rb"\b(?:i|we) (?:hate|despise) you\b", re.I),
]


def entries(word: bytes) -> list[bytes]:
    """What a word can match: itself, and its beginnings, marked by a star."""
    return [word, *(word[:k] + b"*" for k in BEGINNINGS if k <= len(word))]


def hits(text: bytes, place: dict[bytes, int]) -> tuple[dict[int, int], int]:
    """Hits of each entry in place, and the number of words."""
    all_words = words(text)
    found: dict[int, int] = {}
    for w, n in Counter(all_words).items():
        for e in entries(w):
            if (k := place.get(e)) is not None:
                found[k] = found.get(k, 0) + n
    return found, len(all_words)


def matched(text: bytes) -> list[int]:
    return [k for k, p in enumerate(PATTERNS) if p.search(text)]


@dataclass
class Model:
    lexicon: list[bytes]
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.place = {w: k for k, w in enumerate(self.lexicon)}

    @property
    def voters(self) -> int:
        return 2 * len(self.lexicon) + len(PATTERNS) + 2

    def votes(self, found: dict[int, int], n_words: int, patterns: list[int]) -> np.ndarray:
        """1 toxic, -1 not, 0 no opinion. For each entry a voter for few and one for many hits, then each pattern, one for
        several entries hit, and one against if nothing was."""
        v, n = np.zeros(self.voters), len(self.lexicon)
        for k, hit in found.items():
            v[k + n * (hit >= MANY * n_words)] = 1
        for k in patterns:
            v[2 * n + k] = 1
        v[-2] = len(found) >= 2
        v[-1] = -(not found and not patterns)
        return v

    def score(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(votes @ self.weights + self.bias)))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return self.score(np.array([self.votes(*hits(t, self.place), matched(t)) for t in texts]).reshape(-1, self.voters))


def posterior(votes: np.ndarray, balance: float) -> np.ndarray:
    """P(toxic) of each row by the label model; balance: the share of toxic rows, which stays as given."""
    if not len(votes):
        return np.zeros(0)
    balance = float(np.clip(balance, 0.005, 0.5))
    prior = np.log(balance / (1 - balance))
    fired = votes != 0
    p = np.where((votes > 0).any(1), 0.95, 0.02)
    share = np.ones(votes.shape[1])
    for _ in range(ROUNDS):
        one, zero = p.sum() + 1e-9, (1 - p).sum() + 1e-9
        # a voter fires with these rates under each class; the pseudo counts take it for informative a little
        rate1 = (p @ fired + np.where(votes.max(0, initial=0) > 0, 0.5, 0.05)) / (one + 1)
        rate0 = ((1 - p) @ fired + np.where(votes.max(0, initial=0) > 0, 0.05, 0.5)) / (zero + 1)
        rate1, rate0 = np.clip(rate1, 1e-5, 1 - 1e-5), np.clip(rate0, 1e-5, 1 - 1e-5)
        rest = fired - (p[:, None] * rate1 + (1 - p)[:, None] * rate0)
        spread = np.sqrt((rest**2).mean(0)) + 1e-9
        tied = np.abs(rest.T @ rest / max(1, len(votes)) / np.outer(spread, spread)) > CORRELATED
        share = 1 / np.maximum(1, tied.sum(1))
        # silence of a voter tells little and is not counted: lexicon words are rare in either class
        p = 1 / (1 + np.exp(-np.clip(prior + (fired * np.log(rate1 / rate0) * share).sum(1), -30, 30)))
    return p


def fit(found: list[bytes], rows: list[tuple[dict[int, int], int, list[int]]], labels: np.ndarray) -> Model:
    """found: candidate entries, best first; rows: of each labelled document its hits of them, words and patterns.
    Without rows the fixed lexicon alone decides."""
    chosen, covered = [k for k, e in enumerate(found) if e.decode("utf-8", "replace") in INSULTS], np.zeros(len(rows), bool)
    of: list[list[int]] = [[] for _ in found]
    for r, (hit, _, _) in enumerate(rows):
        for k in hit:
            of[k].append(r)
    known = set(chosen)
    for k in range(len(found)):
        new = [r for r in of[k] if labels[r] and not covered[r]]
        if len(new) >= NEW:
            chosen += [] if k in known else [k]
            covered[new] = True
    most = max((len(of[k]) for k in chosen), default=0)  # words as frequent as the best ones, though others cover their documents
    known = set(chosen)
    for k in range(len(found)):
        if k not in known and not found[k].endswith(b"*") and len(of[k]) >= max(SUPPORT, most / 3):
            chosen.append(k)
    lexicon = [found[k] for k in chosen] + [w.encode() for w in INSULTS if w.encode() not in found]
    model, place = Model(lexicon, np.zeros(0), 0.0), {k: i for i, k in enumerate(chosen)}
    votes = np.array([model.votes({place[k]: n for k, n in hit.items() if k in place}, n_words, pat) for hit, n_words, pat in rows]).reshape(-1, model.voters)
    model.weights, model.bias = logistic(votes, posterior(votes, labels.mean() if len(labels) else 0.1))
    return model


def logistic(x: np.ndarray, p: np.ndarray, l2: float = 0.05, steps: int = 60) -> tuple[np.ndarray, float]:
    """Newton steps on soft labels; weights start at, and are pulled to, a vote's sign, so voters unseen here still count."""
    at = np.append(np.full(x.shape[1], 5.0), -2.0)
    at[-3:-1] = 1.0  # several entries; none
    pull, z = at.copy(), np.hstack([x, np.ones((len(x), 1))])
    reg = np.full(len(at), l2)
    for _ in range(steps):
        s = 1 / (1 + np.exp(-np.clip(z @ at, -30, 30)))
        step = np.linalg.solve((z * (s * (1 - s))[:, None]).T @ z + np.diag(reg), z.T @ (s - p) + reg * (at - pull))
        at -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return at[:-1], float(at[-1])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """From labels (doc_id, label): of equal ids the highest label and the smallest row of hits count; null ids and labels
    are not learned from. The driver gets the entries that meet SUPPORT and PRECISION and the sample's hits of them, never texts."""
    chosen = sample_by_hash(
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).dropna().groupBy("id").agg(F.max("y").alias("y")), "id", sample
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "id")

    def counted(b: pa.RecordBatch) -> pa.RecordBatch:
        n = [Counter(), Counter()]
        for t, y in zip(as_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
            n[y > 0].update({e for w in set(words(t)) for e in entries(w)})
        every = list(n[0] | n[1])
        return batch(e=pa.array(every, pa.binary()), a=pa.array([n[1][e] for e in every], pa.int64()), b=pa.array([n[0][e] for e in every], pa.int64()))

    a, b = F.col("a"), F.col("b")
    counts = map_batches(rows, counted, "e binary, a long, b long").groupBy("e").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    best = counts.filter((a >= SUPPORT) & (a >= PRECISION * (a + b))).orderBy(b * 4 - a, F.col("e").like("%*"), "e").collect()
    known = [w.encode() for w in INSULTS]
    found = [bytes(r.e) for r in best]
    found += [w for w in known if w not in found]
    place = docs.sparkSession.sparkContext.broadcast({e: k for k, e in enumerate(found)})

    def seen(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [(*hits(t, place.value), matched(t)) for t in as_bytes(b.column(1))]
        x = pa.array([[list(h), list(h.values()), [n], p] for h, n, p in got], pa.list_(pa.list_(pa.int64())))
        return batch(id=b.column(0), y=b.column(2), x=x)

    got = map_batches(rows, seen, "id long, y int, x array<array<long>>").groupBy("id").agg(F.max("y").alias("y"), F.min("x").alias("x")).orderBy("id").collect()
    return fit(found, [(dict(zip(r.x[0], r.x[1])), r.x[2][0], r.x[3]) for r in got], np.array([r.y > 0 for r in got], float))


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) for each row of docs; null texts count as empty, repeated rows stay."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        s = model.scores(as_bytes(b.column(1)))
        return batch(doc_id=b.column(0), score=pa.array(s, pa.float64()), predicted=pa.array((s >= threshold).astype(np.int32), pa.int32()))

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), run, "doc_id long, score double, predicted int")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.filter(fold(F.col("doc_id"), 3) != 1))
    return score(docs, model).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
