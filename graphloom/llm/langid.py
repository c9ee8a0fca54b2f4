"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text is lower-cased (A-Z), other ASCII than letters becomes space, and its byte 3- and 4-grams are hashed. The text's
vector is the mean of its subwords' embeddings. As the classifier is linear, scoring uses the product of both
matrices: one number for each subword and language.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import as_bytes, batch, fold, map_batches, table

BUCKETS, DIM, EPOCHS, RATE, STEP = 8192, 16, 12, 8.0, 32
#: About so many documents are learned from, dealt evenly to the languages, but not fewer than FEW of each language.
SAMPLE, FEW = 3000, 15
#: Share of the right answers of the calibration rows that the rejection threshold may cost.
REJECT = 0.005

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def subwords(text: bytes) -> np.ndarray:
    """Hashed 3- and 4-grams of the words with a space around them."""
    x = np.frombuffer(b" " + b" ".join(text.translate(_FOLD).split()) + b" ", np.uint8).astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.int64)
    three = x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)
    four = three[:-1] | x[3:] << np.uint32(24)
    h = np.concatenate([three * np.uint32(0x9E3779B1), four * np.uint32(0x85EBCA6B) ^ np.uint32(0x27D4EB2F)])
    h ^= h >> np.uint32(15)
    return ((h * np.uint32(0x2C1B3C6D)) >> np.uint32(19)).astype(np.int64)


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x languages
    temperature: float
    reject: float  # scores below are rejected by predict(..., rejecting=True)

    def probabilities(self, text: bytes) -> np.ndarray:
        at = subwords(text)
        z = (self.table[at].mean(0) if len(at) else np.zeros(len(self.langs))) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def predict(self, text: bytes | None, rejecting: bool = False) -> tuple[str, float]:
        """und and 0 without a letter or without anything learned; when rejecting, und also below the threshold."""
        if not text or not self.langs or not has_letter(text):
            return "und", 0.0
        p = self.probabilities(text)
        k = int(p.argmax())
        return ("und" if rejecting and p[k] < self.reject else self.langs[k]), float(p[k])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """rows: language, subwords, their shares. A fifth of the rows only calibrates temperature and threshold."""
    langs = sorted({r[0] for r in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), 1.0, 0.0)
    place = {lang: k for k, lang in enumerate(langs)}
    y, rng = np.array([place[r[0]] for r in rows]), np.random.default_rng(7)
    dim = max(DIM, len(langs) // 3)  # with too few, rare ones of many languages aren't told apart
    embed, out = rng.normal(0, 0.1, (BUCKETS, dim)), rng.normal(0, 0.3, (dim, len(langs)))
    apart = np.arange(len(rows)) % 5 == 4
    apart &= np.bincount(y[~apart], minlength=len(langs))[y] > 0  # no language is only calibrated with
    use = np.flatnonzero(~apart)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        rng.shuffle(use)
        for i in range(0, len(use), STEP):
            part = use[i : i + STEP]
            at = np.concatenate([rows[j][1] for j in part])
            share = np.concatenate([rows[j][2] for j in part])
            of = np.repeat(np.arange(len(part)), [len(rows[j][1]) for j in part])
            x = np.zeros((len(part), BUCKETS))
            x[of, at] = share
            mean = x @ embed
            d = _softmax(mean @ out)
            d[np.arange(len(part)), y[part]] -= 1
            d /= len(part)
            back = d @ out.T
            out -= rate * 0.25 * mean.T @ d
            embed -= rate * x.T @ back
    product = (embed @ out).astype(np.float32)
    held = np.flatnonzero(apart)
    if not len(held):
        return Model(langs, product, 1.0, 0.0)
    z = np.stack([(product[rows[j][1]] * rows[j][2][:, None]).sum(0) for j in held])
    loss = lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(held)), y[held]], 1e-12)).mean()
    temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
    p = _softmax(z / temperature)
    right = p.max(1)[p.argmax(1) == y[held]]
    return Model(langs, product, temperature, float(np.quantile(right, REJECT)) if len(right) else 0.0)


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """From text and lang of docs, both not null. Each language's share of its rows is chosen by a hash of id and text
    so that about the same number comes from each, all languages included; only hashed subword counts of the sample reach the
    driver."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"), F.col("lang").cast("string").alias("lang")).dropna(subset=["text", "lang"])
    sizes = rows.groupBy("lang").count().collect()
    if not sizes:
        return fit([])
    quota = max(sample / len(sizes), FEW)
    shares = docs.sparkSession.createDataFrame([(r.lang, float(min(1.0, 1.2 * quota / r["count"]))) for r in sizes], "lang string, share double")
    place = F.pmod(F.xxhash64("id", "lang", F.xxhash64("text")), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.join(F.broadcast(shares), "lang").filter(place < F.col("share")).select("id", "lang", "text")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [np.unique(subwords(t), return_counts=True) for t in as_bytes(b.column(2))]
        share = [(n / max(1, n.sum())).astype(np.float32) for _, n in got]
        return batch(id=b.column(0), lang=b.column(1), at=pa.array([a.astype(np.int32) for a, _ in got], pa.list_(pa.int32())), share=pa.array(share, pa.list_(pa.float32())))

    got = map_batches(chosen, run, "id long, lang string, at array<int>, share array<float>").filter(F.size("at") > 0)
    within = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id", "at")))
    got = got.withColumn("nth", within).filter(F.col("nth") <= int(2 * quota)).orderBy(F.xxhash64("id", "at"), "lang").select("lang", "at", "share").toArrow()
    if not got.num_rows:
        return fit([])
    at, share = (got[c].combine_chunks() for c in ("at", "share"))  # as Python lists they would fill the driver's memory
    ends, at, share = at.offsets.to_numpy(), at.values.to_numpy(), share.values.to_numpy()
    return fit([(lang, at[i:j], share[i:j]) for lang, i, j in zip(got["lang"].to_pylist(), ends, ends[1:], strict=False)])


def predict(docs: DataFrame, model: Model, rejecting: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of docs; null and letterless texts are und with score 0."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [model.predict(t, rejecting) for t in as_bytes(b.column(1))]
        return batch(doc_id=b.column(0), lang_pred=pa.array([x[0] for x in got], pa.string()), score=pa.array([x[1] for x in got], pa.float64()))

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), run, "doc_id long, lang_pred string, score double")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(fold(F.col("doc_id"), 4) != 2))
    return predict(docs, model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
