"""Benchmark decontamination: a prefix-filtered set join with exact containment.

Items are cut into windows of consecutive words. A window's shingles are its word pairs (its word, if it has one only),
ordered by rarity, i.e. by how often they occur in all documents. A document that contains the window contains all
shingles, so one necessary prefix token, the rarest shingle, is joined; the token's place gives the position that the
window must have, position and length bounds drop what can't fit, and the words are compared exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import as_bytes, batch, map_batches, table, written

WORDS = 10
#: Item words of one block; a larger benchmark is joined block by block, so what is sent to executors has a bound.
BLOCK_WORDS = 250_000

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


@dataclass
class Block:
    """Windows of some items. Word ids start at 1; a pair's code is first * size + second, a single word's first * size."""

    vocabulary: dict[bytes, int]
    windows: np.ndarray  # rows of WORDS word ids, padded by 0
    lengths: np.ndarray
    items: list[np.ndarray]  # of each window, places in item_ids
    item_ids: list[int | None]  # ascending, None last
    shingles: np.ndarray  # sorted codes
    singles: bool
    starts: np.ndarray | None = None  # for each shingle, its slice of entries
    entries: np.ndarray | None = None  # windows whose rarest shingle it is
    offsets: np.ndarray | None = None  # the shingle's place in them

    @property
    def size(self) -> int:
        return len(self.vocabulary) + 1

    def ids(self, text: bytes) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in words(text)], np.int64)

    def found(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of known shingles in a document, and which they are."""
        if not len(self.shingles) or not len(ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        codes = ids[at] * self.size + ids[at + 1]
        if self.singles:
            one = np.flatnonzero(ids > 0)
            at, codes = np.concatenate([at, one]), np.concatenate([codes, ids[one] * self.size])
        k = np.minimum(np.searchsorted(self.shingles, codes), len(self.shingles) - 1)
        hit = self.shingles[k] == codes
        return at[hit], k[hit]

    def codes(self, w: int) -> np.ndarray:
        row = self.windows[w, : self.lengths[w]]
        return row[:-1] * self.size + row[1:] if len(row) > 1 else row * self.size

    def order(self, counts: np.ndarray) -> None:
        """Sets each window's prefix token, given the shingles' counts."""
        token, offset = np.zeros(len(self.windows), np.int64), np.zeros(len(self.windows), np.int64)
        for w in range(len(self.windows)):
            k = np.searchsorted(self.shingles, self.codes(w))
            offset[w] = np.lexsort((k, counts[k]))[0]
            token[w] = k[offset[w]]
        self.entries = np.argsort(token, kind="stable")
        self.starts = np.searchsorted(token[self.entries], np.arange(len(self.shingles) + 1))
        self.offsets = offset[self.entries]

    def match(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window and first word of every occurrence."""
        at, k = self.found(ids)
        n = self.starts[k + 1] - self.starts[k]
        e = np.repeat(self.starts[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
        first = np.repeat(at, n) - self.offsets[e]
        w = self.entries[e]
        fits = (first >= 0) & (first + self.lengths[w] <= len(ids))
        first, w = first[fits], w[fits]
        for j in range(WORDS):  # most candidates end at the first words
            same = (j >= self.lengths[w]) | (ids[np.minimum(first + j, len(ids) - 1)] == self.windows[w, j])
            first, w = first[same], w[same]
            if not len(w):
                break
        return w, first


def _in_order(ids: set[int | None]) -> list[int | None]:
    return sorted(ids, key=lambda i: (i is None, i or 0))


def build(items: list[tuple[int | None, bytes]]) -> Block:
    vocabulary: dict[bytes, int] = {}
    seen: dict[tuple[int, ...], int] = {}
    of: list[set[int]] = []
    item_ids = _in_order({i for i, _ in items})
    place = {i: k for k, i in enumerate(item_ids)}
    for item, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)]
        for s in range(max(1, len(ids) - WORDS + 1) if ids else 0):
            w = seen.setdefault(tuple(ids[s : s + WORDS]), len(seen))
            if w == len(of):
                of.append(set())
            of[w].add(place[item])
    windows = np.zeros((len(seen), WORDS), np.int64)
    lengths = np.zeros(len(seen), np.int64)
    for row, w in seen.items():
        windows[w, : len(row)], lengths[w] = row, len(row)
    block = Block(vocabulary, windows, lengths, [np.array(sorted(x)) for x in of], item_ids, np.zeros(0, np.int64), bool((lengths == 1).any()))
    if len(seen):
        block.shingles = np.unique(np.concatenate([block.codes(w) for w in range(len(seen))]))
    return block


def blocks(benchmark: DataFrame, most: int = BLOCK_WORDS, nameless: bool = False) -> Iterator[Block]:
    """The items, streamed to the driver and cut after `most` words. Items of one id count as one item with several
    texts, and nameless ones (null id) as one, if they are to take part; items without text are left out."""
    held, n, some = [], 0, False
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).dropna(subset=["text"] if nameless else ["item_id", "text"]).toLocalIterator():
        text = bytes(r["text"])
        held.append((r.item_id, text))
        n += len(words(text))
        if n >= most:
            yield build(held)
            held, n, some = [], 0, True
    if held or not some:
        yield build(held)


def ranked(docs: DataFrame, block: Block) -> Block:
    """The block, its prefix tokens chosen by the shingles' counts over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(block.shingles), np.int64)
        for b in batches:
            found = [block.found(block.ids(t))[1] for t in as_bytes(b.column(0))]
            total += np.bincount(np.concatenate([np.zeros(0, np.int64), *found]), minlength=len(total))
        k = np.flatnonzero(total)
        yield batch(k=pa.array(k, pa.int64()), n=pa.array(total[k], pa.int64()))

    counts = np.zeros(len(block.shingles), np.int64)
    if len(counts):
        found = docs.select(F.col("text").cast("binary")).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
        counts[found["k"].to_numpy()] = found["n"].to_numpy()
    block.order(counts)
    return block


def hits(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS, nameless: bool = False) -> DataFrame:
    """docs (doc_id, text) with n_words, hit (word positions, ascending) and items (ids, ascending, null last): the words
    inside any occurrence of a window, and the items whose windows occur. Null texts have no words; repeated rows stay."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).withColumns(
        {"n_words": F.lit(0).cast("long"), "hit": F.array().cast("array<int>"), "items": F.array().cast("array<long>")}
    )
    schema = "doc_id long, text binary, n_words long, hit array<int>, items array<long>"
    done = 0
    for block in blocks(benchmark, block_words, nameless):
        out = written(out, "hits") if done else out  # one block's index at a time in a task
        done += 1
        ready = docs.sparkSession.sparkContext.broadcast(ranked(docs, block))

        def run(b: pa.RecordBatch, ready=ready) -> pa.RecordBatch:
            k, n, hit, items = ready.value, [], [], []
            for text, old, old_items in zip(as_bytes(b.column(1)), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                ids = k.ids(text)
                n.append(len(ids))
                w, first = k.match(ids)
                if len(w):
                    marks = np.zeros(len(ids) + 1, np.int64)
                    np.add.at(marks, first, 1)
                    np.add.at(marks, first + k.lengths[w], -1)
                    old = sorted({*old, *np.flatnonzero(np.cumsum(marks)).tolist()})
                    old_items = _in_order({*old_items, *(k.item_ids[i] for i in np.unique(np.concatenate([k.items[x] for x in np.unique(w)])))})
                hit.append(old)
                items.append(old_items)
            return batch(doc_id=b.column(0), text=b.column(1), n_words=pa.array(n, pa.int64()), hit=pa.array(hit, pa.list_(pa.int32())), items=pa.array(items, pa.list_(pa.int64())))

        out = map_batches(out, run, schema)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, nameless: bool = False) -> DataFrame:
    """The rows of docs in which no window of a one-block benchmark occurs, with all their columns; a larger benchmark
    filters them block by block."""
    at = docs.columns.index("text")
    out, done = docs, 0
    for block in blocks(benchmark, nameless=nameless):
        out = written(out, "clean") if done else out
        done += 1
        ready = docs.sparkSession.sparkContext.broadcast(ranked(docs, block))

        def run(b: pa.RecordBatch, ready=ready) -> pa.RecordBatch:
            k = ready.value
            return b.filter(pa.array([not len(k.match(k.ids(t))[0]) for t in as_bytes(b.column(at))], pa.bool_()))

        out = map_batches(out, run, docs.schema)
    return out


def report(found: DataFrame) -> DataFrame:
    """hits() reduced to counts and a digest of the item ids, sorted as strings; items without id count as one."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n = [len(x) for x in b.column(2).to_pylist()]
        items = b.column(3).to_pylist()
        sha = [hashlib.sha256(",".join(sorted(str(i) for i in x if i is not None)).encode()).hexdigest() for x in items]
        return batch(
            doc_id=b.column(0), n_words=b.column(1), n_hit=pa.array(n, pa.int64()), n_items=pa.array(list(map(len, items)), pa.int64()), items_sha256=pa.array(sha, pa.string()), contaminated=pa.array([x > 0 for x in n], pa.bool_())
        )

    return map_batches(found.select("doc_id", "n_words", "hit", "items"), run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), nameless=True))
