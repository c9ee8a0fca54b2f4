"""Byte-level BPE encoding and decoding.

Pre-tokens that are vocabulary entries are resolved by a minimal perfect hash over the vocabulary; all others
are merged with a heap of candidate pairs over a doubly linked list of bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import batch, map_batches, table

#: White space of Unicode (property White_Space), which the pre-tokeniser's \s stands for.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Pre-tokens that a Python worker remembers from one partition to the next, in about 100 MB; the memory is cleared when full, so
#: it only saves time.
MEMO = 1 << 19


class PerfectHash:
    """Minimal perfect hash of n distinct byte strings: first level a bucket, second level that bucket's seed.

    lookup(key) is the slot of a known key; for unknown keys the slot holds another key, so the caller compares.
    """

    def __init__(self, keys: list[bytes]):
        n = max(1, len(keys))
        self.n, self.m = n, n // 2 + 1
        buckets: list[list[bytes]] = [[] for _ in range(self.m)]
        for k in keys:
            buckets[self._digest(k) % self.m].append(k)
        self.seeds = np.zeros(self.m, np.int64)
        self.slots: list[bytes | None] = [None] * n
        for b in sorted(range(self.m), key=lambda b: -len(buckets[b])):
            if len(buckets[b]) == 1:
                break
            if not buckets[b]:
                continue
            digests, seed = [self._digest(k) for k in buckets[b]], 0
            while True:
                seed += 1
                places = {self._slot(d, seed) for d in digests}
                if len(places) == len(digests) and all(self.slots[p] is None for p in places):
                    break
            self.seeds[b] = seed
            for k, d in zip(buckets[b], digests, strict=True):
                self.slots[self._slot(d, seed)] = k
        free = (i for i in range(n) if self.slots[i] is None)
        for b in range(self.m):  # single keys go to the free slots: the seed is the slot, marked by its sign
            if len(buckets[b]) == 1:
                at = next(free)
                self.seeds[b] = -at - 1
                self.slots[at] = buckets[b][0]
        self.seed_list = self.seeds.tolist()

    @staticmethod
    def _digest(key: bytes) -> int:
        return xxhash.xxh3_64_intdigest(key)

    def _slot(self, digest: int, seed: int) -> int:
        x = (digest ^ (seed * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
        return (x ^ (x >> 32)) % self.n

    def lookup(self, key: bytes) -> int:
        d = self._digest(key)
        seed = self.seed_list[d % self.m]
        return -seed - 1 if seed < 0 else self._slot(d, seed)


class Codec:
    """Encoder and decoder for a table of ranks: bytes of a token -> its id, which is also its merge rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.hash = PerfectHash(list(ranks))
        self.slot_ids = [ranks.get(k, -1) if k is not None else -1 for k in self.hash.slots]
        self.bytes_of = {i: k for k, i in ranks.items()}
        self.find = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"(?!\S)", f"(?![^{SPACE}])").replace(r"\s", f"[{SPACE}]")).findall
        self.memo: dict[str, tuple[int, ...]] = {}

    def piece(self, key: bytes) -> tuple[int, ...]:
        at = self.hash.lookup(key)
        return (self.slot_ids[at],) if self.hash.slots[at] == key else self.merge(key)

    def merge(self, key: bytes) -> tuple[int, ...]:
        """Lowest rank first, the leftmost of equals; each heap entry is checked against the list it was made from."""
        n, ranks = len(key), self.ranks
        if not n:
            return ()
        end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends; 0 once merged away
        before = list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(key[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(key[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(key[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[key[i : end[i]]])
            i = end[i]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        memo, found = self.memo, self.find(text)
        if len(memo) > MEMO:
            memo.clear()
        new = set(found).difference(memo)
        for t in new:
            memo[t] = self.piece(t.encode("utf-8"))
        out = list(chain.from_iterable(map(memo.__getitem__, found)))
        for t in new:
            if len(t) > 64:
                del memo[t]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def tokenize(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row by row, without shuffle: (doc_id, ids, decoded). The rank file is a public vocabulary installed with
    the workers' Python. A null text is empty: no ids. Repeated rows stay; other columns of docs don't matter."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path, pattern)
        ids = [c.encode(t or "") for t in b.column(1).to_pylist()]
        return batch(doc_id=b.column(0), ids=pa.array(ids, pa.list_(pa.int32())), decoded=pa.array([c.decode(x) for x in ids], pa.binary()))

    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col)), run, "doc_id long, ids array<int>, decoded binary")


def digest(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As tokenize, reduced to (doc_id, n_tokens, ids_sha256, decoded_sha256)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c, n, ids_sha, out_sha = codec(path, pattern), [], [], []
        for t in b.column(1).to_pylist():
            ids = c.encode(t or "")
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            out_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
        return batch(doc_id=b.column(0), n_tokens=pa.array(n, pa.int64()), ids_sha256=pa.array(ids_sha, pa.string()), decoded_sha256=pa.array(out_sha, pa.string()))

    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col)), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    return digest(table(spark, sf_dir, "documents"), public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)
