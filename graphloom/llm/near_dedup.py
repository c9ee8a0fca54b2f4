"""Near-duplicate detection by HyperMinHash.

A document's shingle set is hashed once; each of its registers keeps the smallest hash of its share of the set as a
leading-zero count and mantissa bits. Registers without a shingle borrow from a register chosen by fixed priorities.
Bands of registers form buckets. All members of a bucket meet under one pivot, where registers estimate similarity,
corrected for chance collisions, and the full sets confirm every link.

Nothing is enumerated pairwise: equal sets are one node; a pivot's group is cut to blocks of BLOCK members; within a block
what links to the pivot is one component at once, and only the others are compared further. Blocks of one group are
connected by comparing what is outside the pivot's component with the group's other blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import as_bytes, batch, key_filter, map_batches, may_hold, mix64, packed, release, table, written

#: Bands of ROWS registers. At similarity 0.8 all bands differ with a probability of (1 - 0.8 ** 5) ** 40 = 1.3e-7.
BANDS, ROWS, MANTISSA = 40, 5, 10
REGISTERS = BANDS * ROWS
#: Below 0.8 bands get fewer rows so that no more pairs are missed than MISS; there, sets of up to SMALL shingles, and all
#: that can link to one, also meet by a prefix of their shingles, as their registers hold few different ones.
MISS, SMALL = 1.3e-7, 16
#: Members of a block, and standard errors below the threshold at which the estimate alone rules out a link.
BLOCK, ERRORS = 1024, 6.0
#: Chance that registers of disjoint sets agree is about this times 2 ** -MANTISSA (HyperMinHash, Yu and Weber).
COLLIDES = 0.169919487159739

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_PRIORITY = _rng.random((REGISTERS, REGISTERS), np.float32)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
PIECE = 1 << 20


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse mod 2 ** 64."""
    one = np.ones(1 << bits, np.uint64)
    up, down = one.copy(), one.copy()
    up[1:], down[1:] = _BASE, np.uint64(pow(int(_BASE), -1, 1 << 64))
    return np.cumprod(up), np.cumprod(down)


def _hashed(text: bytes) -> np.ndarray:
    x = np.frombuffer(text, np.uint8)
    space = np.concatenate([[True], _SPACE[x], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    if not len(edge):
        return np.zeros(0, np.uint64)
    start, end = edge[::2], edge[1::2]
    up, down = _powers(max(10, int(len(x)).bit_length()))
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(_BYTE[x] * up[: len(x)], out=total[1:])
    return mix64((total[end] - total[start]) * down[start])


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words, lower-cased in A-Z; long texts in pieces cut at white space."""
    text, out = text.translate(_LOWER), []
    while len(text) > PIECE:
        cut = PIECE
        while cut < len(text) and not _SPACE[text[cut]]:
            cut += 1
        out.append(_hashed(text[:cut]))
        text = text[cut:]
    return np.concatenate([*out, _hashed(text)])


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles; of the whole sequence, if it is shorter; none without words."""
    w = word_hashes(text)
    n = min(k, len(w))
    if not n:
        return w
    h = np.zeros(len(w) - n + 1, np.uint64)
    for j in range(n):
        h = h * _STEP + w[j : len(w) - n + 1 + j]
    return np.unique(mix64(h + np.uint64(n)))


def registers(shingles: np.ndarray) -> np.ndarray:
    """Compressed registers, 16 bits each: 6 of the leading-zero count, MANTISSA after the leading one."""
    r = mix64(shingles ^ _STEP)
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    full = np.zeros(REGISTERS, bool)
    at = ((shingles >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(low, at, r)
    full[at] = True
    if not full.all():
        own, empty = np.flatnonzero(full), np.flatnonzero(~full)
        low[empty] = low[own[_PRIORITY[np.ix_(empty, own)].argmin(1)]]
    zeros = 53 - np.frexp((low >> np.uint64(11)).astype(np.float64))[1]
    after = low << (zeros + 1).astype(np.uint64)
    return (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | (after >> np.uint64(64 - MANTISSA)).astype(np.uint16)


def band_rows(at_least: tuple[int, int]) -> int:
    """Registers of a band: as many, up to ROWS, as let pairs of that similarity share a band but for MISS."""
    num, den = at_least
    t = num / den
    for rows in range(ROWS, 0, -1):
        if 0 < t <= 1 and (1 - t**rows) ** (REGISTERS // rows) <= MISS:
            return rows
    raise ValueError(f"{REGISTERS} registers can't find pairs of similarity {num}/{den}")


def prefix_keys(shingles: np.ndarray, at_least: tuple[int, int]) -> np.ndarray:
    """The first shingles of a set, of which two sets that link have one in common."""
    num, den = at_least
    return mix64(shingles[: len(shingles) - -(-len(shingles) * num // den) + 1] + _BASE).view(np.int64)


def meeting_keys(shingles: np.ndarray, at_least: tuple[int, int]) -> np.ndarray:
    """Keys by which a set meets others; none if it can link to equal ones only."""
    num, den, n = *at_least, len(shingles)
    if not n or n * (den - num) < num:
        return np.zeros(0, np.int64)
    keys = band_keys(registers(shingles), band_rows(at_least))
    return np.unique(np.concatenate([keys, prefix_keys(shingles, at_least)])) if 5 * num < 4 * den and n * num <= SMALL * den else keys


def band_keys(regs: np.ndarray, rows: int = ROWS) -> np.ndarray:
    bands = REGISTERS // rows
    h = np.arange(bands, dtype=np.uint64) + np.uint64(1)
    for j in range(rows):
        h = h * _STEP + regs[: bands * rows].reshape(bands, rows)[:, j].astype(np.uint64)
        h = mix64(h)
    return h.view(np.int64)


def estimate(regs: np.ndarray, other: np.ndarray, n: int, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity of one set of n shingles with others of m, corrected for chance collisions of registers."""
    ratio = np.minimum(n, m) / np.maximum(n, m)
    chance = COLLIDES * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return ((regs[None, :] == other).mean(1) - chance) / (1 - chance)


def margin(n: np.ndarray, least: float = 0.8) -> np.ndarray:
    """ERRORS standard errors of the estimate at the similarity, up to 0.8, at which they are largest from `least` on, from
    the number of registers a set of n fills itself."""
    j = min(max(least, 0.5), 0.8)
    return ERRORS * np.sqrt(j * (1 - j) / (REGISTERS * -np.expm1(-n / REGISTERS)))


def links(sets: list[np.ndarray], at_least: tuple[int, int], probes: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Roots of the components of similar sets, and pairs of positions that link them.

    Set 0 is the pivot. With probes, only the last so many sets are compared, each with the sets before them; then
    the pairs are each probe's links, the first of each component among those it finds unconnected.
    """
    n = np.array(list(map(len, sets)))
    num, den = at_least
    regs = np.stack([registers(s) for s in sets])
    flat, start = np.concatenate(sets), np.concatenate([[0], np.cumsum(n)[:-1]])
    root, pairs, slack = np.arange(len(sets)), [], margin(n, num / den)

    def near(u: int, rivals: np.ndarray) -> np.ndarray:
        fits = den * np.minimum(n[u], n[rivals]) >= num * np.maximum(n[u], n[rivals])
        rivals = rivals[fits]
        rivals = rivals[estimate(regs[u], regs[rivals], int(n[u]), n[rivals]) >= num / den - np.maximum(slack[u], slack[rivals])]
        if not len(rivals):
            return rivals
        where = np.repeat(start[rivals] - np.cumsum(n[rivals]) + n[rivals], n[rivals]) + np.arange(n[rivals].sum())
        place = np.minimum(np.searchsorted(sets[u], flat[where]), n[u] - 1)
        common = np.add.reduceat((sets[u][place] == flat[where]).astype(np.int64), np.cumsum(n[rivals]) - n[rivals])
        return rivals[den * common >= num * (n[u] + n[rivals] - common)]

    last = len(sets) - probes
    for u in range(last, len(sets)) if probes else range(len(sets)):
        rivals = np.flatnonzero(root[: last if probes else len(sets)] != root[u])
        for v in near(u, rivals[rivals != u]):
            if root[v] != root[u]:
                root[root == root[v]] = root[u]
                pairs.append((u, v))
    return root, np.array(pairs, np.int64).reshape(-1, 2)


def sketched(docs: DataFrame, k: int, id_col: str, at_least: tuple[int, int]) -> DataFrame:
    """(id, key, n, bands) of each row: 16-byte digest of its set, the set's size, its keys (none if it links to equals only)."""
    band_rows(at_least)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        keys, n, bands = [], [], []
        for t in as_bytes(b.column(1)):
            s = shingle_set(t, k)
            keys.append(xxhash.xxh3_128_digest(s.tobytes()))
            n.append(len(s))
            bands.append(meeting_keys(s, at_least))
        return batch(id=b.column(0), key=pa.array(keys, pa.binary()), n=pa.array(n, pa.int64()), bands=pa.array(bands, pa.list_(pa.int64())))

    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col("text").cast("binary").alias("text")), run, "id long, key binary, n long, bands array<long>")


def grouped(docs: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(pivot, blocks, block, kind, key, s): the sets that meet, in blocks of each pivot's group. kind 0: the pivot."""
    nodes = rows.filter(F.size("bands") > 0).groupBy("key").agg(F.first("bands").alias("bands"))
    banded = nodes.select("key", F.explode("bands").alias("band"))
    buckets = written(banded.groupBy("band").agg(F.count("*").alias("c"), F.min("key").alias("pivot")).filter("c > 1"), "buckets")
    met = banded.join(buckets, "band").select("pivot", "key").filter("pivot <> key")
    met = written(met.distinct(), "met")
    sizes = written(met.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "groups")
    dealt = met.join(sizes, "pivot").withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int")).withColumn("kind", F.lit(1))
    pivots = sizes.select("pivot", F.col("pivot").alias("key"), "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"))
    dealt = dealt.select("pivot", "key", "blocks", "block", "kind").unionByName(pivots.select("pivot", "key", "blocks", "block", "kind"))

    needed = written(dealt.select("key").distinct(), "needed")
    ready = key_filter(needed)

    def sets(b: pa.RecordBatch) -> pa.RecordBatch:
        s = [shingle_set(t, k).tobytes() for t in as_bytes(b.column(0))]
        out = batch(key=pa.array([xxhash.xxh3_128_digest(x) for x in s], pa.binary()), s=pa.array(s, pa.binary()))
        return out.filter(pa.array(may_hold(ready.value, out.column(0).to_pylist())))

    texts = map_batches(docs.select(F.col("text").cast("binary").alias("text")), sets, "key binary, s binary")
    texts = written(texts.groupBy("key").agg(F.first("s").alias("s")).join(needed, "key"), "sets", docs)
    return written(dealt.join(texts, "key").select("pivot", "blocks", "block", "kind", "key", "s"), "dealt")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows (kind, key, set) of each pivot and block from sorted batches; the first column after those two is skipped."""
    now, held = None, []
    for b in batches:
        pivot, blocks, block, kind, key, s = (c.to_pylist() for c in b.columns)
        for i in range(len(pivot)):
            if (at := (pivot[i], block[i], blocks[i])) != now:
                if held:
                    yield now, held
                now, held = at, []
            held.append((kind[i], key[i], np.frombuffer(s[i], np.uint64)))
    if held:
        yield now, held
    release()


def linked(dealt: DataFrame, at_least: tuple[int, int]) -> DataFrame:
    """Edges (a, b) between keys that connect every component of the similarity graph."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (pivot, block, blocks), rows in _blocks(batches):
            root, pairs = links([s for _, _, s in rows], at_least)
            key = [k for _, k, _ in rows]
            # members outside the pivot's component, which other blocks may hold links of
            left = np.flatnonzero(root != root[0]).tolist() if blocks > 1 else []
            n, m = len(pairs), len(left)
            yield batch(
                a=pa.array([key[u] for u, _ in pairs] + [key[u] for u in left], pa.binary()), b=pa.array([key[v] for _, v in pairs] + [None] * m, pa.binary()),
                pivot=pa.array([None] * n + [pivot] * m, pa.binary()), block=pa.array([None] * n + [block] * m, pa.int32()), blocks=pa.array([None] * n + [blocks] * m, pa.int32()),
            )

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _blocks(batches):
            if probes := sum(kind == 2 for kind, _, _ in rows):
                _, pairs = links([s for _, _, s in rows], at_least, probes)
                yield batch(a=pa.array([rows[u][1] for u, _ in pairs], pa.binary()), b=pa.array([rows[v][1] for _, v in pairs], pa.binary()))

    order = dealt.select("pivot", "blocks", "block", "kind", "key", "s")
    together = lambda df: df.repartition("pivot", "block").sortWithinPartitions("pivot", "block", "kind", "key")
    found = written(together(order).mapInArrow(within, "a binary, b binary, pivot binary, block int, blocks int"), "linked")
    edges = found.filter("b IS NOT NULL").select("a", "b")
    left = found.filter("b IS NULL").select("pivot", "blocks", F.col("block").alias("own"), F.col("a").alias("key"))
    if left.isEmpty():
        return edges
    large = order.filter("blocks > 1")
    probes = left.join(large.select("pivot", "key", "s"), ["pivot", "key"]).select("pivot", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "own", "key", "s")
    probes = probes.filter("block <> own").select("pivot", "blocks", "block", F.lit(2).alias("kind"), "key", "s")
    more = together(large.unionByName(probes)).mapInArrow(across, "a binary, b binary")
    return edges.unionByName(written(more, "across"))


def components(edges: DataFrame) -> DataFrame:
    """(key, label): for each key with an edge the smallest key it is connected to. Labels fall to the smallest among
    neighbours and then to their label's label, round by round, each round written."""
    edges = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("key")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        best = edges.join(labels.select(F.col("key").alias("b"), "label"), "b").groupBy(F.col("a").alias("key")).agg(F.min("label").alias("near"))
        step = labels.join(best, "key").select("key", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        hop = labels.select(F.col("key").alias("label"), F.col("label").alias("far"))
        now = written(step.join(hop, "label", "left").select("key", "was", F.least("label", F.coalesce("far", "label")).alias("label")), "labels", edges)
        if now.filter("was <> label").isEmpty():
            return now.select("key", "label")
        labels = now.select("key", "label")


def classes(docs: DataFrame, k: int = 5, at_least: tuple[int, int] = (80, 100), id_col: str = "doc_id") -> DataFrame:
    """(id, n_shingles, component_id, key) for each row of docs: documents whose shingle sets have a Jaccard similarity of
    num / den or more are linked; component_id is the smallest id of the linked ones.

    Null and wordless texts have no shingles and are linked with nothing, their component is their own id. Equal sets
    are linked. Rows may repeat ids; a null id is never a component's id unless all its ids are null.
    """
    rows = written(sketched(docs, k, id_col, at_least), "sketched")
    edges = linked(grouped(docs, rows, k), at_least)
    labels = components(edges)
    first = rows.filter("n > 0").groupBy("key").agg(F.min("id").alias("low"))
    first = written(first.join(labels, "key", "left").select("key", "low", F.coalesce("label", "key").alias("label")), "first", rows)
    low = written(first.groupBy("label").agg(F.min("low").alias("component_id")), "lows")
    by_key = written(first.join(low, "label").select("key", "component_id"), "classes", rows)
    out = rows.select("id", "n", "key").filter("n > 0").join(by_key, "key").select("id", "n", "component_id", "key")
    out = out.unionByName(rows.filter("n = 0").select("id", "n", F.col("id").alias("component_id"), "key")).withColumnRenamed("n", "n_shingles")
    return packed(out, rows)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"), k=2)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
