"""Exact top-k inner-product search with one KD-tree per shard of candidates.

Components become floor(256 x), so scores are integers and exact. Shards are the cells of a KD-tree over a sample: median
splits of the widest dimension. A shard's own tree goes on from there, with a tight box at every node. A box bounds a
query's score by the sum over dimensions of the better of both ends.

A query opens nodes best bound first, an inner node's children joining the open ones, until no open bound reaches its kth
score. That score is propagated: the sample gives the first one, the shard of the best box, searched alone, a better one,
and with it only shards whose box can still reach it are searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import batch, map_batches, partitions, table, written

#: Rows of a leaf, and at most about how many candidates make a shard; queries meet a tree in groups of GROUP.
LEAF, SHARD, GROUP = 256, 1 << 15, 512
#: Candidates, those of smallest hash, that shards are cut by and whose scores give each query its first kth score.
SEED = 2048
SCALE = 256.0
_LAST = np.iinfo(np.int64).max


def scaled(vectors: list) -> list[np.ndarray | None]:
    """floor(256 x) of each vector as doubles; None for a null vector, and for one with a null, NaN or infinity."""
    out: list[np.ndarray | None] = []
    for v in vectors:
        x = None if v is None or any(c is None for c in v) else np.array(v, np.float64)
        out.append(np.floor(x * SCALE) if x is not None and np.isfinite(x).all() else None)
    return out


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Highest score of each query within each box: max(q * low, q * high) by dimension, summed."""
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


class Tree:
    """Median splits of the widest dimension down to LEAF rows. Node 0 is the root; node n holds rows first[n] to last[n],
    its children are child[n] and the next one, or it is a leaf. Boxes are tight."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.arange(len(x))
        first, last, child, low, high = [0], [len(x)], [-1], [], []
        at = 0
        while at < len(first):
            a, b = first[at], last[at]
            part = x[order[a:b]]
            low.append(part.min(0))
            high.append(part.max(0))
            spread = high[at] - low[at]
            if b - a > LEAF:
                mid = (b - a) // 2
                # equal vectors are cut by id: smallest ids first
                by = np.argpartition(part[:, spread.argmax()], mid) if spread.any() else np.argsort(ids[order[a:b]], kind="stable")
                order[a:b] = order[a:b][by]
                child[at] = len(first)
                first += [a, a + mid]
                last += [a + mid, b]
                child += [-1, -1]
            at += 1
        self.order, self.ids, self.x = order, ids[order], np.ascontiguousarray(x[order])
        self.first, self.last, self.child = np.array(first), np.array(last), np.array(child)
        self.low, self.high = np.array(low), np.array(high)
        self.least = np.array([self.ids[a:b].min() for a, b in zip(first, last, strict=True)])

    def search(self, own: np.ndarray, q: np.ndarray, kth: np.ndarray, k: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place in order, score) of hits; each query's best k here are among them, unless below kth. own: the
        queries' own rows, which `rows`, in order, has if they are here."""
        n = len(q)
        opened = np.full((n, len(self.first)), -np.inf)  # bounds of each query's open nodes
        opened[:, 0] = bounds(q, self.low[:1], self.high[:1])[:, 0]
        best_s = np.full((n, k), -np.inf)
        best_at = np.full((n, k), -1)
        kth, worst = kth.copy(), np.full(n, _LAST)
        live = np.arange(n)
        while True:
            node = opened[live].argmax(1)
            bound = opened[live, node]
            reach = (bound >= kth[live]) & (bound > -np.inf)
            live, node, bound = live[reach], node[reach], bound[reach]
            if not len(live):
                break
            opened[live, node] = -np.inf
            useful = (bound > kth[live]) | (self.least[node] < worst[live])
            inner = useful & (self.child[node] >= 0)
            up, down = np.maximum(q[live[inner]], 0), np.minimum(q[live[inner]], 0)
            for c in (self.child[node[inner]], self.child[node[inner]] + 1):
                opened[live[inner], c] = (up * self.high[c]).sum(1) + (down * self.low[c]).sum(1)
            leaf = useful & (self.child[node] < 0)
            by = np.argsort(node[leaf], kind="stable")
            mine, leaves = live[leaf][by], node[leaf][by]
            for g in np.split(np.arange(len(mine)), np.flatnonzero(np.diff(leaves)) + 1) if len(mine) else []:
                a, z, who = self.first[leaves[g[0]]], self.last[leaves[g[0]]], mine[g]
                s = q[who] @ self.x[a:z].T
                s[own[who][:, None] == rows[a:z]] = -np.inf
                s, at = np.hstack([best_s[who], s]), np.hstack([best_at[who], np.broadcast_to(np.arange(a, z), (len(who), z - a))])
                ids = np.where(at < 0, _LAST, self.ids[at])
                if s.shape[1] > 4 * k:  # only what reaches the kth score is sorted
                    cut = np.partition(s, -k, axis=1)[:, -k, None]
                    keep = (s >= cut).sum(1).max()
                    some = np.argpartition(-s, min(keep, s.shape[1] - 1), axis=1)[:, :keep]
                    s, at, ids = (np.take_along_axis(v, some, 1) for v in (s, at, ids))
                top = np.lexsort((ids, -s), axis=1)[:, :k]
                best_s[who], best_at[who] = np.take_along_axis(s, top, 1), np.take_along_axis(at, top, 1)
                full = who[best_s[who, -1] >= kth[who]]
                kth[full] = best_s[full, -1]
                worst[full] = np.where(best_at[full, -1] < 0, _LAST, self.ids[best_at[full, -1]])
        r, c = np.nonzero(best_s > -np.inf)
        return r, best_at[r, c], best_s[r, c]


class Cells:
    """A KD-tree whose leaves are `n` cells of space, split at medians of a sample."""

    def __init__(self, sample: np.ndarray, n: int):
        self.dim, self.cut, self.child, self.cell = [-1], [0.0], [-1], [0]
        todo, cells = [(0, sample, n)], 0
        while todo:
            node, x, n = todo.pop()
            spread = x.max(0) - x.min(0) if len(x) else np.zeros(1)
            if n > 1 and spread.any():
                d = int(spread.argmax())
                cut = float(np.quantile(x[:, d], (n // 2) / n, method="lower"))
                cut = cut if cut < x[:, d].max() else float(x[:, d][x[:, d] < cut].max())
                self.dim[node], self.cut[node], self.child[node] = d, cut, len(self.dim)
                for part, m in ((x[x[:, d] <= cut], n // 2), (x[x[:, d] > cut], n - n // 2)):
                    todo.append((len(self.dim), part, m))
                    self.dim.append(-1)
                    self.cut.append(0.0)
                    self.child.append(-1)
                    self.cell.append(0)
            else:
                self.cell[node] = cells
                cells += 1

    def of(self, x: np.ndarray) -> np.ndarray:
        dim, cut, child, cell = map(np.array, (self.dim, self.cut, self.child, self.cell))
        at = np.zeros(len(x), np.int64)
        while len(go := np.flatnonzero(dim[at] >= 0)):
            at[go] = child[at[go]] + (x[go, dim[at[go]]] > cut[at[go]])
        return cell[at]


def vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, id, v): scaled components of the rows that take part."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        v = scaled(b.column(2).to_pylist())
        ok = [i for i, x in enumerate(v) if x is not None]
        at = pa.array(ok, pa.int64())
        return batch(row=b.column(0).take(at), id=b.column(1).take(at), v=pa.array([v[i] for i in ok], pa.list_(pa.float64())))

    own = rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    return map_batches(own, run, "row long, id long, v array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(len(column), -1)


def _longs(column: pa.Array) -> np.ndarray:
    return column.fill_null(_LAST).to_numpy(zero_copy_only=False)


def _search(candidates: DataFrame, queries: DataFrame, k: int, n: int) -> DataFrame:
    """(query row, query_id, vec_id, score): each query's hits in each shard that it is sent to. queries: (shard, row, id,
    v, kth). A task reads a shard's candidates, builds the tree, then streams queries through it in groups; its memory is
    that of one shard, whatever the number of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, tree = None, [], None
        for b in batches:
            for shard, kind, part in _runs(b):
                if shard != now:
                    now, held, tree = shard, [], None
                if kind == 0:
                    held.append((part.column(2), part.column(3), _matrix(part.column(4))))
                    continue
                if tree is None and held:
                    rows, ids = (pa.chunked_array([h[i] for h in held]).combine_chunks() for i in (0, 1))
                    tree, held = Tree(_longs(ids), np.concatenate([x for *_, x in held])), []
                    rows, ids = _longs(rows)[tree.order], ids.take(pa.array(tree.order))
                for a in range(0, part.num_rows if tree else 0, GROUP):
                    g = part.slice(a, GROUP)
                    own = _longs(g.column(2))
                    r, at, s = tree.search(own, _matrix(g.column(4)), g.column(5).to_numpy(zero_copy_only=False), k, rows)
                    yield batch(row=pa.array(own[r], pa.int64()), query_id=g.column(3).take(pa.array(r)), vec_id=ids.take(pa.array(at)), score=pa.array(s.astype(np.int64), pa.int64()))

    held = candidates.join(queries.select("shard").distinct(), "shard", "left_semi")
    dealt = held.select("shard", F.lit(0).alias("kind"), "row", "id", "v", F.lit(0.0).alias("kth")).unionByName(queries.select("shard", F.lit(1).alias("kind"), "row", "id", "v", "kth"))
    return dealt.repartition(n, "shard").sortWithinPartitions("shard", "kind").mapInArrow(run, "row long, query_id long, vec_id long, score long")


def top_k(rows: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row chosen by is_query (a condition on `id`) its k highest integer
    inner products with all other rows; equal scores by smaller id, null ids last.

    Null vectors, vectors with null or non-finite components and vectors of another length than most take no part
    (of equally common lengths the greater counts). Only a query's own row is no candidate of it: rows that share its id
    are, and each of several rows of one id is a query. With fewer than k others, there are fewer ranks; an empty table
    gives no rows.

    A cell with more than shard_rows candidates, such as that of a very common vector, is dealt to several shards by
    hash. What the driver holds is the sample and for each shard a box.
    """
    spark = rows.sparkSession
    base = written(vectors(rows, id_col, vector_col), "vectors")
    sizes = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None or not sizes.d:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims = int(sizes.d)
    base = base.filter(F.size("v") == dims)
    wanted = max(1, -(-int(sizes["count"]) // shard_rows), min(partitions(spark), int(sizes["count"]) // SEED))
    seeds = base.orderBy(F.xxhash64("row", "v"), "row").limit(SEED).collect()
    seed = np.array([r.v for r in seeds], np.float64).reshape(-1, dims)
    shared = spark.sparkContext.broadcast((np.array([r.row for r in seeds], np.int64), seed, Cells(seed, wanted)))

    def placed(b: pa.RecordBatch) -> pa.RecordBatch:
        return batch(row=b.column(0), id=b.column(1), v=b.column(2), cell=pa.array(shared.value[2].of(_matrix(b.column(2))), pa.int32()))

    cells = written(map_batches(base, placed, "row long, id long, v array<double>, cell int"), "cells")
    ends = lambda f: F.array(*(f(F.col("v")[i]) for i in range(dims)))
    boxes = cells.groupBy("cell").agg(F.count("*").alias("n"), ends(F.min).alias("low"), ends(F.max).alias("high")).collect()
    parts = [(b.cell, s) for b in boxes for s in range(-(-b.n // shard_rows))]
    first = {c: i for i, (c, s) in reversed(list(enumerate(parts)))}
    of = {b.cell: b for b in boxes}
    low, high = (np.array([of[c][e] for c, _ in parts], np.float64).reshape(-1, dims) for e in ("low", "high"))
    box = spark.sparkContext.broadcast((low, high))
    start = F.create_map(*(F.lit(x) for c in of for x in (c, first[c])))
    salts = F.create_map(*(F.lit(x) for b in boxes for x in (b.cell, -(-b.n // shard_rows))))
    candidates = written(cells.select((start[F.col("cell")] + F.pmod(F.xxhash64("row"), salts[F.col("cell")])).cast("int").alias("shard"), "row", "id", "v"), "shards")

    def best(b: pa.RecordBatch) -> pa.RecordBatch:
        """Each query's first kth score and the shard of its best box."""
        own, q = _longs(b.column(0)), _matrix(b.column(2))
        s = q @ shared.value[1].T
        s[own[:, None] == shared.value[0][None, :]] = -np.inf
        kth = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(q), -np.inf)
        return batch(shard=pa.array(bounds(q, *box.value).argmax(1), pa.int32()), row=b.column(0), id=b.column(1), v=b.column(2), kth=pa.array(kth, pa.float64()))

    schema = "shard int, row long, id long, v array<double>, kth double"
    queries = written(map_batches(base.filter(is_query), best, schema), "queries")
    near = written(_search(candidates, queries, k, len(parts)), "near")
    by = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    kth = near.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") == k).select("row", F.col("score").cast("double").alias("found"))

    def others(b: pa.RecordBatch) -> pa.RecordBatch:
        """The query once for each other shard whose box reaches its kth score."""
        q, kth = _matrix(b.column(3)), b.column(4).to_numpy(zero_copy_only=False)
        reach = bounds(q, *box.value) >= kth[:, None]
        reach[np.arange(len(q)), b.column(0).to_numpy(zero_copy_only=False)] = False
        at, shard = np.nonzero(reach)
        rest = [b.column(i).take(pa.array(at)) for i in range(1, 5)]
        return batch(shard=pa.array(shard, pa.int32()), row=rest[0], id=rest[1], v=rest[2], kth=rest[3])

    better = queries.join(kth, "row", "left").select("shard", "row", "id", "v", F.greatest("kth", F.coalesce("found", "kth")).alias("kth"))
    far = _search(candidates, written(map_batches(better, others, schema), "sent"), k, len(parts))
    hits = near.unionByName(far).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return hits.select("query_id", "rank", "vec_id", "score")


def _runs(b: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """Slices of equal shard and kind of a sorted batch."""
    key = b.column(0).to_numpy(zero_copy_only=False) * 2 + b.column(1).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
    for a, z in zip(cuts, cuts[1:]):
        if z > a:
            yield int(key[a]) // 2, int(key[a]) % 2, b.slice(a, z - a)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
