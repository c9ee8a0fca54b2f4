"""Helpers shared by the text operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.storage import packed, written  # noqa: F401  for the operators


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows that a function over batches gets at once, and rows of an Arrow batch, which both sides hold in memory.
SLICE, ARROW_ROWS = 512, 1024
ARROW_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch to ARROW_ROWS: texts can be long, and thousands of them fill memory
    outside the heap. A smaller setting stays."""
    if not 0 < int(spark.conf.get(ARROW_CONF)) <= ARROW_ROWS:
        spark.conf.set(ARROW_CONF, str(ARROW_ROWS))


def release() -> None:
    """Gives memory that a Python worker no longer uses back to the system: idle workers live on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """fn over Arrow batches of SLICE rows at most, so what it holds at once is small; order and partitioning stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                if (out := fn(batch.slice(i, SLICE))) is not None:
                    yield out
        release()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def batch(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def as_bytes(column: pa.Array) -> list[bytes]:
    """Binary or string values as bytes; null as empty."""
    return [b"" if v is None else v.encode("utf-8", "surrogatepass") if isinstance(v, str) else v for v in column.to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on a uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def sample_by_hash(rows: DataFrame, key: str, n: int) -> DataFrame:
    """At most n rows, those with the smallest hash of their key: the same rows on every run."""
    return rows.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(n)


#: Bits of a key filter: about FILTER_BITS for each key, 2 ** FILTER_MOST at most: 32 MB whatever the keys.
FILTER_BITS, FILTER_MOST = 12, 28


def key_filter(keys: DataFrame):
    """A broadcast Bloom filter of a column `key` of digests, three places from 12 of their bytes. It spares rows that a
    join would drop anyway; with more keys than it has room for it lets more rows through, never fewer."""
    bits = 1 << min(FILTER_MOST, max(16, (keys.count() * FILTER_BITS).bit_length()))
    place = F.explode(F.array(*(F.conv(F.hex(F.substring("key", 1 + 4 * i, 4)), 16, 10).cast("long") % bits for i in range(3))))
    words = keys.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(p % 64))")).alias("b")).toArrow()
    table_ = np.zeros(bits // 64, np.int64)
    table_[words["w"].to_numpy()] = words["b"].to_numpy()
    return keys.sparkSession.sparkContext.broadcast(table_.view(np.uint64))


def may_hold(table_: np.ndarray, keys: list[bytes] | np.ndarray) -> np.ndarray:
    """For each digest, whether it may be in the filter."""
    raw = keys.tobytes() if isinstance(keys, np.ndarray) else b"".join(keys)
    if not raw:
        return np.zeros(0, bool)
    p = np.frombuffer(raw, ">u4").reshape(len(keys), -1)[:, :3].astype(np.int64) % (len(table_) * 64)
    return (((table_[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1)) == 1).all(1)


def parted(df: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sure, maybe): rows of df whose key, a digest, is certainly in none of keys, and the others with it as `__key`.

    Only the latter need a join with what belongs to the keys, so few of df's rows travel. df is read twice."""
    ready = key_filter(keys.select("key"))
    marked = df.withColumn("__key", key)
    at = len(df.columns)

    def run(b: pa.RecordBatch, wanted: bool) -> pa.RecordBatch:
        held = may_hold(ready.value, b.column(at).to_pylist())
        out = b.filter(pa.array(held if wanted else ~held))
        return out if wanted else out.select(b.schema.names[:-1])

    return map_batches(marked, lambda b: run(b, False), df.schema), map_batches(marked, lambda b: run(b, True), marked.schema)
