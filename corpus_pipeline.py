"""Corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; all but the last return the
columns of docs. run() writes each stage's rows to the shared folder and reads them again for the next one.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers as public
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, decontaminate, near_dedup, quality, suffix_dedup
from graphloom.llm.common import map_batches, packed, parted, table, written

#: No SQL: a trained model and a byte-pair encoder take part. tests/llm holds each stage against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the learnable labels of this stage's own documents, doesn't reject."""
    trees = quality.train(docs, quality.learnable(table(spark, sf_dir, "labels")))
    return packed(quality.keep(docs, trees), docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group whose sets of five-word shingles are linked by a similarity of 0.8 or more: that of the
    smallest id, of equal ids that of the smallest whole row. Texts without words all stay."""
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = near_dedup.classes(rows, k=5, id_col="__row")
    ids = rows.select(F.col("__row").alias("id"), F.struct(F.col("doc_id"), F.xxhash64("text"), F.col("__row")).alias("__order"))
    groups = written(found.filter("n_shingles > 0").join(ids, "id").select("component_id", "__order"), "groups", rows)
    first = written(groups.groupBy("component_id").agg(F.min("__order").alias("__first")), "first")
    key = F.unhex(F.md5(F.col("__row").cast("string").cast("binary")))
    gone = groups.join(first, "component_id").filter("__order <> __first").select(F.col("__order.__row").alias("__row"))
    gone = written(gone.select(key.alias("key")), "gone")
    sure, maybe = parted(rows, key, gone)
    kept = maybe.join(gone.withColumnRenamed("key", "__key"), "__key", "left_anti")
    return packed(sure.select(docs.columns).unionByName(kept.select(docs.columns)), docs)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the bytes that a 400-byte string that also starts elsewhere covers, without passages of 50
    words or more that also stand elsewhere, and with n_chars, if docs has it, of what is left. A character of which only
    some bytes are covered goes as a whole. A null text stays null."""
    _, spans = suffix_dedup.repeats(docs)
    at, n_at = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    sure, maybe = parted(docs, suffix_dedup.text_key(F.col("text")), spans)
    marked = maybe.join(spans.select(F.col("key").alias("__key"), F.struct("bytes", "words").alias("__spans")), "__key", "left").select(*docs.columns, "__spans")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        spans, texts = b.column(b.num_columns - 1).to_pylist(), b.column(at).to_pylist()
        sizes = None if n_at is None else b.column(n_at).to_pylist()
        for i, s in enumerate(spans):
            if s and texts[i] is not None:
                text = texts[i].encode()
                raw = np.frombuffer(text, np.uint8)
                char = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character each byte belongs to
                gone = np.bincount(char, suffix_dedup.gone_bytes(text, s["bytes"], s["words"])) > 0
                texts[i] = raw[~gone[char]].tobytes().decode()
                if sizes:
                    sizes[i] = len(texts[i])
        columns = list(b.columns[:-1])
        columns[at] = pa.array(texts, columns[at].type)
        if sizes:
            columns[n_at] = pa.array(sizes, columns[n_at].type)
        return pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1])

    return packed(sure.unionByName(map_batches(marked, run, docs.schema)), docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item."""
    return packed(decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), nameless=True), docs)


def tokenize_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text_sha256) of each document; text_sha256: of the decoded ids."""
    out = bpe.tokenize(docs, public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("text_sha256"))


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("tokenize", tokenize_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all documents. Null and empty texts get low scores as any other text does and go or stay by
    them; they are linked with nothing, repeat nothing, leak nothing and have no tokens. Repeated rows are near duplicates
    of each other, repeated ids and null ids stay rows of their own; an empty table gives an empty one. More columns of
    documents travel to the last stage and take no part."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
