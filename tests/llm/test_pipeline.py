"""Pipeline stages against brute force, held-out accuracy of the registered queries, and SQL for those that have it."""

import os
import random
import re

import duckdb
import pytest

import corpus_pipeline
from graphloom.llm import registry, suffix_dedup
from graphloom.llm.common import table

from .test_operators import brute_classes, brute_covered, brute_hits, brute_removals, corpus, prose, texts  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark, texts):  # noqa: F811
    return corpus(spark, texts)


def test_near_dedup_stage(spark, docs, texts):  # noqa: F811
    got = {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, SF).collect()}
    classes = brute_classes(list(enumerate(texts)), 5)
    assert got == {i for i, (n, c) in classes.items() if c == i or not n}
    again = corpus_pipeline.near_dedup_stage(spark, docs.union(docs), SF)
    assert again.columns == docs.columns
    # with words one of both rows stays, without both do
    assert sorted(r.doc_id for r in again.collect()) == sorted([*got, *(i for i, (n, _) in classes.items() if not n)])


def brute_dedup(texts):
    """Texts without the characters that a repeated string of 400 bytes touches or a repeated passage of 50 words holds."""
    raw = [(t or "").encode() for t in texts]
    spans = [[m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", t)] for t in raw]
    words = [tuple(t[a:z].translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))) for a, z in s) for t, s in zip(raw, spans, strict=True)]
    out = []
    for t, s, gone, held in zip(raw, spans, brute_covered(raw, 400), brute_covered(words, 50), strict=True):
        gone = bytearray(gone)
        for m in re.finditer(b"\1+", held):
            a, z = s[m.start()][0], s[m.end() - 1][1]
            gone[a:z] = b"\1" * (z - a)
        at, kept = 0, []
        for c in t.decode():
            n = len(c.encode())
            kept.append("" if any(gone[at : at + n]) else c)
            at += n
        out.append("".join(kept))
    return out


def test_suffix_dedup_stage(spark, docs, texts):  # noqa: F811
    got = {r.doc_id: r for r in corpus_pipeline.suffix_dedup_stage(spark, docs, SF).collect()}
    want = brute_dedup(texts)
    assert {i: r.text for i, r in got.items()} == {i: None if t is None else want[i] for i, t in enumerate(texts)}
    assert all(got[i].n_chars == len(got[i].text) for i, t in enumerate(texts) if t is not None)
    bare = corpus_pipeline.suffix_dedup_stage(spark, docs.select("doc_id", "text"), SF)
    assert bare.columns == ["doc_id", "text"] and {r.doc_id: r.text for r in bare.collect()} == {i: r.text for i, r in got.items()}


def test_planted_passages_go(spark):
    """Passages of 50 to 60 words go wherever they stand, and nothing else does."""
    rng, rows, planted = random.Random(13), [], []
    for n in range(50, 61):
        passage = prose(rng, n)
        for k in range(3):
            planted.append((f"{prose(rng, 30)} b{k}", passage, f"{k}a {prose(rng, 30)}"))
            rows.append("\n".join(planted[-1]))
    rows += [prose(rng, 80) for _ in range(10)]
    out = {r.doc_id: r.text for r in corpus_pipeline.suffix_dedup_stage(spark, corpus(spark, rows), SF).collect()}
    assert out == dict(enumerate(brute_dedup(rows)))
    for i, (before, passage, after) in enumerate(planted):
        assert passage not in out[i] and out[i].startswith(before) and out[i].endswith(after) and len(out[i]) <= len(before + after) + 2
    assert [out[i] for i in range(len(planted), len(rows))] == rows[len(planted) :]


def test_characters_go_as_a_whole(spark):
    rng = random.Random(11)
    shared = "é" * 250
    rows = [f"{prose(rng, 5)} ü{shared}ö {prose(rng, 5)}", f"{prose(rng, 6)} û{shared}ò {prose(rng, 6)}"]
    out = [r.text for r in corpus_pipeline.suffix_dedup_stage(spark, corpus(spark, rows), SF).orderBy("doc_id").collect()]
    assert all("�" not in t and not set(t) & set("éÃ©") for t in out)


def test_decontaminate_stage(spark):
    bench = table(spark, SF, "benchmark").collect()
    rng = random.Random(12)
    rows = [prose(rng, 40), f"{prose(rng, 8)} {bench[3].text} {prose(rng, 8)}", None]
    got = {r.doc_id for r in corpus_pipeline.decontaminate_stage(spark, corpus(spark, rows), SF).collect()}
    assert got == {i for i, h in enumerate(brute_hits(rows, [(b.item_id, b.text) for b in bench])) if not h[4]} == {0, 2}


def test_quality_stage_keeps_clean_documents(spark):
    every = table(spark, SF, "documents")
    kept = corpus_pipeline.quality_stage(spark, every, SF)
    assert kept.columns == COLUMNS
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    labels = table(spark, SF, "labels").collect()
    clean = [r.doc_id in ids for r in labels if r.quality == 1]
    assert sum(clean) >= 0.97 * len(clean)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids", "text_sha256"] and 0 < out.count() <= 200
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_take_empty_tables(spark, docs):
    none = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


@pytest.fixture(scope="module")
def answers(spark):
    return {name: f(spark, SF).toPandas() for name, f in registry.QUERIES.items()}


def test_all_queries_return_whole_tables(spark, answers):
    n = {t: table(spark, SF, t).count() for t in ("documents", "pages")}
    for name, got in answers.items():
        if not name.startswith("op10"):
            assert len(got) == n["pages" if name.startswith("op4") else "documents"]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(name, answers):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(registry.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(answers[name].columns) == columns
    assert sorted(map(tuple, answers[name][columns].astype(str).values)) == sorted(map(tuple, want[columns].astype(str).values))


def test_removals_of_the_table(spark, answers):
    rows = table(spark, SF, "documents").collect()
    want = dict(zip((r.doc_id for r in rows), brute_removals([r.text for r in rows]), strict=True))
    assert {r.doc_id: tuple(r)[2:8] for r in answers["op1_suffix_dedup"].itertuples()} == want
    assert suffix_dedup.LENGTH == 400


def test_held_out_accuracy(spark):
    """On sf0.01, where the held-out rows are many enough."""
    sf = SF.replace("sf0.001", "sf0.01")
    labels = table(spark, sf, "labels").toPandas()
    for op, of, least in (("op2_quality", "quality", 0.97), ("op9_toxicity", "toxic", 0.93)):
        got = registry.QUERIES[op](spark, sf).toPandas().merge(labels, on="doc_id")
        held = got[got.held_out]
        assert (held.predicted == held[of]).mean() >= least
    langs = table(spark, sf, "documents").select("doc_id", "lang").toPandas()
    got = registry.QUERIES["op3_langid"](spark, sf).toPandas().merge(langs, on="doc_id")
    assert (got[got.held_out].lang_pred == got[got.held_out].lang).mean() >= 0.98
