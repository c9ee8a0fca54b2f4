"""Every operator on empty tables, nulls, odd and very long texts, repeated rows and columns whose names it uses itself."""

import random
import time

import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe, decontaminate, html_text, langid, licenses, near_dedup, quality, suffix_dedup, topk, toxicity

from .test_operators import prose

rng = random.Random(31)
LONG = prose(rng, 120_000)
TEXTS = [None, "", " \t\n", "\0" * 1000, "a\0b", LONG, "x" * 300_000, "\n" * 50_000, "plain words here", "plain words here", "½ 中文 😀", "idiot " * 20_000]


@pytest.fixture(scope="module")
def odd(spark):
    """documents, one row twice over, a null id, and columns named as operators' own."""
    rows = [(i, t, "en", "s", 1.5, "k", 7, [1], True, "h") for i, t in enumerate(TEXTS)]
    rows += [rows[8], (None, "no id", None, None, None, None, None, None, None, None)]
    names = "doc_id long, text string, lang string, source string, score double, key string, n long, bands array<int>, hit boolean, id string"
    return spark.createDataFrame(rows, names).repartition(3)


def a_model(spark, module, name):
    docs = spark.createDataFrame([(i, prose(rng, 20) + (" grobnik!!" if i % 2 else "")) for i in range(40)], "doc_id long, text string")
    return module.train(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], f"doc_id long, {name} int"))


def operators(spark):
    import public_tokenizers as public

    path, pattern = public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN
    bench = spark.createDataFrame([(1, "plain words here"), (2, None)], "item_id long, text string")
    trees, toxic = a_model(spark, quality, "quality"), a_model(spark, toxicity, "toxic")
    langs = langid.train(spark.createDataFrame([(i, prose(rng, 20), "en") for i in range(30)], "doc_id long, text string, lang string"))
    return {
        "suffix": suffix_dedup.removals,
        "quality": lambda d: quality.score(d, trees),
        "language": lambda d: langid.predict(d, langs),
        "licences": licenses.scan,
        "near": lambda d: near_dedup.classes(d, k=2).withColumnRenamed("id", "doc_id"),
        "leaks": lambda d: decontaminate.report(decontaminate.hits(d, bench)),
        "tokens": lambda d: bpe.digest(d, path, pattern),
        "toxic": lambda d: toxicity.score(d, toxic),
    }


def test_odd_documents(spark, odd):
    for name, f in operators(spark).items():
        began = time.time()
        got = f(odd).collect()
        assert len(got) == len(TEXTS) + 2, name
        by_id = {r.doc_id: r for r in got}
        assert set(by_id) == {*range(len(TEXTS)), None}, name
        plain = [r for r in got if r.doc_id == 8]
        assert len(plain) == 2 and plain[0] == plain[1], name
        assert f(odd.limit(0)).collect() == [], name
        assert time.time() - began < 120, name


def test_defined_results(spark, odd):
    f = operators(spark)
    toxic = {r.doc_id: r for r in f["toxic"](odd).collect()}
    assert toxic[11].predicted == 1 and toxic[0].predicted == toxic[1].predicted == 0 and toxic[0].score == toxic[1].score
    tokens = {r.doc_id: r.n_tokens for r in f["tokens"](odd).collect()}
    assert tokens[0] == tokens[1] == 0 and tokens[5] > 100_000
    words = {r.doc_id: (r.n_words, r.contaminated) for r in f["leaks"](odd).collect()}
    assert words[5][0] == len(LONG.split()) and words[0] == words[3] == (0, False) and words[8] == words[9] == (3, True)
    near = {r.doc_id: r.component_id for r in f["near"](odd).collect()}
    assert [near[i] for i in (0, 1, 2, 8, 9, None)] == [0, 1, 2, 8, 8, None]
    assert {r.doc_id: r.lang_pred for r in f["language"](odd).collect()}[3] == "und"


def test_many_licences_in_one_text():
    text = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 500)
    began = time.time()
    assert len(licenses.scanner().scan(f"{text}\n".encode() * 100)) == 100
    assert time.time() - began < 5


def test_pages_and_vectors(spark):
    pages = spark.createDataFrame([(1, None, None, "t"), (None, "u", "<p>" + "w " * 200_000, "t"), (1, None, None, "t")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.n_chars) for r in html_text.extract(pages).collect()) == [(0, 399_999), (1, 0), (1, 0)]
    vectors = spark.createDataFrame([(0, [1.0], 1, 1), (50, [2.0], 1, 1), (50, [2.0], 1, 1)], "vec_id long, embedding array<double>, shard int, kth int")
    assert sorted(map(tuple, topk.top_k(vectors, F.col("id") % 50 == 0, k=1).collect())) == [(0, 1, 50, 512 * 256), (50, 1, 50, 512 * 512), (50, 1, 50, 512 * 512)]


def test_statistics_by_hand():
    text = "Ab cd! cd\n\n12 the end.\nAb cd! cd\n"
    s = dict(zip(quality.STATS, quality.stats(text.encode()), strict=True))
    n, words = len(text), text.split()
    want = {
        "digits": 2 / n, "newlines": 4 / n, "distinct_words": 6 / 9, "top_word": 2 / 9, "distinct_pairs": 6 / 8, "repeated_lines": 1 - 2 / 3, "line_words": 3.0, "longest_word": 4,
        "bangs": 2 / 9, "pipes": 0.0, "stops": 1 / 9, "word_len": sum(map(len, words)) / 9, "letters": sum(c.isalpha() for c in text) / n, "upper": 2 / sum(c.isalpha() for c in text), "caps_words": 0.0,
    }
    assert {k: pytest.approx(v) for k, v in want.items()} == {k: s[k] for k in want}
    assert quality.stats(b"") == [0.0] * len(quality.STATS) and quality.stats(b" \n")[1:] == [0.0] * (len(quality.STATS) - 1)


def test_subwords_by_hand():
    def hashed(gram):
        x = int.from_bytes(gram[:4], "little")
        h = x * 0x9E3779B1 & 0xFFFFFFFF if len(gram) == 3 else (x * 0x85EBCA6B & 0xFFFFFFFF) ^ 0x27D4EB2F
        h ^= h >> 15
        return (h * 0x2C1B3C6D & 0xFFFFFFFF) >> 19

    for text, folded in (("Ab, c1É", " ab c É "), ("", "  "), ("x", " x ")):
        raw = folded.encode()
        want = [hashed(raw[i : i + k]) for k in (3, 4) for i in range(len(raw) - k + 1)]
        assert langid.subwords(text.encode()).tolist() == want
