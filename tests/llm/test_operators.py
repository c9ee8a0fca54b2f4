"""Text operators against brute force, on small tables with nulls, empty and long texts, repeated rows and clashing columns."""

import collections
import hashlib
import html
import random
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe, decontaminate, html_text, langid, licenses, near_dedup, quality, suffix_dedup, topk, toxicity

WORDS = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "über", "naïve", "x1"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(string.ascii_lowercase) * rng.randint(0, 2) for _ in range(n))


def corpus(spark, texts, first=0):
    """documents with texts, columns whose names operators also use, and doc_id from first on."""
    rows = [(first + i, t, "en", f"s{i % 3}", len(t or ""), 0.5, "k", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, key string, n long").repartition(3)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = prose(rng, 150)
    near = base.split()
    near[20] = "other"
    out = [None, "", " \n\t", "one", "One", base, base, " ".join(near), base.upper(), prose(rng, 40), "ab" * 400, "ab" * 390 + "é", prose(rng, 9000)]
    out += [prose(rng, 60) + " " + base[100:700] + " " + prose(rng, 60) for _ in range(4)]
    return out + [prose(rng, rng.randint(1, 80)) for _ in range(40)]


# --- 1 ---------------------------------------------------------------------------------------------------------------


def brute_covered(seqs, length):
    """For each sequence, which of its items lie in a string of that length that also starts elsewhere."""
    seen = collections.Counter(t[i : i + length] for t in seqs for i in range(len(t) - length + 1))
    out = []
    for t in seqs:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append(bytes(gone))
    return out


def brute_removals(texts, length=400, passage=50):
    raw = [(t or "").encode() for t in texts]
    lower = {c: c + 32 for c in range(65, 91)}
    words = [tuple(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))) for t in texts]
    out = []
    for t, gone, held in zip(raw, brute_covered(raw, length), brute_covered(words, passage), strict=True):
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest(), len(re.findall(b"\1+", held)), sum(held)))
    return out


@pytest.mark.parametrize("share", [suffix_dedup.SHARE, 1500])
def test_suffix_dedup(spark, texts, share, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARE", share)  # small: hashes are dealt to several parts and merged
    got = suffix_dedup.removals(corpus(spark, texts)).collect()
    want = brute_removals(texts)
    assert {r.doc_id: tuple(r)[1:] for r in got} == dict(enumerate(want))
    assert any(w[1] for w in want) and len(got) == len(texts)


def test_suffix_dedup_empty_table(spark):
    assert suffix_dedup.removals(corpus(spark, ["x"]).limit(0)).collect() == []


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    text = bytes(rng.choice(b"ab") for _ in range(2000)) + b"ab" * 300
    order, _ = suffix_dedup.suffix_array(np.frombuffer(text, np.uint8), len(text) * 2)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    codes = np.array([rng.randrange(3) for _ in range(1500)], np.uint32)
    order, _ = suffix_dedup.suffix_array(codes, 3000)
    assert order.tolist() == sorted(range(1500), key=lambda i: codes[i:].tolist())


def test_repeated_windows_of_one_shard():
    """Segments of few letters, with ties, overlaps, zero bytes and copies, against brute force."""
    rng, unit = random.Random(20), suffix_dedup.Unit("bytes", 12, 4, 64, 1)
    for alphabet in (b"a", b"ab", b"\0a", b"abcd", b"\0"):
        parts = [bytes(rng.choice(alphabet) for _ in range(rng.randint(12, 60))) for _ in range(12)]
        parts += [parts[0][3:] + b"zz" + parts[1], parts[2]]
        known = np.array([False] * len(parts))
        hit, heads, start = suffix_dedup.repeated([np.frombuffer(p, np.uint8) for p in parts], known, unit)
        seen = collections.Counter(p[i : i + 12] for p in parts for i in range(len(p) - 11))
        assert [hit[a : a + len(p)].tolist() for a, p in zip(start, parts, strict=True)] == [[seen[p[i : i + 12]] > 1 for i in range(len(p) - 11)] + [False] * 11 for p in parts]
        whole = b"".join(parts)
        assert sorted(whole[i : i + 12] for i in heads) == sorted(seen)


def test_repeats_around_zero_bytes(spark):
    """A window `tail, zeros, head` in two texts, while others end in the tail and start with the head."""
    rng = random.Random(21)
    tail, head = prose(rng, 60)[:250], prose(rng, 60)[:250]
    window = tail + "\0" * 8 + head
    rows = [prose(rng, 50) + window + prose(rng, 50), prose(rng, 70) + window, prose(rng, 90) + tail, head + prose(rng, 90), "\0" * 900, "\0" * 401, "\0" * 399]
    got = suffix_dedup.removals(corpus(spark, rows)).collect()
    want = brute_removals(rows)
    assert {r.doc_id: tuple(r)[1:] for r in got} == dict(enumerate(want))
    assert want[0][1] == len(window.encode()) and want[2][1] == 0


def test_passages_of_50_words(spark):
    """Planted in other texts, with other white space, marks and capitals; most are shorter than 400 bytes."""
    rng, rows, planted = random.Random(22), [], {}
    for n in (48, 49, 50, 51, 55, 60):
        passage = prose(rng, n).split()
        for form in (" ".join, "\n".join, ", ".join, lambda w: " ".join(w).upper().replace("Ü", "ü").replace("Ï", "ï")):
            planted[len(rows)] = n
            rows.append(f"{prose(rng, 30)} {form(passage)}. {prose(rng, 40)}")
    rows += [prose(rng, 90) for _ in range(20)]
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.removals(corpus(spark, rows)).collect()}
    assert got == dict(enumerate(brute_removals(rows)))
    assert all((got[i][5] == n) == (n >= 50) and (got[i][4] == 1) == (n >= 50) for i, n in planted.items())
    assert not any(got[i][5] for i in range(len(planted), len(rows)))


def test_words_and_their_places():
    texts = [b"", b" ", b"One two--THREE 4x", "Ünï 中文。x".encode(), b"a" * 9, b"\0a\0"]
    for t in [*texts, prose(random.Random(23), 3000).encode()]:
        code, start, end = suffix_dedup.words(t)
        found = re.findall(rb"[0-9A-Za-z\x80-\xff]+", t)
        assert [t[a:z] for a, z in zip(start, end, strict=True)] == found
        assert len(set(code.tolist())) == len({w.lower() for w in found})


def test_words_of_long_texts(monkeypatch):
    t = prose(random.Random(24), 4000).encode()
    want = suffix_dedup.words(t)
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    assert all((a == b).all() for a, b in zip(want, suffix_dedup.words(t), strict=True))


def test_anchor_of_equal_windows_is_equal(monkeypatch):
    rng = random.Random(2)
    shared = prose(rng, 80).encode()[:450]
    texts = [b"x" * 37 + shared + b"y" * 50, b"", shared + b"z" * 900, b"short"]
    found, sizes = suffix_dedup.anchors(texts)
    a, none, b, short = found.to_pylist()
    assert {h for h in a if h < 1 << suffix_dedup.HASH_BITS} & set(b) and none == short == []
    assert sizes == [[len(t) for t in texts], [len(re.findall(rb"[0-9A-Za-z\x80-\xff]+", t)) for t in texts]]
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)  # runs of long texts in pieces: the same windows and hashes
    for unit in suffix_dedup.UNITS:
        seqs = unit.sequences([*texts, prose(rng, 1500).encode()])
        windows = [(i, w + j, v) for of, first, n, value, _, _ in suffix_dedup.runs(seqs, unit) for i, w, m, v in zip(of, first, n, value, strict=True) for j in range(m)]
        alone = [(i, w + j, v) for i, x in enumerate(seqs) for _, first, n, value, _, _ in suffix_dedup.runs([x], unit) for w, m, v in zip(first, n, value, strict=True) for j in range(m)]
        assert windows == alone and len(windows) == sum(max(0, len(x) - unit.length + 1) for x in seqs)


# --- 2, 9 ------------------------------------------------------------------------------------------------------------


def labelled(spark, rows, name):
    return spark.createDataFrame(rows, f"doc_id long, {name} int")


def test_quality_learns_junk(spark):
    rng = random.Random(3)
    texts, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        t = prose(rng, 60)
        texts.append(t if good else " ".join(w.upper() + "!!" for w in t.split()))
        labels.append((i, int(good)))
    docs = corpus(spark, [*texts, None, ""])
    trees = quality.train(docs, labelled(spark, [*labels, (5, 0), (None, 1), (7, None), (99_999, 1)], "quality"))
    got = {r.doc_id: r for r in quality.score(docs, trees).collect()}
    assert len(got) == 302 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert sum(got[i].predicted == y for i, y in labels) >= 297
    kept = quality.keep(docs, trees)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, r in got.items() if r.predicted}


def test_quality_without_labels(spark):
    docs = corpus(spark, ["a b", None])
    trees = quality.train(docs, labelled(spark, [], "quality"))
    assert [r.score for r in quality.score(docs, trees).collect()] == [0.5, 0.5]
    one = quality.train(docs, labelled(spark, [(0, 1)], "quality"))
    assert all(r.predicted for r in quality.score(docs, one).collect())


def test_trees_match_a_plain_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, len(quality.STATS)))
    y = (x[:, 3] + x[:, 5] > 0).astype(float)
    trees = quality.fit(x, y)

    def walk(row):
        total = trees.base
        for f, t, v in zip(trees.feature, trees.threshold, trees.value, strict=True):
            at = 0
            while f[at] >= 0:
                at = 2 * at + 1 + (row[f[at]] > t[at])
            total += v[at]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(trees.score(x), [walk(r) for r in x])
    assert ((trees.score(x) > 0.5) == y).mean() > 0.97


def test_toxicity(spark):
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(400):
        words = prose(rng, 50).split()
        if toxic := i % 8 == 0:
            words[rng.randrange(50)] = rng.choice(["grobnik", "grobner", "grobi", "IDIOT!", "worthless"])
            words[rng.randrange(50)] = rng.choice(["grobling", "grobi", "idiot", "worthless"])
        texts.append(" ".join(words))
        labels.append((i, int(toxic)))
    docs = corpus(spark, [*texts, None, "", "idiot"])
    model = toxicity.train(docs, labelled(spark, [x for x in labels if x[0] % 3], "toxic"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert [i for i, y in labels if got[i].predicted != y] == []
    assert got[400].predicted == got[401].predicted == 0 and got[402].predicted == 1
    bare = toxicity.train(docs, labelled(spark, [], "toxic"))
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, bare).collect()}
    assert got[402] == 1 and got[1] == 0


def test_label_model_lets_correlated_voters_share_a_vote():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.2
    vote = lambda right: np.where(rng.random(4000) < right, y, ~y) & (rng.random(4000) < 0.5)
    one = vote(0.9)
    good, votes = vote(0.95), np.stack([one, one, one, one], 1).astype(float)
    p = toxicity.posterior(np.column_stack([votes, good]), y.mean())
    assert ((p > 0.5) == y).mean() > 0.8


# --- 3 ---------------------------------------------------------------------------------------------------------------


def test_langid(spark):
    rng = random.Random(6)
    syllables = {"aa": ["ka", "lo", "mi", "ra"], "bb": ["sch", "ung", "ein", "ver"], "cc": ["ção", "nho", "que", "lh"]}
    rows = []
    for i in range(240):
        lang = "abc"[i % 3] * 2
        text = " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(12))
        rows.append((i, text, lang if i < 160 else None))
    docs = spark.createDataFrame([*rows, (500, None, "aa"), (501, "", "aa"), (502, "123 !?", "bb"), (503, "kalo mira", None)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert all(got[i].lang_pred == "abc"[i % 3] * 2 and 0 <= got[i].score <= 1 for i in range(240))
    assert [got[i].lang_pred for i in (500, 501, 502, 503)] == ["und", "und", "und", "aa"]
    assert langid.predict(docs, model, rejecting=True).filter("lang_pred = 'und'").count() >= 3
    nothing = langid.train(docs.filter("lang IS NULL"))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_langid_many_languages(spark):
    """Languages beyond the 200 most frequent ones are learned too, and one with a single row."""
    rng, rows = random.Random(16), []
    syllables = [["".join(rng.choice(string.ascii_lowercase) for _ in range(4)) for _ in range(4)] for _ in range(212)]
    for k, own in enumerate(syllables):
        for _ in range(1 if k == 211 else 12 if k < 201 else 8):
            rows.append((len(rows), " ".join(rng.choice(own) + rng.choice(own) for _ in range(12)), f"l{k:03}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert len(model.langs) == 212
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
    rare = [i for i, _, lang in rows if lang >= "l201"]
    assert sum(got[i] == rows[i][2] for i in rare) >= 0.9 * len(rare)


# --- 4 ---------------------------------------------------------------------------------------------------------------


def test_html(spark):
    long = "word " * 40
    pages = [
        (f"<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a href=x>Home</a></nav><div class='ad'>Buy now</div><article><h1>Head &amp; line</h1><p>{long}<p>A <b>b</b>c&nbsp;d&#33;<br>e</article>"
         "<section id=comments><p>nice one</p></section><footer>(c)</footer></body></html>", f"Head & line {long.strip()} A bc d! e"),
        ("<main><header><h1>T</h1></header><p>x</p><aside>y</aside><form>z<input></form><div role=alert>w</div><div style='display: none'>v</div></main>", "T x"),
        (f"<ul><li><a href=a>One</a><li><a href=b>Two</a></ul><h2>News</h2><p>{long}</p><p>short</p><p>{long}</p><div class='sidebar widget'>{long}</div>", f"News {long}short {long.strip()}"),
        ("<article><p>a &lt;b&gt; c<!-- <p>no</p> --></p><style>p{}</style><p class=\"x>y\">d</p><script><!-- x </script><p>tail", "a <b> c d tail"),
        ("<nav><a>only</a> menus</nav>", ""), ("", ""), (None, ""), ("<article>" + "<p>k</p>" * 3000 + "</article>", " ".join(["k"] * 3000)), ("<p <a <<b>> < 3", None),
    ]
    df = spark.createDataFrame([(i, None if i == 1 else f"u{i}", h, "text") for i, (h, _) in enumerate(pages)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract(df.union(df.limit(1))).collect()}
    for i, (_, want) in enumerate(pages):
        assert want is None or got[i].text == want
        assert got[i].n_chars == len(got[i].text)


def article(page):
    """The article element's text, block by block, by plain patterns; enough for the test tables' pages."""
    found = re.search(r"<article>(.*?)</article>", page, re.S)
    parts = re.split(r"<(?:/?(?:p|h1|div)|br)[^>]*>", found[1] if found else "")
    return " ".join(t for p in parts if (t := " ".join(html.unescape(re.sub(r"</?b>", "", p)).split())))


def test_html_of_the_tables():
    """On every page the article; nearly so on pages whose marks are taken away, where words and links alone decide."""
    import pyarrow.parquet as pq

    pages = [p or "" for sf in ("sf0.001", "sf0.1") for p in pq.read_table(f"/root/testdata/{sf}/pages.parquet")["html"].to_pylist()]
    both = more = 0
    for p in pages:
        want = article(p)
        assert html_text.main_text(p) == want
        bare = re.sub(r"<(/?)(article|nav|footer|h1)\b[^>]*>", r"<\1div>", p).replace(' class="ad"', "")
        got, words = collections.Counter(html_text.main_text(bare).split()), collections.Counter(want.split())
        both += 2 * (got & words).total()
        more += got.total() + words.total()
    assert both / more > 0.99


def test_html_tree_uses_counts_and_densities():
    x, y = html_text.labelled()
    assert (html_text.TREE.predict(x) == y).mean() > 0.98

    def used(node):
        return set() if isinstance(node, bool) else {html_text.FEATURES[node[0]]} | used(node[2]) | used(node[3])

    assert {"words", "links", "words_before", "links_before", "words_after", "links_after"} <= used(html_text.TREE.root)


def test_html_of_empty_tables_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", "<p>" + "w " * 50 + "</p>", "t", 3, 4)], "page_id int, url string, html string, text string, n_chars int, kept int")
    assert html_text.extract(df.limit(0)).collect() == []
    assert [tuple(r) for r in html_text.extract(df).collect()] == [(1, "u", ("w " * 50).strip(), 99)]
    deep = "<div>" * 3000 + "x " * 30 + "</div>" * 3000
    assert html_text.main_text(deep) == ("x " * 30).strip()


# --- 5 ---------------------------------------------------------------------------------------------------------------


def brute_dice(found, grams):
    """Best Dice coefficient of any passage with a template's bigrams."""
    best = 0.0
    for a in range(len(found) - 1):
        for z in range(a + 1, min(len(found), a + 4 * len(grams) + 2)):
            mine = set(zip(found[a:z], found[a + 1 : z + 1], strict=True))
            best = max(best, 2 * len(mine & grams) / (len(mine) + len(grams)))
    return best


def test_licenses(spark):
    rng = random.Random(7)
    mit = licenses.TEMPLATES[2][1]
    texts = [None, "", prose(rng, 30), f"{prose(rng, 20)}\n{mit}\n{prose(rng, 20)}", "Licensed under the  APACHE license, version 2.0", mit.replace("under the MIT", "by some other"), "the MIT License the MIT License", mit + " " + mit]
    got = {r.doc_id: r.matches for r in licenses.scan(corpus(spark, texts)).collect()}
    assert [len(got[i]) for i in range(8)] == [0, 0, 0, 1, 1, 0, 0, 2]
    assert got[3][0].license == "MIT" and got[4][0].license == "Apache-2.0" and got[3][0].dice == 1
    scanner = licenses.scanner()
    for t in [f"{prose(rng, 6)} {s} {prose(rng, 5)}" for _, s in licenses.TEMPLATES if len(s) < 120]:
        mangled = " ".join(w for w in t.split() if rng.random() > 0.08)
        found = decontaminate.words(mangled.encode())
        want = max(brute_dice(found, {(x, y) for x, y in zip(g, g[1:])}) for g in (decontaminate.words(s.encode()) for _, s in licenses.TEMPLATES if len(s) < 120))
        mine = max((m.dice for m in scanner.scan(mangled.encode())), default=0.0)
        assert mine == pytest.approx(want) if want >= 0.8 else mine == 0


def test_licence_versions_and_families():
    """Each template comes back as itself, between other words and with a few of its own changed; none as a relative."""
    scan = licenses.scanner().scan
    for name, text in licenses.TEMPLATES:
        assert [m.license for m in scan(f"foo bar {text} baz".encode())] == [name]
    full = [(n, t) for n, t in licenses.TEMPLATES if len(t) > 1000]
    assert {"GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "Apache-2.0", "MPL-2.0", "BSD-3-Clause"} <= {n for n, _ in full}
    for name, text in full:
        w = text.split()
        w[25::50] = ["other"] * len(w[25::50])
        assert [m.license for m in scan(" ".join(w).encode())] == [name]
    gpl = next(t for n, t in licenses.TEMPLATES if n == "GPL-3.0" and "redistribute" in t)
    for name, words, version in [("GPL-2.0", "General", "2"), ("LGPL-2.1", "Lesser General", "2.1"), ("AGPL-3.0", "Affero General", "3"), ("LGPL-3.0", "Lesser General", "3")]:
        notice = gpl.replace("General", words).replace("version 3", f"version {version}")
        assert [m.license for m in scan(notice.encode())] == [name]
    bsd = next(t for n, t in licenses.TEMPLATES if n == "BSD-3-Clause" and "endorse" in t)
    assert [m.license for m in scan(bsd.replace("the copyright holder", "Foo Inc").encode())] == ["BSD-3-Clause"]
    assert [m.license for m in scan(b"Licensed under the Apache License, Version 1.1")] == ["Apache-1.1"]


def test_licence_padded_by_repeated_words():
    rng, scan = random.Random(17), licenses.scanner().scan
    grams = {n: {(x, y) for x, y in zip(w, w[1:])} for n, w in ((s, decontaminate.words(s.encode())) for _, s in licenses.TEMPLATES if len(s) < 120)}
    for text in ["Licensed under the the the the the the the the the the the the the the the the the the the the the the the the the the the the the the the the the the the the Apache License, Version 2.0."] + [
        " ".join(w for v in s.split() for w in [v] * (rng.choice([1, 40]) if v == s.split()[3] else 1)) for s in grams
    ]:
        found = decontaminate.words(f"foo {text} bar".encode())
        want = 0.0
        for a in range(len(found) - 1):
            for z in range(a + 1, len(found)):  # without a bound on the words of a passage
                mine = set(zip(found[a:z], found[a + 1 : z + 1], strict=True))
                want = max(want, *(2 * len(mine & g) / (len(mine) + len(g)) for g in grams.values()))
        got = scan(f"foo {text} bar".encode())
        assert max((m.dice for m in got), default=0.0) == pytest.approx(want if want >= 0.8 else 0.0)
    name, text = next((n, t) for n, t in licenses.TEMPLATES if n == "GPL-3.0" and "redistribute" in t)
    half = text.index("This program is distributed")
    assert [m.license for m in scan(f"{text[:half]} {'all rights ' * 400} {text[half:]}".encode())] == [name]


# --- 6 ---------------------------------------------------------------------------------------------------------------


def brute_classes(rows, k, num=80, den=100):
    """rows: (id, text). {id: (set size, component)} for unique ids."""
    lower = {c: c + 32 for c in range(65, 91)}
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("k", "block"), [(2, near_dedup.BLOCK), (2, 8), (5, near_dedup.BLOCK)])
def test_near_dedup(spark, texts, k, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)  # small: groups are cut, and blocks compared with each other
    rng, more = random.Random(8), list(texts)
    base = prose(rng, 90).split()
    for i in range(60):  # a large group of near copies, some too far from all others
        w = list(base)
        for j in rng.sample(range(90), rng.randint(0, 9)):
            w[j] = f"z{i}{j}"
        more.append(" ".join(w))
    more += ["a b c d e", "a b c d e f", "a b c d", "q r s t u v w", "q r s t u v w x", "\x1ca\x1cb", "A\xa0B"]
    rows = list(enumerate(more))
    got = {r.id: (r.n_shingles, r.component_id) for r in near_dedup.classes(corpus(spark, more), k=k).collect()}
    assert got == brute_classes(rows, k)


def test_near_dedup_low_threshold(spark):
    """Small sets at similarities of 1/2 and 2/3, and larger ones just above 1/2, link as by brute force."""
    rng, more = random.Random(18), []
    for i in range(60):
        w = [f"s{i}x{j}" for j in range(4)]
        more += [" ".join(w[: 2 + i % 2]), " ".join(w[: 3 + i % 2])]
    for i in range(40):
        w = [f"l{i}x{j}" for j in range(90)]
        more += [" ".join(w), " ".join(w[:46])]
    more += [prose(rng, 30) for _ in range(20)]
    got = {r.id: (r.n_shingles, r.component_id) for r in near_dedup.classes(corpus(spark, more), k=2, at_least=(50, 100)).collect()}
    assert got == brute_classes(list(enumerate(more)), 2, 50, 100)
    with pytest.raises(ValueError):
        near_dedup.classes(corpus(spark, more), k=2, at_least=(5, 100))


def test_near_dedup_edge_tables(spark):
    assert near_dedup.classes(corpus(spark, ["x"]).limit(0), k=2).collect() == []
    twice = spark.createDataFrame([(5, "a b c"), (5, "a b c"), (None, "a b c"), (7, "z")], "doc_id long, text string")
    assert sorted((r.id or -1, r.component_id) for r in near_dedup.classes(twice, k=2).collect()) == [(-1, 5), (5, 5), (5, 5), (7, 7)]


def test_register_estimate():
    rng = np.random.default_rng(2)
    for n, shared in ((400, 360), (40, 36), (3000, 1500)):
        pool = rng.integers(0, 1 << 63, 2 * n - shared, np.uint64)
        a, b = np.unique(pool[:n]), np.unique(pool[n - shared :])
        j = shared / (2 * n - shared)
        est = near_dedup.estimate(near_dedup.registers(a), near_dedup.registers(b)[None, :], n, np.array([n]))[0]
        assert abs(est - j) < near_dedup.margin(np.array([n]))[0]


# --- 7 ---------------------------------------------------------------------------------------------------------------


def brute_hits(texts, items):
    lower = {c: c + 32 for c in range(65, 91)}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(i)
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for k in range(len(w)):
            for n in range(1, 11):
                if k + n <= len(w) and (of := windows.get(tuple(w[k : k + n]))):
                    hit |= set(range(k, k + n))
                    found |= of
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WORDS, 20])
def test_decontaminate(spark, texts, block):
    rng = random.Random(9)
    item = prose(rng, 30)
    items = [(1, item), (2, item), (10, prose(rng, 9)), (11, "solo"), (12, "the the the the"), (13, None), (14, ""), (None, "alpha"), (15, "café 中文 x1 y2")]
    more = [*texts, "pre " + item + " post", item.upper().replace(" ", "--"), "Solo, it is solo", "the the the the the the", " ".join(item.split()[5:14]), " ".join(item.split()[5:15]), "CAFÉ café 中文 X1 y2"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.report(decontaminate.hits(corpus(spark, more), bench, block)).collect()}
    want = dict(enumerate(brute_hits(more, [(i, t) for i, t in items if i is not None])))
    assert got == want and any(w[4] for w in want.values())
    kept = decontaminate.clean(corpus(spark, more), bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, w in want.items() if not w[4]} and kept.columns == corpus(spark, ["x"]).columns
    none = decontaminate.hits(corpus(spark, more), bench.limit(0))
    assert none.filter(F.size("hit") > 0).count() == 0


def test_decontaminate_items_without_id(spark, tmp_path):
    """The query equals its SQL, and the pipeline's stage drops what such items leak to."""
    import duckdb

    import corpus_pipeline
    from graphloom.llm.registry import ORACLES

    rng = random.Random(19)
    a, b, c = (prose(rng, 14) for _ in range(3))
    items = [(None, a), (None, b), (7, b), (8, c), (None, None), (None, "")]
    docs = list(enumerate([f"x {a} y", f"x {b}", c, f"{a} {b} {c}", "nothing of it", None]))
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = decontaminate.op7_decontaminate(spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(ORACLES["op7_decontaminate"])
    at = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(*at).collect())) == sorted(want.fetchall())
    assert {r.doc_id: r.n_items for r in got.collect()} == {0: 1, 1: 2, 2: 1, 3: 3, 4: 0, 5: 0}
    stage = corpus_pipeline.decontaminate_stage(spark, spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path))
    assert {r.doc_id for r in stage.collect()} == {4, 5}


# --- 8 ---------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers as public
    import tiktoken

    path = public.path("byte_bpe_multi_50k.tiktoken")
    return path, public.PATTERN, tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def test_bpe_equals_the_library(vocabulary, texts):
    path, pattern, other = vocabulary
    codec, rng = bpe.codec(path, pattern), random.Random(10)
    odd = ["".join(rng.choice(" \n\t\x0b\x1c\x85\xa0 　ab'séÉ中1²​<|endoftext|>😀") for _ in range(rng.randint(0, 90))) for _ in range(800)]
    for t in [x or "" for x in texts] + odd + ["a" * 5000, " " * 300 + "x", "don't we'll 'S"]:
        ids = codec.encode(t)
        assert ids == other.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()


def test_perfect_hash_is_minimal(vocabulary):
    codec = bpe.codec(*vocabulary[:2])
    assert sorted(map(codec.hash.lookup, codec.ranks)) == list(range(len(codec.ranks)))
    tiny = bpe.PerfectHash([b"x"])
    assert tiny.lookup(b"x") == 0 and bpe.PerfectHash([]).lookup(b"y") == 0


def test_bpe_digest(spark, vocabulary, texts):
    path, pattern, other = vocabulary
    got = {r.doc_id: tuple(r)[1:] for r in bpe.digest(corpus(spark, texts), path, pattern).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {i: (len(ids := other.encode_ordinary(t or "")), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t in enumerate(texts)}


def test_toxicity_wide_vocabulary(spark):
    """More insults than the 150 and 2,000 entries that a lexicon was once cut to; each document has only one of them."""
    rng = random.Random(23)
    insults = ["".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(3)) for _ in range(420)]
    rows = [(f"{prose(rng, 9)} {w} {prose(rng, 9)}", 1) for w in insults for _ in range(5)] + [(prose(rng, 19), 0) for _ in range(2100)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert len(model.lexicon) > 150
    fresh = [f"{prose(rng, 9)} {w} {prose(rng, 9)}" for w in insults]
    got = {r.doc_id: r.predicted for r in toxicity.score(corpus(spark, fresh + [prose(rng, 19) for _ in range(100)]), model).collect()}
    assert sum(got[i] for i in range(420)) >= 400 and not any(got[i] for i in range(420, 520))


# --- 10 --------------------------------------------------------------------------------------------------------------


def brute_top(rows, k):
    ok = [(n, i, np.floor(np.array(v, float) * 256)) for n, (i, v) in enumerate(rows) if v is not None and len(v) == 8 and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for n, q, x in ok:
        if q is not None and q % 10 == 0:
            scored = sorted(((-int(x @ y), i is None, i) for m, i, y in ok if m != n), key=lambda t: (t[0], t[1], t[2] or 0))[:k]
            out += [(q, r + 1, i, -s) for r, (s, _, i) in enumerate(scored)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("shard", "leaf"), [(topk.SHARD, topk.LEAF), (100, 16), (400, 1)])
def test_topk(spark, shard, leaf, monkeypatch):
    monkeypatch.setattr(topk, "LEAF", leaf)
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=8).astype(np.float32)]) for i in range(600)]
    same = rows[3][1]
    rows += [(i, same) for i in range(600, 1000)]  # a common vector: many ties
    rows += [(1000, None), (1010, [None] + [0.0] * 7), (1020, [float("nan")] * 8), (1030, [float("inf")] * 8), (None, same), (1040, [0.1]), (1050, []), (1060, [0.0] * 8)]
    rows += [(20, same), (20, rows[20][1]), (30, [5.0] * 8), (30, [5.0] * 8), (None, [9.0] * 8), (1070, [-0.001] * 8)]  # repeated ids: each row is a query, and a candidate of the others
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("row", F.lit("x")).repartition(3)
    got = sorted(map(tuple, topk.top_k(df, F.col("id") % 10 == 0, shard_rows=shard).collect()), key=str)
    assert got == brute_top(rows, 5)


def test_topk_prunes_by_boxes():
    """On clustered vectors a search opens few leaves; it equals a full scan, also when kth comes from elsewhere."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 6)) * 300
    x = np.floor(centres[np.repeat(np.arange(40), 200)] + rng.normal(size=(8000, 6)) * 3)
    ids = rng.permutation(8000)
    tree, q = topk.Tree(ids, x), x[:30]
    assert (tree.child >= 0).sum() > 20
    for n in range(len(tree.first)):
        part = tree.x[tree.first[n] : tree.last[n]]
        assert (part.min(0) == tree.low[n]).all() and (part.max(0) == tree.high[n]).all()
    seen = []
    for at in range(30):
        scores = x @ q[at]
        want = sorted(zip(-scores[np.arange(8000) != at], ids[np.arange(8000) != at], strict=True))[:5]
        for kth in (-np.inf, -want[4][0]):
            touched = []
            tree.x = Counted(np.asarray(tree.x), touched)
            r, place, s = tree.search(np.array([at]), q[at : at + 1], np.array([kth]), 5, np.arange(8000)[tree.order])
            assert sorted(zip(-s, tree.ids[place], strict=True)) == want
            seen.append(sum(touched))
    assert np.mean(seen) < 8000 / 4


class Counted:
    """Rows of a matrix, counting those that are read."""

    def __init__(self, x, touched):
        self.x, self.touched = x, touched

    def __getitem__(self, at):
        self.touched.append(at.stop - at.start)
        return self.x[at]

    def __array__(self, dtype=None, copy=None):
        return self.x


def test_cells_are_even_and_cover_all():
    x = np.random.default_rng(5).normal(size=(3000, 4))
    for n in (1, 2, 7, 16):
        counts = np.bincount(topk.Cells(x, n).of(x))
        assert len(counts) == n and counts.min() > 0.4 * 3000 / n
    assert topk.Cells(np.zeros((50, 4)), 8).of(x).max() == 0
    assert topk.Cells(np.array([[0.0]] * 9 + [[1.0]]), 4).of(np.array([[0.0], [1.0], [7.0]])).tolist()[1:] == [topk.Cells(np.array([[0.0]] * 9 + [[1.0]]), 4).of(np.array([[1.0]]))[0]] * 2


def test_topk_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.5]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, F.col("id") % 50 == 0).collect()] == [(0, 1, 1, 256 * 128 + 128 * 128)]
    assert topk.top_k(df.limit(0), F.col("id") % 50 == 0).collect() == []
    assert topk.top_k(df.limit(1), F.col("id") % 50 == 0).collect() == []


def test_folds_follow_crc32(spark):
    from graphloom.llm.common import fold

    rows = spark.range(50).select("id", fold(F.col("id"), 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in rows)
