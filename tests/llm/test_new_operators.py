"""Operators 11 to 13 against brute force, enumeration and held-out pages, and on odd input."""

import itertools
import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestead.llm import html_blocks, html_extraction, importance_resampling, source_audit

DOCS = "doc_id long, text string, _w string, row int"
LONG = " ".join(f"w{i % 997}" for i in range(30_000))
ODD = [(1, None, None, 1), (2, "", "x", None), (3, " \t\n ", "x", 1), (4, LONG, "x", 1), (4, LONG, "x", 1), (None, "alpha beta " * 30, None, 1), (5, "the one", "a", 1), (6, "the one", "a", 1), (7, LONG, "b", 2)]


# ---------------------------------------------------------------- 11
def _resampled(docs, target, percent, least, buckets, grams):
    def features(text):
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        return words, [zlib.crc32(b" ".join(words[i : i + n])) % buckets for n in range(1, grams + 1) for i in range(len(words) - n + 1)]

    s, t = (Counter(x for d in side for x in features(d)[1]) for side in ([d for _, d in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * float(s.total() + buckets) / ((s[b] + 1) * float(t.total() + buckets))))
    rows = []
    for i, text in docs:
        words, f = features(text)
        h = int(sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, f))
        rows.append([i, len(words), len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    for n, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = n + 1
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("percent, grams", [(10, 1), (37, 2), (100, 3), (0, 1)])
def test_resampling_equals_brute_force(spark, percent, grams):
    rng = random.Random(percent)
    word = lambda: rng.choice(["Alpha", "bêta", "GAMMA", "d3lta", "Ünder", "rho", "x" * 70, "日本"])
    docs = [(i if i % 40 else None, rng.choice([" ", ", ", "_"]).join(word() for _ in range(rng.choice([0, 3, 19, 20, 60])))) for i in range(300)] + [(900, None)]
    target = [" ".join(word() for _ in range(30)) for _ in range(5)] + [None]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = importance_resampling.resample(d, spark.createDataFrame([(t,) for t in target], "text string"), percent, 20, 500, grams)
    want = _resampled(docs, target, percent, 20, 500, grams)
    key = lambda r: tuple(r[:5])
    assert sorted(map(key, got.collect()), key=repr) == sorted(map(key, want), key=repr)
    # rows that repeat a (null) id and a text are equal, so which of them has which rank is free
    assert sorted(((r[5], r[4]) for r in got.collect()), key=repr) == sorted(((r[5], r[4]) for r in want), key=repr)


def test_the_kth_key_is_found_for_every_k(spark):
    rng = random.Random(1)
    keys = [(rng.randrange(6), i % 9 == 0, rng.randrange(8), i) for i in range(150)]
    d = spark.createDataFrame(keys, "neg long, late boolean, id long, tie long").repartition(3).cache()
    for k in (1, 2, 75, 149, 150):
        assert importance_resampling.kth_key(d, k, 4) == sorted(keys)[k - 1]
    assert importance_resampling.kth_key(d, 0) is None and importance_resampling.kth_key(d, 151) is None


def test_checksums_of_short_and_long_words():
    words = [b"", b"a", b"abc", b"x" * 47, b"y" * 48, b"z" * 5000, "é日".encode()]
    buf = np.frombuffer(b"".join(words), np.uint8)
    to = np.cumsum([len(w) for w in words])
    at = to - [len(w) for w in words]
    assert importance_resampling.checksums(buf, at, to).tolist() == [zlib.crc32(w) for w in words]
    before = np.array([zlib.crc32(b"p ")] * len(words), np.uint32)
    assert importance_resampling.checksums(buf, at, to, before).tolist() == [zlib.crc32(b"p " + w) for w in words]


def test_resampling_on_odd_input(spark):
    odd, none = spark.createDataFrame(ODD, DOCS), spark.createDataFrame([], DOCS)
    got = importance_resampling.resample(odd, odd.limit(0), 50).collect()
    assert len(got) == len(ODD) and sorted(r.rank for r in got if r.rank) == [1, 2] and {r.n_features for r in got} == {0, 2, 60, 30_000}
    hot = spark.range(400).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a " * 25).alias("text"))
    ranks = [r.rank for r in importance_resampling.resample(hot, hot).collect()]
    assert sorted(x for x in ranks if x) == list(range(1, 41)) and len(ranks) == 400
    assert importance_resampling.resample(none, odd).count() == 0


# ---------------------------------------------------------------- 12
def _audited(rows, least, top):
    out, langs = [], {}
    for text, lang, source in rows:
        terms = Counter(w.decode() for w in re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())))
        langs.setdefault(lang or "", []).append((source or "", terms))
    for lang, docs in langs.items():
        df = Counter(t for _, c in docs for t in c)
        kept = sorted(t for t in df if df[t] >= least)
        groups = {s: Counter() for s, _ in docs}
        for s, c in docs:
            groups[s].update({t: n for t, n in c.items() if t in set(kept)})
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (c.total() + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in groups.items()}, share(sum(groups.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in groups:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(sorted(terms)[:top])]
    return sorted(out)


@pytest.mark.parametrize("rows_at_once", [source_audit.ROWS, 40])
def test_audit_equals_brute_force(spark, monkeypatch, rows_at_once):
    rng = random.Random(7)
    words = ["Alpha", "alpha", "bêta", "GAMMA", "d3lta", "日本", "Ünder", "ünder", "rho", "eta", "iota"] + [f"r{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    pool = [" ".join(rng.choice(words) for _ in range(rng.randrange(30))) for _ in range(60)]
    rows = [(rng.choice(pool), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "é", "z", None, ""])) for _ in range(250)]
    rows += [(pool[3], "en", "a")] * 120 + [("12 34", "xx", "a"), (None, "xx", "b"), ("only one", "yy", "a")]
    monkeypatch.setattr(source_audit, "ROWS", rows_at_once)
    d = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    assert sorted(map(tuple, source_audit.audit(d, 3, 7).collect())) == _audited(rows, 3, 7)


def test_audit_of_many_sources_and_odd_input(spark):
    rows = [(f"common t{i % 7} u{i % 3}", "en", f"s{i}") for i in range(90)] + [(LONG, "en", "s0")]
    d = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(map(tuple, source_audit.audit(d).collect())) == _audited(rows, 3, 200)
    none = spark.createDataFrame([], "text string, lang string, source string, n long, terms long, total long")
    assert source_audit.audit(none).count() == 0
    odd = spark.createDataFrame([("a a a", None, None, 1, 2, 3), ("a", None, None, 1, 2, 3), ("A", "", "x", 1, 2, 3)], none.schema)
    assert sorted(map(tuple, source_audit.audit(odd).collect())) == _audited([("a a a", "", ""), ("a", "", ""), ("A", "", "x")], 3, 200)


def test_common_terms_wait_for_their_rows_across_batches():
    import pyarrow as pa

    rng = random.Random(2)
    rows = sorted((lang, f"t{t}", s, rng.randrange(1, 900), 3) for lang in ("de", "en") for t in range(40) for s in rng.sample("abcdef", rng.randrange(1, 6)))
    names = ["lang", "term", "source", "p", "p0"]

    def sums(size):
        cut = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[i : i + size]]) for i in range(0, len(rows), size)]
        got = Counter()
        for b in source_audit._common(iter(cut)):
            for r in b.to_pylist():
                got[r["lang"], r["source"], r["other"]] += r["value"]
        return got

    want, f = Counter(), lambda a, b: (a - b) ** 2 // b
    for (la, ta, a, pa_, za), (lb, tb, b, pb, zb) in itertools.product(rows, rows):
        if (la, ta) == (lb, tb) and a != b:
            want[la, a, b] += f(pa_, pb) - f(pa_, zb) - f(za, pb) + f(za, zb)
    assert sums(1) == sums(7) == sums(1_000) == want


# ---------------------------------------------------------------- 13
def _all_paths(score, step):
    n = len(score)
    value = {y: sum(s for s, k in zip(score, y) if k) + sum(step[a][b] for a, b in zip(y, y[1:])) for y in itertools.product((0, 1), repeat=n)}
    return value, math.log(sum(map(math.exp, value.values())))


def test_forward_backward_and_viterbi_equal_all_paths():
    rng = np.random.default_rng(3)
    step, score, length = rng.normal(size=(2, 2)), rng.normal(size=(5, 7)) * 2, np.array([7, 1, 4, 6, 2])
    z, one, pairs = html_extraction.forward_backward(score, length, step)
    want = np.zeros((2, 2))
    for i, n in enumerate(length):
        value, log_z = _all_paths(score[i, :n], step)
        assert math.isclose(z[i], log_z, rel_tol=1e-9)
        for t in range(n):
            assert math.isclose(one[i, t], sum(math.exp(v - log_z) for y, v in value.items() if y[t]), rel_tol=1e-9)
        for y, v in value.items():
            for a, b in zip(y, y[1:]):
                want[a, b] += math.exp(v - log_z)
        assert tuple(html_extraction.viterbi(score[i, :n].tolist(), step.tolist())) == max(value, key=value.get)
    assert np.allclose(pairs, want) and html_extraction.viterbi([], step.tolist()) == []


def _accuracy(pages, weights, step):
    w, s = weights.tolist(), step.tolist()
    right = total = 0
    for _, bits, labels in pages:
        got = html_extraction.viterbi([sum(w[i] for i in html_blocks.numbers(x)) for x in bits], s)
        right, total = right + sum(a == b for a, b in zip(got, labels)), total + len(labels)
    return right / total


def test_the_field_labels_pages_that_it_was_not_trained_on():
    pages = html_extraction.labelled_pages(150, 4_711)
    assert _accuracy(pages, *html_extraction.trained()) > 0.98
    assert _accuracy(pages, np.zeros(len(html_blocks.NAMES)), np.zeros((2, 2))) < 0.8


def _article(html):
    inner = re.search(r"<article>(.*)</article>", html, re.S)[1]
    return " ".join(unescape(re.sub(r"</?(p|br|h1)>", " ", inner).replace("<b>", "")).split())


@pytest.mark.parametrize("change", [{}, {"<article>": "<div>", "</article>": "</div>"}, {"article": "section", "<nav>": '<div class="menu">', "</nav>": "</div>", "<footer>": '<div id="footer">', "</footer>": "</div>"}])
def test_all_pages_of_the_table_are_extracted_whole(spark, data, change):
    d = spark.read.parquet(f"{data}/pages.parquet")
    want = {r.page_id: _article(r.html) for r in d.collect()}
    html = F.col("html")
    for a, b in change.items():
        html = F.replace(html, F.lit(a), F.lit(b))
    got = {r.page_id: r.text for r in html_extraction.extract(d.withColumn("html", html)).collect()}
    assert sum(got[i] == t for i, t in want.items()) >= 0.98 * len(want)
    if not change:
        assert got == want


PAGES = {
    "news": (
        """<body class="has-sidebar"><div id="cookie-banner">We use cookies.<button>OK</button></div><header><h1>Daily</h1><ul class="menu"><li><a href="/">Home</a><li><a href="/x">World</a></ul></header>
<main><h1>Rain in the north</h1><p>It rained for <b>three</b> days &amp; nights in the north of the country, and rivers rose.</p><div class="ad-box">Buy boots now!</div><p>Then the sun came out again, and people went back to their homes.</p>
<form class="newsletter"><label>Mail</label><input><button>Subscribe</button></form><h2>What comes next</h2><p>More rain is expected by the end of the week.</p></main>
<section id="comments"><div class="comment"><p>I liked the rain very much, it was good for my garden.</p></div></section><aside><h3>Related</h3><a href="/y">Snow in the south</a></aside><footer>&copy; Daily 2020</footer></body>""",
        "Rain in the north It rained for three days & nights in the north of the country, and rivers rose. Then the sun came out again, and people went back to their homes. What comes next More rain is expected by the end of the week.",
    ),
    "blog": (
        """<div class="wrap"><div class="topnav"><a href="/">Blog</a> | <a href="/about">About</a></div><div class="post-content"><h1>My cat</h1>My cat sleeps all day on the sofa, as cats do.<br><br>It eats at night, when nobody sees it.<script>x("<p>no</p>")</script>
<blockquote>A cat is a cat, said my aunt.</blockquote></div><div class="sidebar widget"><p>This author writes about cats and other things.</p></div><ol class="commentlist"><li>What a lovely cat you have there!</ol><div id="footer"><p>All rights reserved.</p></div></div>""",
        "My cat My cat sleeps all day on the sofa, as cats do. It eats at night, when nobody sees it. A cat is a cat, said my aunt.",
    ),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_pages_of_other_makes(name):
    html, want = PAGES[name]
    w, s = html_extraction.trained()
    assert html_extraction.main_text(html, w.tolist(), s.tolist(), {}) == want


@pytest.mark.parametrize(
    "html, texts",
    [
        (None, []), ("", []), ("<p>", []), ("plain &lt;b&gt; 1 < 2 &am", ["plain <b> 1 < 2 &am"]), ("<p>a<p>b<div>c</p>d", ["a", "b", "c", "d"]), ("<ul><li>a<li>b<ul><li>c</ul>d</ul>", ["a", "b", "c", "d"]),
        ("a<!-- x <p> -->b<!-->c<!-- open", ["abc"]), ("<p title='a>b'>x</p><p title=it's>y", ["x", "y"]), ("a<script>if (1<2) '</p>'</script>b<STYLE>c</Style >d", ["abd"]), ("<title>t</title>a&nbsp;\n b", ["a b"]),
        ("a</nope></div>b", ["a", "b"]), ("x<b>y</i>z</b> <a href=q", ["xyz"]), ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]), ("&#0;&#xD800;&#99999999;a", ["���a"]),
    ],
)
def test_leaf_blocks(html, texts):
    assert html_blocks.read(html)[0] == texts


def test_deep_and_long_pages_take_linear_time():
    deep = "<div class='a'>" * 20_000 + "x" + "</div>" * 20_000 + "<p>y" * 20_000 + "<a b=\"" * 5_000
    assert len(html_blocks.read(deep)[0]) == 20_001
    assert html_blocks.read("<p>" + "word " * 200_000)[0][0].count(" ") == 199_999


def test_extraction_on_odd_input(spark):
    rows = [(1, "u", None, "t", 1), (1, "u", None, "t", 1), (None, None, "<article><p>One sentence is here.</p></article>", None, None), (2, "u", "", "t", 2), (3, "u", "<nav><a href=/>x</a></nav>", "t", 3), (4, "u", "<article><p>" + "A long line, with words. " * 20_000, "t", 4)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, c0 string, `a.b` long")
    got = html_extraction.extract(d)
    assert got.columns == ["page_id", "url", "c0", "a.b", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.n_chars, r.text[:20]) for r in got.collect()) == [(0, 21, "One sentence is here"), (1, 0, ""), (1, 0, ""), (2, 0, ""), (3, 0, ""), (4, 499_999, "A long line, with wo")]
    assert html_extraction.extract(d.limit(0)).count() == 0
