"""Whole results of the searching and scoring operators against brute force, and odd input of every operator and stage."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestead.llm import byte_bpe, chat_format, decontamination, line_dedup, lm_scoring, ngram_join, quality_rules, toxicity, url_filters

LONG = "\n".join(" ".join(f"w{(i * 7 + k) % 997}" for k in range(12)) for i in range(2_500))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, key long, component string, row long, n string"
ODD = [(1, None), (2, ""), (3, " \t\n "), (4, LONG), (4, LONG), (None, "alpha beta " * 30), (5, "the one"), (6, "the one"), (7, LONG), (8, "x" * 40_000), (9, "\u0000﻿ é\n\n日本 " * 20)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, "s", None, "dots", 1, "c", 2, "n") for i, t in ODD], DOCS)


def _edit_row(item, text):
    """Least edits of the item and stretches of the text that end at each place."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(text):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row


def test_contaminated_stretches_equal_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(400)]
    bench = [(i, [rng.choice(vocab) for _ in range(rng.randint(5, 24))]) for i in range(12)]
    docs = []
    for k in range(60):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            x = list(rng.choice(bench)[1])
            for _ in range(rng.randint(0, 3)):
                p = rng.randrange(len(x))
                x[p : p + 1] = rng.choice([[], [rng.choice(vocab)], [x[p], rng.choice(vocab)]])
            p = rng.randint(0, len(words))
            words[p:p] = x
        docs.append((k, words))
    want = set()
    for k, words in docs:
        for i, item in bench:
            row = _edit_row(item, words)
            least = min(row)
            if least <= decontamination.edits_allowed(len(item), decontamination.MAX_EDITS):
                end = row.index(least)
                back = words[:end][::-1]
                sizes = [(_full(item[::-1], back[:n]), n) for n in range(min(end, 2 * len(item)) + 1)]
                n = min(sizes)[1]
                want.add((k, i, end - n, n, least))
    got = decontamination.matches(spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in bench], "item_id long, text string"))
    got = {tuple(r) for r in got.collect()}
    assert {x[:2] for x in want} == {x[:2] for x in got} and len(want) > 20
    assert {(x[0], x[1], x[4]) for x in want} == {(x[0], x[1], x[4]) for x in got} and len(want - got) <= len(want) // 20


def _full(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_decontamination_on_odd_input(spark, odd):
    items = spark.createDataFrame([(None, "alpha beta alpha beta alpha beta"), (1, None), (2, "the one"), (3, "w0 w1 w2 w3 w4 w5 w6 w7"), (3, "x y z u v w"), (None, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.matches(odd, items).collect()}
    assert got == {(4, 3), (7, 3)}
    assert decontamination.matches(odd, items).count() == 3
    left = decontamination.drop_contaminated(odd, items)
    assert left.columns == odd.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 3, 5, 6, 8, 9]
    assert decontamination.drop_contaminated(odd, items.limit(0)).count() == len(ODD) and decontamination.drop_contaminated(odd.limit(0), items).count() == 0


def test_toxicity_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LEAST_TOXIC", 2)
    rng = random.Random(4)
    calm, bad = [f"calm{i}" for i in range(60)] + ["said", "you", '"', "and"], ["idiotic", "moronic", "disgustingly", "scum"]
    texts = {}
    for i in range(240):
        w = [rng.choice(calm) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(1, 3) if i % 4 == 0 else 0):
            t = rng.choice(bad)
            if rng.random() < 0.3:
                p = rng.randrange(len(t))
                t = t[:p] + rng.choice("xyz") + t[p + rng.randint(0, 1) :]
            w.insert(rng.randint(0, len(w)), t)
        texts[i] = " ".join(w)
    labels = {i: int(i % 4 == 0) for i in texts if i % 7}
    docs, y = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string"), spark.createDataFrame(sorted(labels.items()), "doc_id long, toxic int")

    learned = {i for i in labels if zlib.crc32(str(i).encode()) % 5}
    word = lambda t: re.findall(r"[^\W_]+", t.lower())
    counts = {k: Counter(w for i in learned if labels[i] == k for w in set(word(texts[i]))) for k in (0, 1)}
    pos, neg = (sum(labels[i] == k for i in learned) for k in (1, 0))
    odds = {w: math.log((counts[1][w] + 0.5) / (pos + 1)) - math.log((counts[0][w] + 0.5) / (neg + 1)) for w in counts[0] | counts[1]}
    terms = [w for w in sorted(odds, key=lambda w: (-odds[w], w)) if len(w) >= 3 and odds[w] >= toxicity.LEAST_ODDS and counts[1][w] >= max(2, pos // 100)]

    def nearest(w):
        return min(((e, k) for k, t in enumerate(terms) if abs(len(t) - len(w)) <= 2 and (e := _full(w, t)) <= toxicity.edits_for(t)), default=None)

    near = {w: h for w in odds if odds[w] < toxicity.LEAST_ODDS and (h := nearest(w)) and h[0]}
    clean = {w for w in near if counts[0][w] >= 2}
    noise = Counter()
    for w, h in near.items():
        noise[terms[h[1]]] += counts[0][w] if counts[0][w] < 2 else 0
    strict = {t for t, n in noise.items() if n > toxicity.NOISE}

    def features(text):
        low, sums, found = text.lower(), [0.0, 0.0], set()
        spans = [(m.group(), *m.span()) for m in re.finditer(r"[^\W_]+", low)]
        for i, (w, a, z) in enumerate(spans):
            h = nearest(w)
            if h is None or (h[0] and (w in clean or terms[h[1]] in strict)):
                continue
            found.add(h[1])
            around = spans[max(0, i - toxicity.CONTEXT) : i + toxicity.CONTEXT + 1]
            marks = [sum(c in toxicity._QUOTES for c in low[p:q]) for p, q in ((around[0][1], a), (z, around[-1][2]))]
            quoted = (marks[0] % 2 == 1 and marks[1] > 0) or any(x[0] in toxicity.REPORTING for x in around)
            you = any(x[0] in toxicity.ADDRESS for x in around)
            share = (0.4 if you else 0.8) if quoted else 0.0
            weight = odds[terms[h[1]]] * (toxicity.MISSPELLED if h[0] else 1)
            sums = [sums[0] + weight * (1 - share), sums[1] + weight * share]
        return [math.log1p(sums[0]), math.log1p(sums[1]), len(found), math.log1p(100 * sum(sums) / max(1, len(spans)))]

    x = np.array([[1, *features(texts[i])] for i in sorted(learned)])
    t, beta, ridge = np.array([labels[i] for i in sorted(learned)]), np.zeros(5), np.diag([1e-3] + [0.5] * 4)
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta = beta + np.linalg.solve((x.T * (q * (1 - q))) @ x + ridge, x.T @ (t - q) - ridge @ beta)
    got = {r.doc_id: r for r in toxicity.score(docs, y).collect()}
    assert len(terms) >= 3 and near
    for i, text in texts.items():
        want = 1 / (1 + math.exp(-np.clip(np.array([1, *features(text)]) @ beta, -30, 30)))
        assert math.isclose(got[i].score, want, abs_tol=1e-4) and got[i].predicted == int(got[i].score >= 0.5) and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_toxicity_defines_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "c d"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.learn(docs, labels)[0] == toxicity.learn(docs.orderBy(F.desc("text")).coalesce(1), labels)[0]


def test_scores_and_ids_of_odd_texts(spark, odd):
    got = lm_scoring.score_texts(odd).select("doc_id", "n_tokens", "held_out", "score", "base_score").collect()
    sizes = Counter((r.doc_id, r.n_tokens) for r in got)
    assert sizes == Counter((i, len((t or "").encode().split()) + 1) for i, t in ODD) and all(r.score <= 0 and r.base_score < 0 for r in got)
    assert not next(r for r in got if r.doc_id is None).held_out
    labels = spark.createDataFrame([(4, 1), (5, 0)], "doc_id long, toxic int")
    assert Counter(r.doc_id for r in toxicity.score(odd, labels).where("score BETWEEN 0 AND 1").collect()) == Counter(i for i, _ in ODD)
    path = corpus_pipeline.tokenizers.path(corpus_pipeline.RANKS)
    back = byte_bpe.decode(byte_bpe.encode(odd, path, corpus_pipeline.tokenizers.PATTERN), path, corpus_pipeline.tokenizers.PATTERN).selectExpr("doc_id", "decode(decoded, 'utf-8') t").collect()
    assert Counter((r.doc_id, r.t) for r in back) == Counter((i, t or "") for i, t in ODD)


def test_chat_windows_of_odd_conversations(spark):
    rows = [(1, 0, "user", LONG, "x"), (1, 0, "user", LONG, "x"), (1, 1, "assistant", "ok", None), (2, 5, None, None, "x"), (3, 2**40, "assistant", "far", "x"), (3, -4, "user", "near", "x")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, `k.nil` string").withColumn("ord", F.lit(9)).withColumn("k", F.lit("k"))
    win = chat_format.windows(d)
    got = [(r.conv_id, r.role, r.text) for r in chat_format.read_turns(win).orderBy("conv_id", "ord").collect()]
    assert got == [(1, "user", LONG), (1, "user", LONG), (1, "assistant", "ok"), (2, "", ""), (3, "user", "near"), (3, "assistant", "far")]
    assert {r.conv_id: (r.n_turns, r.loss_chars) for r in chat_format.digests(win).collect()} == {1: (3, 2), 2: (1, 0), 3: (2, 3)}


def test_url_filters_on_odd_input(spark):
    ev = spark.createDataFrame([("a.com", "add", "2024-01-10"), ("a.com", "add", "2024-01-10"), ("a.com", "remove", "2024-01-20"), ("b.com", "add", "2024-02-01"), ("b.com", "remove", "2024-02-01")], "pattern string, action string, at string")
    cap = spark.createDataFrame([(1, "http://a.com/", "2024-01-12", "mine", "p"), (1, "http://a.com/", "2024-01-12", "mine", "p"), (2, "http://b.com", "2024-02-01", None, None), (3, "not a url " + "x" * 5000, "2024-01-12", "h", "p")], "id int, url string, fetched_on string, host string, `pattern` string").withColumn("a.b", F.lit(1))
    got = url_filters.judge(cap, ev)
    assert got.columns == ["id", "url", "fetched_on", "a.b", "host", "blocked", "pattern", "since"]
    assert sorted((r.id, r.host, r.blocked) for r in got.collect()) == [(1, "a.com", True), (1, "a.com", True), (2, "b.com", False), (3, "", False)]
    assert url_filters.judge(cap.limit(0), ev).count() == 0


def test_pipeline_stages_on_odd_input(spark, odd, data):
    docs, rows = odd, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
        assert docs.columns == odd.columns, name
        rows[name] = docs.count()
        assert stage(spark, odd.limit(0), data).count() == 0
    assert rows["line_dedup"] == rows["quality_rules"] >= rows["ngram_join"] >= rows["decontamination"]
    assert corpus_pipeline.tokens(spark, docs, data).count() == rows["decontamination"]
    assert line_dedup.drop_repeated_lines(odd).columns == quality_rules.keep_good(odd).columns == ngram_join.keep_one_of_each(odd).columns == odd.columns
