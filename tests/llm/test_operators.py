"""The training-data operators against SQL, other libraries and brute force, and on odd input."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from conftest import same
from pyspark.sql import functions as F

from lodestead.llm import byte_bpe, chat_format, decontamination, line_dedup, lm_scoring, ngram_join, quality_rules, registry, substring_dedup, toxicity, url_filters

DOCS = "doc_id long, text string, _w string, row int"
LONG = " ".join(f"w{i % 997}" for i in range(30_000))
ODD = [(1, None, None, 1), (2, "", "x", None), (3, " \t\n ", "x", 1), (4, LONG, "x", 1), (4, LONG, "x", 1), (None, "alpha beta " * 30, None, 1), (5, "the one", "a", 1), (6, "the one", "a", 1), (7, LONG, "b", 2)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, data, name):
    assert same(spark, registry.QUERIES[name], registry.ORACLES[name], data)


def test_quality_rules_on_odd_input(odd, none):
    got = quality_rules.measure(odd).collect()
    assert len(got) == len(ODD) and {r.n_words for r in got} == {0, 2, 60, 30_000}
    assert quality_rules.keep_good(odd).columns == odd.columns and quality_rules.keep_good(none).count() == 0


def test_line_dedup_on_odd_input(spark, odd, none):
    assert line_dedup.drop_repeated_lines(odd).count() == len(ODD) and line_dedup.drop_repeated_lines(none).count() == 0
    d = spark.createDataFrame([(1, "a\nb\nc\nd", "", 0), (2, "x\na\nb\n\n c \ny", "", 0), (2, "x\na\nb\n\n c \ny", "", 0), (None, "a\nb\nc", "", 0)], DOCS)
    assert sorted((r.doc_id or 0, r.text) for r in line_dedup.drop_repeated_lines(d).collect()) == [(0, "a\nb\nc"), (1, "a\nb\nc\nd"), (2, "x\ny"), (2, "x\ny")]


def test_line_dedup_finds_long_passages_of_one_or_two_lines(spark):
    rng = random.Random(4)
    line = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(999)) for _ in range(n))
    pool = [line(n) for n in (60, 50, 49, 30, 25, 20, 5, 5)]
    texts = {i: "\n".join(rng.choice(["", "  "]) + (rng.choice(pool) if rng.random() < 0.6 else line(8)) for _ in range(rng.randint(1, 6))) for i in range(20, 140)}
    texts |= {1: pool[0], 2: pool[0], 3: pool[2], 4: pool[2], 5: f"{pool[3]}\n{pool[5]}", 6: f"x\n{pool[3]}\n\n{pool[5]}\ny", 7: f"{pool[4]}\n{pool[5]}", 8: f"{pool[4]}\n{pool[5]}"}
    seen, want = set(), {}
    for i, t in sorted(texts.items()):
        raw = t.split("\n")
        at, gone = [k for k, x in enumerate(raw) if x.strip()], set()
        for p in range(len(at)):
            for m in range(1, 4):
                run = tuple(raw[k].strip() for k in at[p : p + m])
                if len(run) == m and (m == 3 or len(" ".join(run).split()) >= 50):
                    if run in seen:
                        gone |= set(range(at[p], at[p + m - 1] + 1))
                    seen.add(run)
        want[i] = "\n".join(x for k, x in enumerate(raw) if k not in gone)
    got = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")).collect()}
    assert got == want and got[2] == "" and got[4] == pool[2] and got[6] == "x\ny" and got[8] == texts[8]


def test_substring_dedup_on_odd_input(odd, none):
    got = {(r.doc_id, r.n_words): r.n_removed for r in substring_dedup.remove_repeats(odd).collect()}
    assert got[(1, 0)] == got[(2, 0)] == got[(3, 0)] == got[(5, 2)] == 0 and got[(None, 60)] == 0
    assert got[(7, 30_000)] == 30_000 and 28_000 < got[(4, 30_000)] < 30_000
    assert substring_dedup.remove_repeats(none).count() == 0


def test_ngram_join_on_odd_input(odd, none):
    got = {r["doc"]: (r["n"], r["component"]) for r in ngram_join.classes(odd).collect()}
    assert got == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (997, 4), 5: (1, 5), 6: (1, 5), 7: (997, 4)}
    assert sorted(r.doc_id for r in ngram_join.keep_one_of_each(odd).where("doc_id IS NOT NULL").collect()) == [1, 2, 3, 4, 4, 5]
    assert ngram_join.classes(none).count() == 0


def test_ngram_join_finds_all_links_of_a_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"t{i}" for i in range(120)]
    rows = [(i, " ".join(w if rng.random() > e else f"n{rng.randrange(10**6)}" for w in base)) for i in range(160) for e in [rng.choice([0.005, 0.01, 0.02, 0.03])]]
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(117)} for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    got = {r["doc"]: r["component"] for r in ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: root(i) for i in sets}


def _components(rows, size, percent):
    sets = {i: {tuple(t.split()[k : k + size]) for k in range(len(t.split()) - size + 1)} for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in sets}


@pytest.mark.parametrize(("size", "percent", "frequent"), [(4, 85, 64), (5, 80, 8)])
def test_ngram_join_of_clusters_within_clusters(spark, monkeypatch, size, percent, frequent):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "OWN_HUB", frequent)
    rng = random.Random(frequent)
    base = [f"t{i}" for i in range(100)]
    kinds = [base]
    for k in range(1, 9):  # each a variant of an earlier one, some of other lengths
        x = list(rng.choice(kinds))
        for _ in range(rng.randint(1, 5)):
            p = rng.randrange(len(x))
            x[p : p + rng.choice([0, 1, 3])] = [f"k{k}_{rng.randrange(40)}" for _ in range(rng.randint(0, 6))]
        kinds.append(x)
    rows = []
    for i in range(160):
        e = rng.choice([0, 0.005, 0.01, 0.02, 0.04])
        rows.append((i, " ".join(w if rng.random() >= e else f"n{rng.randrange(60)}" for w in rng.choice(kinds))))
    want = _components(rows, size, percent)
    assert len(set(want.values())) > 10
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc"]: r["component"] for r in ngram_join.classes(d, size, percent).collect()} == want


def test_ngram_join_makes_pairs_in_proportion_to_a_group_of_near_copies(spark, monkeypatch):
    made, write = Counter(), ngram_join.materialize

    def noted(df, name):
        out = write(df, name)
        made[name] += out.count() if name in ("star", "hubs", "rest") else 0
        return out

    monkeypatch.setattr(ngram_join, "materialize", noted)
    rng = random.Random(6)
    base = [f"t{i}" for i in range(120)]
    rows = [(i, " ".join(w if rng.random() > e else f"n{rng.randrange(10**6)}" for w in base)) for i in range(600) for e in [rng.choice([0.005, 0.01, 0.02, 0.03])]]
    got = {r["doc"]: r["component"] for r in ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _components(rows, 4, 85) and len(set(got.values())) > 100 and made.total() < 3 * 600


def test_ngram_join_keeps_columns_of_any_name(spark):
    d = spark.createDataFrame([(1, "a b c d e f", 1, 2), (2, "a b c d e f", 3, 4)], "doc_id long, text string, `a.b` int, component int")
    assert [tuple(r) for r in ngram_join.keep_one_of_each(d).collect()] == [(1, "a b c d e f", 1, 2)]


def test_decontamination_finds_every_planted_item(spark):
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(300)]
    bench = [(i, [rng.choice(vocab) for _ in range(rng.randint(6, 60))]) for i in range(30)]
    rows, truth = [], set()
    for k in range(120):
        i, words = bench[k % 30]
        x = list(words)
        for _ in range(rng.randint(0, decontamination.edits_allowed(len(words), decontamination.MAX_EDITS))):
            p = rng.randrange(len(x))
            x[p : p + 1] = rng.choice([[], [rng.choice(vocab)], [x[p], rng.choice(vocab)]])
        pad = [[rng.choice(vocab) for _ in range(rng.randint(0, 80))] for _ in range(2)]
        rows.append((k, " ".join(pad[0] + [w.upper() + "," for w in x] + pad[1])))
        truth.add((k, i))
    rows += [(1000 + k, " ".join(rng.choice(vocab) for _ in range(200))) for k in range(40)] + [(2000, None), (2001, "")]
    docs, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in bench] + [(99, None), (98, "v1 v2")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.matches(docs, b).collect()}
    assert truth <= got and len(got - truth) <= 2
    assert {r.doc_id for r in decontamination.drop_contaminated(docs, b).collect()} >= {1000 + k for k in range(40)} | {2000, 2001}
    assert decontamination.matches(docs, b.limit(0)).count() == 0


@pytest.mark.parametrize("n", [50, 64, 80])
def test_decontamination_recall_at_the_largest_distance(n):
    rng, found = np.random.Generator(np.random.PCG64(n)), 0
    slack = decontamination.edits_allowed(n, decontamination.MAX_EDITS)
    for _ in range(3):
        items = [rng.integers(1, 2**40, n) for _ in range(400)]
        x = decontamination.Items(list(range(400)), [" ".join(map(str, w)) for w in items], decontamination.MAX_EDITS)
        texts = []
        for w in items:
            y = w.tolist()
            for kind in rng.integers(0, 3, slack):
                p, new = int(rng.integers(0, len(y))), int(rng.integers(1, 2**40))
                y[p : p + 1] = [[], [new], [y[p], new]][kind]
            texts.append(" ".join(map(str, [*rng.integers(1, 2**40, 20), *y, *rng.integers(1, 2**40, 20)])))
        found += len({(d, i) for d, i, *_ in decontamination.find(x, pa.array(texts)) if d == i})
    assert found >= 0.993 * 1200


@pytest.mark.parametrize("n", [65, 100, 200, 300])
def test_decontamination_finds_long_items_wherever_the_edits_are(n):
    rng, e = random.Random(n), decontamination.edits_allowed(n, decontamination.MAX_EDITS)
    word = lambda: f"{rng.choice('abcdefgh')}{rng.randrange(20_000)}"
    items = [[word() for _ in range(n)] for _ in range(60)]
    x = decontamination.Items(list(range(60)), [" ".join(w) for w in items], decontamination.MAX_EDITS)

    def at(places, words):
        return [word() if i in places else w for i, w in enumerate(words)]

    forms = [
        lambda w: at(set(rng.sample(range(n), e)), w), lambda w: at(set(rng.sample(range(64), min(e, 64))), w), lambda w: [word() for _ in range(e)] + w[e:], lambda w: w[:-e] + [word() for _ in range(e)],
        lambda w: w[e:], lambda w: w[:-e], lambda w: w[: n // 2] + w[n // 2 + e :], lambda w: w[: n // 2] + [word() for _ in range(e)] + w[n // 2 :],
    ]
    for f in forms:
        texts = [" ".join([*(word() for _ in range(rng.randrange(150))), *f(w), *(word() for _ in range(20))]) for w in items]
        got = decontamination.find(x, pa.array(texts))
        assert len({d for d, i, *_ in got if d == i}) >= 0.99 * 60 and all(d == i and edits <= e for d, i, _, _, edits in got)


def test_bpe_equals_tiktoken(spark, data, odd, none):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.read_ranks(open(path, "rb").read())
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    parts = ["a", "b", "the", " ", "\n", "é", "ß", "日本", "🙂", "\x1c", "1", "'s", "!", "\t", "aaaa"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(500)] + ["a" * 3000, "é" * 700, " " * 900]
    texts += ["".join(rng.choice(["a", "b", "th", "e", "in", "é", "日", "zz"]) for _ in range(rng.randint(400, 6000))) for _ in range(30)] + ["ab" * 4001, "aab" * 900]
    ids, at = byte_bpe.Coder(ranks, P.PATTERN).encode(texts)
    assert [ids[a:z].tolist() for a, z in zip(at[:-1], at[1:], strict=True)] == [enc.encode_ordinary(t) for t in texts]
    got = {r.doc_id: r for r in byte_bpe.op9_byte_bpe(spark, data).collect()}
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        x = enc.encode_ordinary(r.text)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == (len(x), sha256(",".join(map(str, x)).encode()).hexdigest(), sha256(r.text.encode()).hexdigest())
    assert byte_bpe.round_trip(odd).count() == len(ODD) and byte_bpe.round_trip(none).count() == 0


def test_chat_windows_keep_the_budget_and_mask_each_target_once(spark):
    rng = random.Random(2)
    rows = [(1, 0, "system", "rules here")] + [(1, t, ["user", "assistant"][t % 2], " ".join(["w"] * rng.randint(0, 90))) for t in range(1, 80)]
    rows += [(2, None, None, None), (2, None, "assistant", "a\\b ### </turn>\n"), (None, 1, "us\\er\nx", "</turn>"), (3, 0, "system", "only")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    win = chat_format.windows(c, 200, 60)
    for r in win.where("conv_id = 1").collect():
        assert r.turns[0].ord == 1 and len(re.findall(r"\bw\b|rules|here", r.text)) <= 200
    got = [(r.conv_id, r.role, r.text) for r in chat_format.read_turns(win).orderBy("conv_id", "ord").collect()]
    assert Counter(got) == Counter((i, r or "", t or "") for i, _, r, t in rows)
    kept = [r.text for r in chat_format.read_targets(win).where("conv_id = 1").orderBy("ord").collect()]
    assert kept == [t for i, _, r, t in rows if i == 1 and r == "assistant"]
    assert chat_format.digests(win).count() == 4 and chat_format.digests(chat_format.windows(c.limit(0))).count() == 0


def test_url_filter_follows_the_list_in_time(spark):
    ev = spark.createDataFrame([("a.com", "add", "2024-01-10"), ("a.com", "remove", "2024-01-20"), ("x.a.com/p", "add", "2024-01-05"), (None, "add", "2024-01-01"), ("b.com", "add", None)], "pattern string, action string, at string")
    cap = spark.createDataFrame([(1, "http://x.A.com:80/p/q", "2024-01-06"), (2, "http://y.a.com/", "2024-01-10"), (3, "http://y.a.com/", "2024-01-20"), (4, None, "2024-01-15"), (5, "http://nota.com", "2024-01-15"), (6, "http://a.com", None)], "id int, url string, fetched_on string")
    assert {r.id: r.pattern for r in url_filters.judge(cap, ev).collect()} == {1: "x.a.com/p", 2: "a.com", 3: None, 4: None, 5: None, 6: None}
    assert not any(r.blocked for r in url_filters.judge(cap, ev.limit(0)).collect())


def test_lm_base_score_and_held_out_gain(spark, data, odd, none):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in lm_scoring.score_texts(docs).collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = {r.doc_id: [*r.text.translate(low).encode().split(), 0] for r in docs.collect()}
    count = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in t)
    total, kinds = sum(count.values()), len(count)
    for i, t in texts.items():
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in t)
        assert math.isclose(got[i].base_score, base, rel_tol=1e-9) and got[i].n_known == sum(count[w] > 0 for w in t) and got[i].train_tokens == total
    assert lm_scoring.score_texts(odd).count() == len(ODD) and lm_scoring.score_texts(none).count() == 0


def test_gru_probabilities_sum_to_one_and_training_helps():
    import numpy as np

    rng = np.random.default_rng(1)
    words = lm_scoring.Words(rng.integers(0, 2**63, 40).astype(np.uint64), np.arange(1, 41), 900, 41, 80)
    gru = lm_scoring.Gru(words)
    n = len(words.shares)
    s = rng.normal(size=(1, lm_scoring.HIDDEN)).astype("f4")
    gru.p["ww"] += rng.normal(size=gru.p["ww"].shape).astype("f4")
    assert abs(np.exp(gru.log_p(np.repeat(s, n, 0), np.arange(n))[0]).sum() - 1) < 1e-4
    gru = lm_scoring.Gru(words)
    text = np.tile([5, 9, 12, 7], 30).astype(np.int32)
    before = gru.score([text])[0]
    gru.learn(np.tile(np.append(text, 0), 2000).astype(np.int32))
    assert gru.score([text])[0] > before + 20
    together, alone = gru.score([text, text[:3], text[:0]]), [gru.score([x])[0] for x in (text, text[:3], text[:0])]
    assert np.allclose(together, alone, atol=1e-3)


def test_language_model_learns_from_every_training_document(spark, tmp_path, monkeypatch):
    def note(shared):
        def run(batches):
            import uuid

            (tmp_path / uuid.uuid4().hex).write_text("\n".join(str(x[1]) for b in batches for x in b.column("ids").to_pylist()))
            yield from ()

        return run

    monkeypatch.setattr(lm_scoring, "_train", note)
    monkeypatch.setattr(lm_scoring, "SHARD_TOKENS", 90)
    docs = spark.range(300).selectExpr("id doc_id", "concat('text ', id) text")
    kept = [r.doc_id for r in lm_scoring.score_texts(docs).where("NOT held_out").collect()]
    seen = [x for f in tmp_path.iterdir() for x in f.read_text().split("\n") if x]
    assert len(seen) == len(set(seen)) == len(kept)


def test_language_model_learns_small_shards_and_ends_of_streams():
    from types import SimpleNamespace

    words = lm_scoring.Words(np.arange(1, 41).astype(np.uint64), np.arange(1, 41), 900, 41, 80)
    shared = SimpleNamespace(value=lm_scoring._dump(words, np.zeros(0, "f4")))
    rows = pa.RecordBatch.from_arrays([pa.array([3, 3, 5], pa.int32()), pa.array([[2, 3], [], [4]], pa.list_(pa.int16()))], ["shard", "ids"])
    out = list(lm_scoring._train(shared)([rows]))
    assert [x.column("n").to_pylist() for x in out] == [[4], [2]]
    assert all(not np.array_equal(x.column("w")[0].values.to_numpy(), lm_scoring.Gru(words).flat()) for x in out)
    ends = []
    for last in (5, 9):
        gru = lm_scoring.Gru(words)
        gru.learn(np.append(np.full(lm_scoring.LANES * 40, 7), np.full(lm_scoring.LANES - 1, last)).astype(np.int32))
        ends.append(gru.flat())
    assert not np.array_equal(*ends)


def test_gru_gradients_equal_differences():
    rng = np.random.default_rng(3)
    words = lm_scoring.Words(rng.integers(0, 2**63, 60).astype(np.uint64), np.arange(1, 61), 2000, 61, 80)
    gru = lm_scoring.Gru(words)
    gru.p = {k: w.astype(float) + rng.normal(0, 0.2, w.shape) for k, w in gru.p.items()}
    x, y = rng.integers(0, 62, (7, 3)), rng.integers(0, 62, (7, 3))
    learned = np.ones((7, 3), bool)
    learned[5:, 2] = False
    s = rng.normal(size=(3, lm_scoring.HIDDEN))
    loss = lambda: gru.loss_and_grads(x, y, learned, s)[0]
    g = gru.loss_and_grads(x, y, learned, s)[1]
    for k, w in gru.p.items():
        for i in rng.choice(w.size, 8, replace=False):
            at = np.unravel_index(i, w.shape)
            was, d = w[at], []
            for e in (1e-5, -1e-5):
                w[at] = was + e
                d.append(loss())
            w[at] = was
            assert math.isclose((d[0] - d[1]) / 2e-5, g[k][at], rel_tol=1e-4, abs_tol=1e-5), k


def test_held_out_texts_score_above_the_base_in_any_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    scores = []
    for n in (1, 4, 8):
        got = lm_scoring.score_texts(docs.repartition(n)).where("held_out").collect()
        tokens = sum(r.n_tokens for r in got)
        assert sum(r.score for r in got) / tokens > sum(r.base_score for r in got) / tokens + 0.1
        assert sum(r.score > r.base_score for r in got) > 0.9 * len(got)
        scores.append({r.doc_id: r.score for r in got})
    assert all(math.isclose(scores[0][i], x[i], rel_tol=1e-4) for x in scores[1:] for i in x)


def test_head_of_words_that_occur_once(spark):
    counts = spark.range(50_000).selectExpr("id word", "if(id < 3, 9L, 1L) c")
    assert 900 < lm_scoring._most_frequent(counts, 1000).count() < 1100 and lm_scoring._most_frequent(counts, 1000).where("c = 9").count() == 3
    assert lm_scoring._most_frequent(counts, 60_000).count() == 50_000 and lm_scoring._most_frequent(counts.limit(0), 9).count() == 0


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_automaton_equals_edit_distance():
    rng, terms = random.Random(2), ["idiot", "moron", "worthless", "abc", "disgustingly"]
    a = toxicity.Automaton(terms)
    for _ in range(4000):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            p = rng.randrange(len(w) + 1)
            w[p : p + rng.randint(0, 1)] = rng.choice(["", "a", "o", "x"])
        w = "".join(w)
        assert a.match(w) == min(((e, k) for k, t in enumerate(terms) if (e := _edits(w, t)) <= toxicity.edits_for(t)), default=None)


def test_quotation_counts_less_than_abuse():
    r = toxicity.Reader(["idiot"], [5.0], [], [])
    abuse, quoted, wrong = (r.features(t) for t in ("you are an idiot today", 'he said the word "idiot" was used', "you idiott"))
    assert abuse[0] > quoted[0] and quoted[1] > abuse[1] == 0 and 0 < wrong[0] < abuse[0]


def test_toxicity_on_odd_input(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (4, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score(odd, labels).collect()
    assert len(got) == len(ODD) and all(r.predicted == 0 for r in got) and toxicity.score(none, labels).count() == 0


def test_held_out_toxicity(spark):
    d = "/root/testdata/sf0.1"
    x = toxicity.op8_toxicity(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    n = {(r.toxic, r.predicted): r["count"] for r in x.groupBy("toxic", "predicted").count().collect()}
    assert n.get((0, 1), 0) <= 0.01 * n[(0, 0)] and n[(1, 1)] >= 0.85 * (n[(1, 1)] + n.get((1, 0), 0))


def test_word_rule_counts_bytes_of_any_text():
    from lodestead.llm.common import hash_words, text_bytes

    texts = ["", "a", " a b ", "é\x0bü", "x" * 3000, "\n", "a"]
    h, first = hash_words(*text_bytes(pa.array(texts)))
    assert (first[1:] - first[:-1]).tolist() == [len(t.encode().split()) for t in texts] and h[0] == h[1] == h[-1]


def test_pipeline_equals_its_stages_by_brute_force(spark, data):
    import corpus_pipeline

    got = {r.doc_id: r.text for r in corpus_pipeline.run(spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.op3_quality_rules(spark, data).where("kept").collect()}
    texts, seen = {}, {}
    rows = sorted((r.doc_id, r.text.split("\n")) for r in docs.collect() if r.doc_id in kept)
    for i, raw in rows:  # runs of three lines, or of fewer with 50 words, that were seen before go
        at = [k for k, x in enumerate(raw) if x.strip(" \t\n\x0b\f\r")]
        gone = set()
        for p in range(len(at)):
            for m in range(1, 4):
                run = tuple(raw[k].strip(" \t\n\x0b\f\r") for k in at[p : p + m])
                if len(run) == m and (m == 3 or len(" ".join(run).encode().split()) >= 50):
                    if run in seen:
                        gone |= set(range(at[p], at[p + m - 1] + 1))
                    seen.setdefault(run, i)
        texts[i] = "\n".join(x for k, x in enumerate(raw) if k not in gone)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts.items():
        w = t.translate(low).encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    first = {}
    for a in sorted(sets):
        link = [b for b in first if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        first[a] = min([first[b] for b in link], default=a)
    bench = [re.findall(r"[^\W_]+", r.text.lower()) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]

    code: dict[str, int] = {}
    number = lambda words: np.array([code.setdefault(w, len(code)) for w in words])

    def leaks(words):
        text, j = number(words), np.arange(len(words) + 1)
        for item in bench:
            row = np.zeros(len(words) + 1, int)
            for x in number(item):
                new = row + 1
                new[1:] = np.minimum(new[1:], row[:-1] + (text != x))
                row = np.minimum.accumulate(new - j) + j
            if len(item) >= 5 and row.min() <= int(0.2 * len(item)):
                return True
        return False

    want = {i: t for i, t in texts.items() if first[i] == i and not leaks(re.findall(r"[^\W_]+", t.lower()))}
    assert got == want
    assert spark.read.parquet(f"{data}/documents.parquet").where(F.col("doc_id").isin(list(want))).count() == len(want)
