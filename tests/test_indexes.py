"""Stored indexes and versioned tables: upkeep equals building anew, conflicts lose nothing, old tables open under new schemas."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestead.operators import postings, retrieval, vectors
from lodestead.plans import registry
from lodestead.sources import snapshots

DOCS = "doc_id long, text string"


def _rows(d):
    return sorted(map(tuple, d.collect()))


def test_a_chain_of_deltas_equals_building_anew(spark, tmp_path):
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "rho", "sigma"]) for _ in range(rng.randint(0, 12)))
    now = {i: text() for i in range(30)}
    root = str(tmp_path / "index")
    postings.build(spark, root, spark.createDataFrame(sorted(now.items()), DOCS))
    q = spark.createDataFrame([(1, "alpha rho"), (2, "sigma sigma beta"), (3, "the"), (4, None)], "item_id long, text string")
    for n in range(4):
        put, gone = {i: text() for i in rng.sample(range(40), 6)}, rng.sample(range(40), 4)
        incoming = spark.createDataFrame(sorted(put.items()), DOCS)
        snap = postings.delta(spark, root, incoming if n != 2 else None, spark.createDataFrame([(i,) for i in gone], "doc_id long") if n != 3 else None)
        now |= put if n != 2 else {}
        now = {i: t for i, t in now.items() if n == 3 or i not in gone}
        docs = spark.createDataFrame(sorted(now.items()), DOCS)
        assert _rows(postings.search(snap, q)) == _rows(retrieval.bm25(docs, q))
        assert _rows(postings.doc_freq(snap)) == _rows(retrieval.doc_freq(retrieval.term_freq(docs)))
        assert tuple(postings.stats(snap).first())[0] == len(now)
    assert _rows(postings.search(postings.compact(spark, root), q)) == _rows(retrieval.bm25(docs, q))
    allowed = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("doc"))
    assert _rows(postings.search(snap, q, allowed=allowed)) == _rows(retrieval.bm25(docs, q, keep=F.col("doc_id") % 2 == 0))


def test_an_index_of_odd_documents(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "alpha"), (3, "alpha"), (None, "alpha"), (4, "alpha " * 5_000)]
    snap = postings.build(spark, str(tmp_path / "a"), spark.createDataFrame(rows, DOCS))
    q = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert sorted(r.doc for r in postings.search(snap, q).collect()) == [3, 4] and tuple(postings.stats(snap).first()) == (4, 5_001)
    empty = postings.build(spark, str(tmp_path / "b"), spark.createDataFrame([], DOCS))
    assert postings.search(empty, q).count() == 0 and tuple(postings.stats(empty).first()) == (0, 0)
    assert postings.search(snap, q.limit(0)).count() == 0


def test_a_search_reads_the_partitions_of_its_terms(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"w{i}") for i in range(50)], DOCS)
    old = postings.DOCS
    try:
        postings.DOCS = 5
        snap = postings.build(spark, str(tmp_path / "a"), docs)
    finally:
        postings.DOCS = old
    assert snap.note["buckets"] == 11
    plan = postings.search(snap, spark.createDataFrame([(1, "w7")], "item_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)


def test_sparse_vectors(spark):
    d = spark.createDataFrame([(1, [("a", 3), ("b", 4)]), (2, [])], "doc long, terms array<struct<term:string,tf:long>>")
    got = {r.doc: r.sparse for r in postings.sparse(d).collect()}
    assert sorted(got[1]["values"]) == [0.6, 0.8] and got[1]["indices"] == sorted(got[1]["indices"]) and got[2]["indices"] == []
    top = postings.inner_products(postings.sparse(d), postings.sparse(d.where("doc = 1")).withColumnRenamed("doc", "qid")).collect()
    assert [tuple(r) for r in top] == [(1, 1, 1.0, 1)]


def test_sparse_ranks_agree_with_bm25_for_most_queries(spark, data):
    from lodestead.plans import indexes

    a = {r.qid: r.doc for r in indexes.sparse_topk(spark, data).where("rank = 1").collect()}
    best = {}
    for r in registry.bm25_topk(spark, data).collect():
        best.setdefault(r.qid, []).append(r.doc)
    assert sum(a.get(q) in docs for q, docs in best.items()) >= 0.5 * len(best)


def test_cells_find_what_is_near(spark, tmp_path):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(12, 16))
    x = np.concatenate([centre[i % 12] + 0.3 * rng.normal(size=16) for i in range(900)]).reshape(-1, 16)
    x[300:600] = x[0] + 0.01 * rng.normal(size=(300, 16))  # a third of all in one cell
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(1_000, None), (1_001, [1.0]), (None, x[0].tolist()), (1_002, [0.0] * 16)], "vec_id long, embedding array<double>")
    snap = vectors.build(spark, str(tmp_path / "v"), rows, cells=24)
    assert snap.read("blocks").agg(F.sum(F.size("docs")), F.max(F.size("docs"))).first()[:] == (901, vectors.BLOCK)
    q = rows.where("vec_id % 20 = 0 AND size(embedding) = 16")
    exact, found = retrieval.dense(rows.where("vec_id <= 900"), q, 10), vectors.search(snap, q, 10)
    assert vectors.recall(found, exact).first().recall >= 0.9 and snap.note["probes"] < 24
    everywhere = vectors.search(snap, q, 10, probes=24)
    assert {(r.qid, r.rank): r.score for r in everywhere.collect() if r.qid < 900} == {(r.qid, r.rank): r.score for r in exact.collect()}
    more = vectors.add(spark, str(tmp_path / "v"), spark.createDataFrame([(5_000, x[40].tolist())], "vec_id long, embedding array<double>"))
    assert vectors.search(more, rows.where("vec_id = 40"), 1).first().doc == 5_000
    none = vectors.build(spark, str(tmp_path / "w"), rows.limit(0))
    assert vectors.search(none, q).count() == 0


def test_versions_conflict_and_readers_keep_theirs(spark, tmp_path):
    root, row = str(tmp_path / "t"), "k long, v string"
    rows = lambda *x: spark.createDataFrame(list(x), row)
    one = snapshots.commit(snapshots.snapshot(spark, root), {"t": rows((1, "a"))})
    two = snapshots.commit(one, append={"t": rows((2, "b"))})
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(one, {"t": rows((9, "z"))})
    assert _rows(two.read("t")) == [(1, "a"), (2, "b")] and _rows(snapshots.snapshot(spark, root, 1).read("t")) == [(1, "a")]
    tried = []

    def change(base):
        if not tried:  # another writer comes first
            snapshots.commit(base, append={"t": rows((3, "c"))})
        tried.append(base.version)
        return {"append": {"t": rows((4, "d"))}}

    last = snapshots.update(spark, root, change)
    assert tried == [2, 3] and last.version == 4 and _rows(last.read("t")) == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]

    def always(base):
        snapshots.commit(base, append={"t": rows((5, "e"))})
        return {"append": {"t": rows((6, "f"))}}

    with pytest.raises(snapshots.Conflict):
        snapshots.update(spark, root, always)
    assert (6, "f") not in _rows(snapshots.snapshot(spark, root).read("t"))
    gone = snapshots.commit(snapshots.snapshot(spark, root), {"t": rows((7, "g"))})
    assert snapshots.vacuum(spark, root, 1) > 0 and snapshots.versions(spark, root) == [gone.version] and _rows(gone.read("t")) == [(7, "g")]


def test_old_tables_open_under_new_schemas(spark, tmp_path):
    root, schema = str(tmp_path / "t"), lambda text: StructType.fromDDL(text)
    assert snapshots.ensure(spark, root, {"t": schema("k long, v string")}) == {"t": "made"}
    snapshots.commit(snapshots.snapshot(spark, root), append={"t": spark.createDataFrame([(1, "a")], "k long, v string")})
    assert snapshots.ensure(spark, root, {"t": schema("k long, v string")}) == {"t": "kept"}
    assert snapshots.ensure(spark, root, {"t": schema("k long, v string, n double"), "u": schema("x int")}) == {"t": "widened", "u": "made"}
    snap = snapshots.commit(snapshots.snapshot(spark, root), append={"t": spark.createDataFrame([(2, "b", 0.5)], "k long, v string, n double")})
    assert _rows(snap.read("t")) == [(1, "a", None), (2, "b", 0.5)] and snap.read("u").count() == 0
    assert {(r.name, r.columns, r.n_rows) for r in snapshots.listing(snap).collect()} == {("t", "k,v,n", 2), ("u", "x", 0)}
    assert snapshots.ensure(spark, root, {"t": schema("k string")}) == {"t": "remade"} and snapshots.snapshot(spark, root).read("t").count() == 0
    assert snapshots.listing(snapshots.snapshot(spark, str(tmp_path / "none"))).count() == 0


def test_exact_search_in_groups_and_chunks_is_that_of_all_pairs(spark, monkeypatch):
    from lodestead.operators import nearest

    monkeypatch.setattr(nearest, "CHUNK", 7)
    monkeypatch.setattr(nearest, "GROUP", 40)
    monkeypatch.setattr(nearest, "BATCH", 16)
    monkeypatch.setattr(nearest, "STRIP", 3)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 8)).round(1)
    x[100:180] = x[0]  # copies: equal scores go by the smaller id
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [None] * 8), (902, [1.0, 2.0])], "vec_id long, embedding array<double>")
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    for k, floor in ((5, None), (3, 0.5)):
        want = set()
        for i in range(0, 400, 20):
            s = u @ u[i]
            best = sorted((-round(s[j], 6), j) for j in range(400) if j != i and (floor is None or s[j] >= floor))[:k]
            want |= {(i, j, -r, n + 1) for n, (r, j) in enumerate(best)}
        d = retrieval.dense(rows, rows.where("vec_id % 20 = 0"), k, floor)
        assert {(r.qid, r.doc, round(r.score, 6), r["rank"]) for r in d.collect()} == want
    assert "NestedLoop" not in d._jdf.queryExecution().executedPlan().toString()


def test_a_query_goes_to_a_part_of_the_cells_once(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=(300, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key long, v array<double>")
    sent = vectors._asked(rows, vectors._unit(x[:40]), 30, 2).collect()
    assert len(sent) <= 600 and {len(set(r.cells)) for r in sent} != {1}
    assert all(len({c for r in sent if r.key == i for c in r.cells}) == 30 for i in range(5)) and all(c % 2 == r.part for r in sent for c in r.cells)


def test_the_sample_of_centroids_is_bounded_before_it_is_gathered(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "LEARN_FROM", 300)
    x, seen = np.random.default_rng(4).normal(size=(2_000, 4)), []
    fit = vectors.fit
    monkeypatch.setattr(vectors, "fit", lambda sample, n: seen.append(len(sample)) or fit(sample, n))
    spark.sparkContext.setJobGroup("sample", "sample")
    vectors.build(spark, str(tmp_path / "v"), spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    assert seen and 200 < seen[0] < 400 and seen[0] != 300  # a bound on the hashes, not an ordered limit in the driver


def test_an_index_moves_texts_once_and_no_postings_for_few_query_terms(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"w{i % 7} v{i % 5} w{i % 7}") for i in range(60)], DOCS)
    made = postings._documents(docs, 0, "doc_id", "text", 3, False)
    made.write.format("noop").mode("overwrite").save()
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan
    assert sorted((r.doc, r.doc_len, tuple(map(tuple, r.terms))) for r in made.collect())[3] == (3, 3, (("v3", 1), ("w3", 2)))
    snap = postings.build(spark, str(tmp_path / "a"), docs)
    plan = postings.search(snap, docs.limit(3), query_key="doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [term" in plan.replace("term#", "term") and "LeftAnti" not in plan
    assert sorted(snapshots.snapshot(spark, str(tmp_path / "a")).tables) == ["dead", "docs", "postings", "stats", "terms"]
