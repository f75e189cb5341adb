"""Registered queries of the stored indexes, sparse and dense, and of the tables' versions, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestead.functions import policies
from lodestead.operators import evaluation, index, postings, retrieval, sessions, turns, vectors
from lodestead.plans import dialogue
from lodestead.plans import registry as core
from lodestead.sources import corpus, snapshots
from lodestead.sources.shared import scratch


def index_build(s, d):
    """What the stored postings say of each term."""
    snap = core._lexical(s, d)
    n = snap.read("postings").groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("n_places"), F.max("tf").alias("most"))
    return n.join(postings.doc_freq(snap), "term").select("term", "df", "n_docs", "n_places", "most")


MORE = " zebra quagga zebra"


def _changes(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents of a first state, those that come in (new ones and ones with another text), and those that go."""
    docs = core._docs(s, d)
    longer = docs.where("doc_id % 5 = 0").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(MORE)))
    return docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0 AND doc_id % 5 <> 0").unionByName(longer), docs.where("doc_id % 7 = 0").select("doc_id")


def _changed(s, d):
    first, incoming, gone = _changes(s, d)
    root = scratch(s, "upkeep")
    postings.build(s, root, first)
    return root, postings.delta(s, root, incoming, gone)


def index_delta(s, d):
    """An index kept up by a delta, as BM25 reads it: equal to one that is built of the documents after the changes."""
    _, snap = _changed(s, d)
    q = core._t(s, d, "benchmark").unionByName(s.createDataFrame([(-1, "quagga")], "item_id long, text string"))
    return postings.search(snap, q)


def index_compacted(s, d):
    """Document frequencies after the delta's segments were written anew as one."""
    root, _ = _changed(s, d)
    snap = postings.compact(s, root)
    return snap.read("terms").groupBy("term").agg(F.sum("df").alias("df"), F.count("*").alias("n_rows"))


def index_listing(s, d):
    """The tables of an index in its second version, and its rows of each."""
    _, snap = _changed(s, d)
    live = {t: postings.live(snap, t).agg(F.count("*").alias("n_live")).withColumn("name", F.lit(t)) for t in ("docs", "postings")}
    return snapshots.listing(snap).join(live["docs"].unionByName(live["postings"]), "name").select("name", "version", "n_columns", "columns", "n_folders", "n_live")


def sparse_topk(s, d):
    """Inner products of hashed sparse vectors of the benchmark's items with those of all documents."""
    rows = postings.sparse(core._lexical(s, d).read("docs"))
    queries = postings.sparse(postings.query_terms(core._t(s, d, "benchmark"))).withColumnRenamed("doc", "qid")
    return postings.inner_products(rows, queries)


_VECTORS: dict[tuple[str, str], snapshots.Snapshot] = {}


def _dense(s, d) -> snapshots.Snapshot:
    key = s.sparkContext.applicationId, d
    if key not in _VECTORS:
        _VECTORS[key] = vectors.build(s, scratch(s, "vectors"), core._t(s, d, "embeddings"))
    return _VECTORS[key]


def ann_topk(s, d):
    return vectors.search(_dense(s, d), core._t(s, d, "embeddings").where("vec_id % 20 = 0"))


def ann_recall(s, d):
    """How many queries and exact hits there are, and whether at least nine in ten are found through the cells."""
    v = core._vectors(s, d)
    q = v.where("vec_id % 20 = 0")
    r = vectors.recall(vectors.search(_dense(s, d), q, 10), retrieval.dense(v, q, 10))
    return r.select("n_queries", "n_exact", (F.col("recall") >= 0.9).alias("enough"))


def session_commits(s, d):
    """Two writers save sessions from one version: the second's first try conflicts, and its second loses nothing of the first's."""
    root = scratch(s, "saves")
    first = snapshots.commit(snapshots.snapshot(s, root), {"sessions": dialogue._stored(s, d)})
    one = dialogue._stored(s, d).where("session_id % 2 = 0").withColumn("turns_count", F.lit(100))
    two = dialogue._stored(s, d).where("session_id % 3 = 0").withColumn("identified_model", F.lit("N1"))
    save = lambda base, rows, column: {"replace": {"sessions": sessions.save_columns(base.read("sessions"), rows, [column])}}
    snapshots.update(s, root, lambda base: save(base, one, "turns_count"))
    try:
        snapshots.commit(first, **save(first, two, "identified_model"))
    except snapshots.Conflict:
        snapshots.update(s, root, lambda base: save(base, two, "identified_model"))
    now = snapshots.snapshot(s, root)
    return now.read("sessions").select("session_id", "turns_count", "identified_model", "version", F.lit(now.version).cast("long").alias("table_version"))


def section_topk(s, d):
    """BM25 over the sections of pages, each read with its heading and its page's name once more, from a stored index."""
    x = dialogue._sections(s, d).select(F.concat_ws("#", "source_id", "pos").alias("key"), retrieval.document_text(F.col("source_id"), F.col("locator"), F.col("body")).alias("text"))
    snap = postings.build(s, scratch(s, "sections"), x, "key")
    return postings.search(snap, core._t(s, d, "benchmark"))


OUTSIDE = ["zymurgy quixotic xylophones", "vortigern mxyzptlk", "qwertz asdfgh"]


def _floors(s, d) -> DataFrame:
    """Floors of both tracks: the lexical one from probes (items of the benchmark and the beginnings of documents inside, nonsense
    outside), the dense one from the best hits of vectors, of their own label or another."""
    titles = core._docs(s, d).select(F.col("doc_id").alias("pos"), F.array_join(F.slice(F.split(F.coalesce("text", F.lit("")), " "), 1, 3), " ").alias("title"))
    inside, outside = core._t(s, d, "benchmark").where("text IS NOT NULL"), s.createDataFrame([(x,) for x in OUTSIDE], "text string")
    p = retrieval.probes(inside, titles, outside)
    sparse = postings.search(core._lexical(s, d), p, 1, query_key="qid").join(p, "qid")
    v = core._vectors(s, d).select("vec_id", "label")
    best = core._dense(s, d, 1).join(v.selectExpr("vec_id qid", "label a"), "qid").join(v.selectExpr("vec_id doc", "label b"), "doc")
    return retrieval.calibrate_tracks(best.select("score", (F.col("a") == F.col("b")).alias("in_domain")), sparse.select("score", "in_domain"))


def calibrated_meta(s, d):
    """The index's meta row, calibrated, stored as a table of a version and read back."""
    root = scratch(s, "meta")
    meta = index.meta_row(s, index.fingerprint("given", 64), "v1", _floors(s, d))
    snapshots.ensure(s, root, {"meta": meta.schema})
    snap = snapshots.update(s, root, lambda base: {"replace": {"meta": meta}})
    floors = index.floors(snap.read("meta"), core.DENSE_FLOOR, core.LEXICAL_FLOOR)
    return index.checked(snap.read("meta").select("fingerprint", "manifest_version"), snap.read("meta"), "given:64").join(F.broadcast(floors))  # one row


def prompt_messages(s, d):
    """The prompt of each conversation's last user turn: four earlier messages, and the sections of two pages as its context."""
    t = core._turns(s, d).withColumn("session_id", F.col("conv_id").cast("string"))
    last = t.where("role = 'user'").groupBy("session_id").agg(F.max("turn").alias("last"), F.max_by("text", "turn").alias("message"))
    before = t.join(last, "session_id").where("turn < last AND turn >= last - 4").groupBy("session_id")
    window = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    known = last.select("session_id", F.when(F.col("last") % 2 == 0, F.array(F.lit("cable_checked"), F.lit("power_cycled"))).alias("attempted_steps"), F.when(F.col("last") % 3 == 0, "R1").alias("identified_model")).join(before.agg(window.alias("window")), "session_id", "left")
    pages = dialogue._sections(s, d).where("source_id IN ('page-1', 'page-2')")
    shown = last.select("session_id", F.concat(F.lit("page-"), (1 + F.pmod(F.length("session_id"), F.lit(2))).cast("string")).alias("source_id")).join(pages, "source_id").withColumn("rank", F.col("pos"))
    x = sessions.prompt_messages(last.select("session_id", "message"), known, shown, "RULES")
    return x.select("session_id", F.size("messages").cast("long").alias("n_messages"), sessions.fixture_key(F.col("messages")).alias("key"))


def eval_fold(s, d):
    """Cases from JSON lines, answered by the turn fold itself, judged and reported: how often it keeps the proposed action."""
    q, said = policies.read_policy(None), dialogue._answered(s, d)
    turn = F.struct("turn", F.coalesce("message", F.lit("")).alias("input"), F.col("answer.action").alias("expected_action"), F.lit(None).cast("string").alias("expected_source"))
    lines = said.groupBy(F.col("session_id").alias("id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    cases = corpus.read_cases(lines.select(F.to_json(F.struct("id", F.transform("turns", lambda x: x.dropFields("turn")).alias("turns"))).alias("value")))
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("turn"))
    a = turns.outputs(turns.fold(turns.prepare(said, q), None, q)).withColumn("turn", number.cast("int"))
    cited = F.transform("answer.citations", lambda c: c["source_id"])
    got = a.select(F.col("session_id").alias("case_id"), "turn", "answer.action", "answer.response", cited.alias("cited"), cited.alias("raw_cited"), cited.alias("retrieved"))
    return evaluation.report(evaluation.judge(cases, got))


_NAMES = (section_topk, calibrated_meta, prompt_messages, eval_fold, index_build, index_delta, index_compacted, index_listing, sparse_topk, ann_topk, ann_recall, session_commits)
QUERIES = {f.__name__: f for f in _NAMES}

# ---------------------------------------------------------------- oracles
_NEW = f"nd AS (SELECT doc_id, lang, CASE WHEN doc_id % 5 = 0 THEN coalesce(text, '') || '{MORE}' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0)"
_TF = core._TF.replace("FROM documents", "FROM nd")
_Q = core._bm_sql(4).replace("FROM benchmark)", "FROM (SELECT item_id, text FROM benchmark UNION ALL SELECT -1, 'quagga'))")
_PLACE = f"('0x' || substr(md5(term), 1, 8))::BIGINT % {postings.DIMENSION}"
_SEC_TF = core._TF.replace("doc_id AS doc, lang,", "source_id || '#' || pos AS doc,").replace("coalesce(text, '')", "coalesce(body || ' ' || locator || ' ' || source_id, '')").replace("FROM documents", "FROM sx")
_PROBES = "pr AS (SELECT DISTINCT text, true AS inn FROM (SELECT text FROM benchmark WHERE text IS NOT NULL UNION ALL SELECT t || ' troubleshooting' FROM (SELECT array_to_string(string_split(coalesce(text, ''), ' ')[1:3], ' ') AS t FROM documents ORDER BY doc_id LIMIT 5) WHERE t <> '') UNION ALL SELECT unnest({}), false), prb AS (SELECT row_number() OVER () AS item_id, text, inn FROM pr)".format(OUTSIDE)
_FLOOR = "CASE WHEN coalesce({0}, {2}) > coalesce({1}, {3}) THEN round((coalesce({0}, {2}) + coalesce({1}, {3})) / 2, {5}) ELSE {4} END::DOUBLE"
_PROMPT = f"""lt AS (SELECT conv_id, max(turn) AS last, arg_max(text, turn) AS m FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE role = 'user') GROUP BY conv_id),
wn AS (SELECT conv_id, turn AS k, role, CASE WHEN role = 'user' THEN '<user_input>' || chr(10) || coalesce(text, '') || chr(10) || '</user_input>' ELSE coalesce(text, '') END AS c FROM conversations JOIN lt USING (conv_id) WHERE turn < last AND turn >= last - 4),
cx AS (SELECT conv_id, string_agg('--- Document: ' || source_id || ' | Section: ' || locator || ' ---' || chr(10) || body, chr(10) || chr(10) ORDER BY pos) AS c FROM lt JOIN sx ON sx.source_id = 'page-' || (1 + length(conv_id::VARCHAR) % 2) GROUP BY conv_id),
ms AS (SELECT conv_id, -2 AS k, 'system' AS role, 'RULES' AS c FROM lt UNION ALL SELECT conv_id, -1, 'system', '{sessions.GROUNDED.strip()}' || chr(10) || coalesce(cx.c, '') || chr(10) || chr(10) || 'ATTEMPTED STEPS: ' || CASE WHEN last % 2 = 0 THEN '[''cable_checked'', ''power_cycled'']' ELSE '[]' END || chr(10) || 'IDENTIFIED MODEL: ' || CASE WHEN last % 3 = 0 THEN 'R1' ELSE 'None' END FROM lt LEFT JOIN cx USING (conv_id)
  UNION ALL SELECT * FROM wn UNION ALL SELECT conv_id, 1000000, 'user', '<user_input>' || chr(10) || m || chr(10) || '</user_input>' FROM lt)"""
ORACLES = {
    "section_topk": f"WITH {dialogue._SECS}, {_SEC_TF}, {core._bm_sql(4)} {core._OUT} bm",
    "calibrated_meta": f"WITH {core._TF}, {_PROBES}, {core._bm_sql(1).replace('FROM benchmark', 'FROM prb')}, {core._dense_sql(1)}, sp AS (SELECT min(score) FILTER (WHERE inn) AS low, max(score) FILTER (WHERE NOT inn) AS high FROM bm JOIN prb ON item_id = qid), de AS (SELECT min(score) FILTER (WHERE a.label = b.label) AS low, max(score) FILTER (WHERE a.label <> b.label) AS high FROM dn JOIN v a ON a.vec_id = qid JOIN v b ON b.vec_id = doc) SELECT 'given:64' AS fingerprint, 'v1' AS manifest_version, coalesce(nullif({_FLOOR.format('de.low', 'de.high', *retrieval.TRACKS['dense'])}, 0), {core.DENSE_FLOOR}) AS dense_floor, coalesce(nullif({_FLOOR.format('sp.low', 'sp.high', *retrieval.TRACKS['sparse'])}, 0), {core.LEXICAL_FLOOR}) AS sparse_floor FROM sp, de",
    "prompt_messages": f"""WITH {dialogue._SECS}, {_PROMPT} SELECT conv_id::VARCHAR AS session_id, count(*) AS n_messages, sha256('[' || string_agg('{{"content": ' || to_json(c)::VARCHAR || ', "role": ' || to_json(role)::VARCHAR || '}}', ', ' ORDER BY k) || ']') AS key FROM ms GROUP BY conv_id""",
    "index_build": f"WITH {core._TF} SELECT term, df, n_docs, n_places, most FROM df JOIN (SELECT term, count(*) AS n_docs, sum(tf)::BIGINT AS n_places, max(tf) AS most FROM tf GROUP BY term) USING (term)",
    "index_delta": f"WITH {_NEW}, {_TF}, {_Q} {core._OUT} bm",
    "index_compacted": f"WITH {_NEW}, {_TF} SELECT term, df, 1::BIGINT AS n_rows FROM df",
    "index_listing": f"WITH {_NEW}, {_TF} SELECT 'docs' AS name, 2::BIGINT AS version, 5::BIGINT AS n_columns, 'doc,seg,doc_len,terms,bucket' AS columns, 2::BIGINT AS n_folders, (SELECT count(*) FROM nd) AS n_live UNION ALL SELECT 'postings', 2, 6, 'term,doc,seg,tf,doc_len,bucket', 2, (SELECT count(*) FROM tf)",
    "sparse_topk": f"""WITH {core._TF}, a AS (SELECT doc, {_PLACE} AS i, sum(tf)::DOUBLE AS v FROM tf GROUP BY ALL), an AS (SELECT doc, i, v / sqrt(sum(v * v) OVER (PARTITION BY doc)) AS v FROM a),
b AS (SELECT qid, {_PLACE} AS i, count(*)::DOUBLE AS v FROM (SELECT item_id AS qid, unnest({core._TOK}) AS term FROM benchmark) GROUP BY ALL), bn AS (SELECT qid, i, v / sqrt(sum(v * v) OVER (PARTITION BY qid)) AS v FROM b),
s AS (SELECT qid, doc, round(sum(an.v * bn.v), 6) AS score FROM an JOIN bn USING (i) GROUP BY qid, doc)
SELECT qid, doc, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM s QUALIFY rank <= 4""",
    "ann_recall": "SELECT count(*) AS n_queries, sum(least(10, n))::BIGINT AS n_exact, true AS enough FROM embeddings, (SELECT count(*) - 1 AS n FROM embeddings) WHERE vec_id % 20 = 0",
    "session_commits": "SELECT c_custkey AS session_id, CASE WHEN c_custkey % 2 = 0 THEN 100 ELSE c_nationkey END::INT AS turns_count, CASE WHEN c_custkey % 3 = 0 THEN 'N1' WHEN c_custkey % 4 = 0 THEN 'R1' END AS identified_model, (3 + (c_custkey % 2 = 0)::INT + (c_custkey % 3 = 0)::INT)::INT AS version, 3::BIGINT AS table_version FROM customer WHERE c_custkey % 5 <> 0",
}
