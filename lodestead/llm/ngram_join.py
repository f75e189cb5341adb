"""Operator 10, n-gram Jaccard join: adaptive multi-match prefixes, then exact verification of shingle sets.

Sets hold the distinct hashes of word shingles, in one order for all: frequent ones (FREQUENT documents or more have
them in a prefix by hash; at most HOT_MAX of them, which are broadcast) behind the others, else by hash. Of two sets of
sizes m and n with Jaccard similarity t or more, at least a = ceil(t / (1 + t) (m + n)) hashes are shared, and l of them
lie in the prefixes of m - a + l and n - a + l hashes, for every l up to a; n - ceil(t n) + l holds these for all m. Each document chooses
its l among LEVELS by the estimated cost of its candidates (places that its prefix hashes have in other documents,
and their verification, which a demand of l shared hashes cuts by l): an expensive document gets a longer prefix and
asks for more shared hashes. A pair is a candidate if its prefixes, as long as the pair's sizes ask for, share as many hashes as the smaller l of the two.

Equal sets are one representative beforehand (by a 128-bit signature and size). A group of near copies isn't
expanded into pairs. At first, each prefix hash only pairs its smallest document with the others; these links are
verified and give components. Then the remaining candidates, those between documents of different components, are
paired and verified, so no link between components is lost.

Hot prefix hashes, which more than FREQUENT documents have, make no pairs; what they may add to a pair's shared hashes
counts as shared. Their documents are compared with a hub: every document x with the one o that has the most hot hashes,
by the differences d(x) of the sets x and o. As x and y link exactly if d(x) and d(y) differ in no more than r =
(1 - t) / (1 + t) (m + n) places, (1) documents with |d(x)| + |d(y)| <= r link, and all such are linked with the one
closest to the hub; (2) others share a difference in prefixes of d(x) and d(y), which are short among near copies and
begin with the rarer additions: those that a good share of the hub's documents have lie behind the others. Where the documents that share a difference would make more than OWN_HUB pairs each,
they are a group with a hub of its own, the one closest to the former hub, and so on; each such group is smaller than the
one it comes from, as it lacks its hub. So every link is found, and no pairs are made that grow with the square of a group.

Verification compares the whole texts' shingle sets in Arrow batches. Shingles are compared by 64-bit hashes.

Results on odd input: null, empty and blank texts have no shingles and link with nothing; with fewer words than the
shingle size, the sequence itself is the only shingle; rows with a null doc_id link with nothing and have a null
component; rows that repeat a doc_id link through each of their texts; other columns of any name are ignored or
pass through; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestead.llm.common import anew, components, discard, hash_words, materialize, mix, named, pieces, ragged, small_batches, table, text_bytes

LEVELS = (1, 2, 4)
FREQUENT, HOT_MAX = 64, 100_000
#: Pairs a row from which on the documents that share a difference are compared with a hub of their own rather than paired.
OWN_HUB = 1_000
#: Differences that one in so many of a hub's documents has, and so many documents at least, are common.
COMMON, LEAST_COMMON = 64, 16
#: Verifying a candidate costs as much as reading so many places.
VERIFY_COST = 8.0
_U = np.uint64
_SALTS = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, 64, dtype=np.int64).astype(_U) | _U(1)


def shingle_sets(col: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    buf, at = text_bytes(col)
    h, first = hash_words(buf, at, lower=True)
    g = np.zeros(max(0, len(h) - size + 1), _U)
    for k in range(size):
        g += h[k : k + len(g)] * _SALTS[k]
    g = mix(g)
    for a, z in zip(first[:-1], first[1:], strict=True):
        if z - a >= size:
            yield np.unique(g[a : z - size + 1])
        elif z > a:  # too short: the sequence as a whole
            yield mix(np.sum(h[a:z] * _SALTS[: z - a], keepdims=True, dtype=_U) + _U(z - a))
        else:
            yield np.zeros(0, _U)


def _measure(size: int, percent: int, hot=None):
    def run(batches):
        late = hot.value if hot else np.zeros(0, _U)
        for whole in batches:
            for b in pieces(whole):
                n, s1, s2, pre = [], [], [], []
                for x in shingle_sets(b.column("text"), size):
                    need = -(-percent * len(x) // 100)
                    n.append(len(x))
                    s1.append(np.sum(mix(x * _SALTS[40]), dtype=_U))
                    s2.append(np.sum(mix(x * _SALTS[41]), dtype=_U))
                    if len(late):
                        on = late[np.minimum(np.searchsorted(late, x), len(late) - 1)] == x
                        x = np.concatenate([x[~on], x[on]])
                    pre.append(x[: len(x) - need + min(LEVELS[-1], need)].view(np.int64))
                starts = np.cumsum([0, *map(len, pre)])
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc"), pa.array(n, pa.int64()), pa.array(np.array(s1, _U).view(np.int64)), pa.array(np.array(s2, _U).view(np.int64)), ragged(np.concatenate(pre), starts)],
                    ["doc", "n", "s1", "s2", "prefix"],
                )

    return run


def _verify(size: int, percent: int):
    def run(batches):
        for whole in batches:
            for b in pieces(whole):
                keep = []
                for x, y in zip(shingle_sets(b.column("text"), size), shingle_sets(b.column("other"), size), strict=True):
                    both = len(x) + len(y) - len(np.union1d(x, y))
                    keep.append(bool(len(x) and len(y)) and 100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _differ(size: int, percent: int, hot=None):
    """Whether hub and document link, and their sets' differences: additions, frequent ones behind, then losses."""

    def run(batches):
        late = hot.value if hot else np.zeros(0, _U)
        for whole in batches:
            for b in pieces(whole):
                linked, far, n, toks, paths = [], [], [], [], []
                for x, o, path in zip(shingle_sets(b.column("text"), size), shingle_sets(b.column("other"), size), b.column("path").to_pylist(), strict=True):
                    more, less = np.setdiff1d(x, o, assume_unique=True), np.setdiff1d(o, x, assume_unique=True)
                    if len(late):
                        on = late[np.minimum(np.searchsorted(late, more), len(late) - 1)] == more
                        more = np.concatenate([more[~on], more[on]])
                    d, both = len(more) + len(less), len(x) - len(more)
                    linked.append(100 * both >= percent * (len(x) + len(less)))
                    far.append(d)
                    n.append(len(x))
                    toks.append(np.concatenate([more, mix(less + _SALTS[42])]).view(np.int64))
                    # one hub's several texts are told apart
                    paths.append(mix(np.sum(mix(o * _SALTS[43]), keepdims=True, dtype=_U) + np.array([path]).view(_U) * _SALTS[44]))
                starts = np.cumsum([0, *map(len, toks)])
                path = np.concatenate(paths).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(path), b.column("a"), b.column("b"), pa.array(n, pa.int64()), pa.array(far, pa.int64()), pa.array(linked, pa.bool_()), ragged(np.concatenate(toks), starts)], ["path", "hub", "doc", "n", "d", "linked", "toks"])

    return run


def _linked(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole texts meet the threshold. texts: doc, text."""
    return _with_texts(pairs, texts).mapInArrow(_verify(size, percent), "a long, b long")


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    d = pairs.join(texts.selectExpr("doc b", "text"), "b")
    return d.join(texts.selectExpr("doc a", "text other"), "a")


def _beside(differ: DataFrame, cc: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """What is left to compare among the documents of each hub, from their differences to it.

    Returns candidate pairs (a, b), and the rows (path, tok, doc, d) of groups that would make more than OWN_HUB pairs a
    row, for a hub of their own. Of a pair, the document with fewer differences meets the other in a short prefix (at most
    half the room that linked documents' differences have), the other in a long one. Documents of the hub's component ("own") only meet others.
    """
    d = _named(differ, cc).join(cc.selectExpr("node hub", "component at"), "hub", "left").withColumn("own", F.expr("component = coalesce(at, hub)")).drop("at", "linked")
    d = materialize(d, "named")
    discard(differ)
    about = d.groupBy("path").agg(F.min(F.when(~F.col("own"), F.col("d"))).alias("least"), F.max("n").alias("top"), F.count("*").alias("docs")).where("least IS NOT NULL")
    d = d.join(anew(about, "path"), "path").withColumn("room", F.expr(f"{100 - percent} * (n + least(top, 100 * n div {percent})) div {100 + percent}"))
    # differences that a good share of a hub's documents have early go behind the others; their number is at most COMMON times the mean one
    common = d.select("path", "docs", F.explode(F.expr("slice(toks, 1, int(2 * room) + 2)")).alias("tok")).groupBy("path", "tok").agg(F.count("*").alias("c"), F.max("docs").alias("docs"))
    common = common.where(f"c >= greatest({LEAST_COMMON}, docs / {COMMON})").groupBy("path").agg(F.collect_list("tok").alias("common"))
    d = d.join(anew(common, "path"), "path", "left").withColumn("common", F.coalesce("common", F.array().cast("array<long>")))
    d = d.withColumn("toks", F.concat(F.array_except("toks", "common"), F.array_intersect("toks", "common")))
    d = d.withColumn("reach", F.expr("(d - if(own, least, 0) + room) div 2"))
    d = d.select("path", "doc", "n", "d", "component", "own", "room", F.posexplode(F.expr("slice(toks, 1, greatest(0, least(reach, room) + 1))")).alias("i", "tok"))
    rows = materialize(d.withColumn("brief", F.expr("i <= room div 2")).drop("room"), "beside")
    n = lambda x: F.count_if(F.expr(x))
    sizes = rows.groupBy("path", "tok").agg(F.count("*").alias("all"), n("own").alias("near"), n("own AND brief").alias("s0"), n("NOT own AND brief").alias("s1"), F.min("component").alias("c0"), F.max("component").alias("c1"))
    sizes = sizes.where("c0 < c1").withColumn("pairs", F.expr("s1 * all + s0 * (all - near)")).where("pairs > 0").select("path", "tok", F.expr(f"pairs > {OWN_HUB} * all").alias("many"))
    met = rows.join(anew(sizes, "path", "tok"), ["path", "tok"])
    more, few = met.where("many").select("path", "tok", "doc", "d"), met.where("NOT many")
    x, y = (few.selectExpr("path", "tok", f"doc {k}", f"n n{k}", f"d d{k}", f"i i{k}", f"component c{k}", f"own o{k}", f"brief s{k}") for k in "ab")
    share = f"greatest(0, ceil((da + db - ({100 - percent} * (na + nb) div {100 + percent})) / 2))"
    fits = f"100 * least(na, nb) >= {percent} * greatest(na, nb) AND ia <= da - {share} AND ib <= db - {share}"
    pairs = x.where("sa").join(y, ["path", "tok"]).where(f"(da < db OR (da = db AND a < b)) AND ca <> cb AND NOT (oa AND ob) AND {fits}")
    return pairs.selectExpr("least(a, b) a", "greatest(a, b) b"), more


def _named(d: DataFrame, cc: DataFrame) -> DataFrame:
    return d.join(cc.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))


def links(docs: DataFrame, size: int = 4, percent: int = 85, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(sets, classes): sets has doc, n (set size), rep (smallest document with an equal set);
    classes has node, component for each representative that links with another."""
    small_batches(docs.sparkSession)
    t = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    form = "doc long, n long, s1 long, s2 long, prefix array<long>"
    sets = materialize(t.mapInArrow(_measure(size, percent), form), "sets")
    hot = sets.select(F.explode("prefix").alias("tok")).groupBy("tok").agg(F.count("*").alias("df")).where(F.col("df") >= FREQUENT).orderBy(F.desc("df"), "tok").limit(HOT_MAX).toPandas()
    late = None
    if len(hot):
        discard(sets)
        late = docs.sparkSession.sparkContext.broadcast(np.sort(hot["tok"].to_numpy().view(_U)))
        sets = materialize(t.mapInArrow(_measure(size, percent, late), form), "sets")
    some = sets.where("n > 0")
    reps = materialize(some.groupBy("s1", "s2", "n").agg(F.min("doc").alias("doc"), F.any_value("prefix").alias("prefix")), "reps")
    tokens = reps.select("doc", "n", F.posexplode("prefix").alias("i", "tok"))
    often = tokens.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1")
    need = F.ceil(F.col("n") * percent / 100)
    shared = materialize(tokens.join(anew(often, "tok"), "tok").select("doc", "n", "i", "tok", "df"), "prefix")

    within = lambda level: F.col("i") < F.col("n") - need + F.least(F.lit(level), need)
    alike = lambda level: F.col("i") < F.col("n") - F.ceil(F.col("n") * (2 * percent) / (100 + percent)) + level  # noqa: E731  what partners of the same size ask for
    often = F.col("df") > FREQUENT
    places = [F.sum(F.when(alike(x) & ~often, F.col("df") - 1).otherwise(0)).alias(f"c{x}") for x in LEVELS] + [F.count_if(within(x) & often).alias(f"h{x}") for x in LEVELS]
    cost = F.array_sort(F.array(*[F.struct((F.col(f"c{x}") * (1 + VERIFY_COST / x)).alias("cost"), F.lit(x).alias("level"), F.col(f"h{x}").alias("h")) for x in LEVELS]))
    level = shared.groupBy("doc").agg(*places).select("doc", "h1", F.get(cost, F.lit(0)).alias("best")).select("doc", "h1", "best.level", "best.h")
    chosen = shared.join(level, "doc").withColumn("level", F.least("level", need)).where(within(1) | (F.col("i") < F.col("n") - need + F.col("level")))
    chosen = materialize(chosen.select("tok", "doc", "n", F.col("level").cast("int").alias("level"), "i", often.alias("hot"), "h", "h1", within(1).alias("first")), "chosen")
    discard(shared)

    both = f"ceil({percent} * (na + nb) / {100 + percent})"
    fits = f"100 * least(na, nb) >= {percent} * greatest(na, nb) AND ia < na - {both} + least(la, lb) AND ib < nb - {both} + least(la, lb)"
    # the first hash that a pair shares lies within the prefixes of l = 1; hot ones, met at a hub, may be among those it shares
    counted = [F.count("*").alias("c"), F.min(F.least("la", "lb") - F.least("ha", "hb")).alias("l"), F.min(F.expr(f"greatest(ia - na, ib - nb) + {both}")).alias("first")]
    cold = chosen.where("NOT hot")
    sides = [cold.selectExpr("tok", f"doc {k}", f"n n{k}", f"level l{k}", f"i i{k}", f"h h{k}") for k in "ab"]
    hub = cold.groupBy("tok").agg(F.min(F.struct("doc", "n", "level", "i", "h")).alias("o")).selectExpr("tok", "o.doc a", "o.n na", "o.level la", "o.i ia", "o.h ha")
    star = sides[1].join(hub, "tok").where("a < b").where(fits)
    star = materialize(star.groupBy("a", "b").agg(*counted).where("c >= l AND first < 1").select("a", "b"), "star")
    near = materialize(_linked(star, t, size, percent), "near")

    # hot hashes: each one's documents are compared with a hub, the one among them with the most hot hashes
    form = "path long, hub long, doc long, n long, d long, linked boolean, toks array<long>"
    groups = chosen.where("hot AND first").select(F.lit(0).cast("long").alias("path"), "tok", "doc", (-F.col("h1")).alias("d"))
    edges, first, rest = near, None, []
    while True:
        hubs = groups.groupBy("path", "tok").agg(F.min(F.struct("d", "doc"))["doc"].alias("a"))
        pairs = groups.join(anew(hubs, "path", "tok"), ["path", "tok"]).where("a <> doc").select(F.xxhash64("path", "a").alias("path"), "a", F.col("doc").alias("b")).distinct()
        pairs = materialize(pairs, "hubs")
        if pairs.isEmpty():
            break
        differ = materialize(_with_texts(pairs, t).mapInArrow(_differ(size, percent, late), form), "differ")
        # two documents whose differences to the hub are together small enough link; so all of them link with the closest one
        slack = F.expr(f"{100 + percent} * d - {100 - percent} * n")
        closest = differ.groupBy("path").agg(F.min(F.struct(slack.alias("s"), F.col("doc"))).alias("o")).selectExpr("path", "o.s s", "o.doc a")
        close = differ.join(anew(closest, "path"), "path").where(slack + F.col("s") <= 0).where("a <> doc").selectExpr("a", "doc b")
        edges = edges.unionByName(materialize(differ.where("linked").selectExpr("hub a", "doc b").unionByName(close), "edges"))
        cc = components(edges, "cc")
        first = cc if first is None else first
        found, groups = _beside(differ, cc, percent)
        rest.append(found)
        groups = materialize(groups, "groups")
    first = components(near, "cc") if first is None else first

    # the other candidates of cold hashes: those of different components
    open_ = materialize(_named(cold, first), "named")
    mixed = open_.groupBy("tok").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("tok")
    open_ = open_.join(mixed, "tok")
    sides = [open_.selectExpr("tok", f"doc {k}", f"n n{k}", f"level l{k}", f"i i{k}", f"h h{k}", f"component c{k}") for k in "ab"]
    far = sides[0].join(sides[1], "tok").where("ca < cb").where(fits).groupBy("a", "b").agg(*counted).where("c >= l AND first < 1").selectExpr("least(a, b) a", "greatest(a, b) b")
    for found in rest:
        far = far.unionByName(found)
    far = materialize(far.distinct().join(star, ["a", "b"], "left_anti"), "rest")
    far = materialize(_linked(far, t, size, percent), "far")
    final = components(edges.unionByName(far).distinct(), "cc")
    ids = reps.select("s1", "s2", "n", F.col("doc").alias("rep"))
    return sets.select("doc", "n", "s1", "s2").join(ids, ["s1", "s2", "n"], "left").select("doc", "n", F.coalesce("rep", "doc").alias("rep")).distinct(), final


def classes(docs: DataFrame, size: int = 4, percent: int = 85, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document (doc, n, component): its set's size and the smallest doc_id that links reach."""
    sets, cc = links(docs, size, percent, text, key)
    d = sets.join(cc.withColumnRenamed("node", "rep"), "rep", "left").select("doc", "n", F.coalesce("component", "rep").alias("component"))
    return d.groupBy("doc").agg(F.max("n").alias("n"), F.min("component").alias("component"))


def keep_one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without those that have a near copy with a smaller doc_id in their group; rows with a null doc_id stay."""
    gone = classes(docs, size, percent, text, key).where("doc <> component").selectExpr(f"doc `{key}`")
    return docs.join(gone, key, "left_anti").select(*named(docs.columns))


def op10_ngram_join(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = docs.select("doc_id").join(classes(docs).withColumnRenamed("doc", "doc_id"), "doc_id", "left")
    return d.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), F.col("component").alias("component_id"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a) m USING (doc_id)"""
QUERIES = {"op10_ngram_join": op10_ngram_join}
ORACLES = {"op10_ngram_join": _SQL}
