"""Operator 2, benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, edit verification.

Texts and items are compared as words: lower case, split at all but letters and digits. A document is contaminated by
an item if some stretch of it is within floor(MAX_EDITS * item length) word edits (insert, delete, replace).

The random walk of Chakraborty, Goldenberg and Koucky maps a word sequence to a longer one: at each step it writes the
current word and then moves on or not by a random bit of the step and the word, so sequences within few edits get
embeddings at a small Hamming distance. Each of REPEATS repetitions has a walk of its own, samples SAMPLED positions of
the embedding, and takes windows and items that agree on all of them for candidates. REPEATS follows from the recall
asked for: 1 - (1 - (1 - far) ** SAMPLED) ** REPEATS >= RECALL, where `far` is the share of positions in which the
embeddings of a window and an item at the largest allowed distance differ. Candidates are verified by the exact edit
distance between the item and the best stretch around the window.

An item of more than PART words is sought by its parts, of PART words at most, side by side: edits within the item's share leave at
least one of them within its own share, whatever they are and wherever they fall (else all parts together would have more). A
candidate of a part is verified against the whole item, aligned by the part's place in it.

Windows are embedded where they can lie within the distance at all: one edit breaks at most two of an item's word
pairs, so a window with too few word pairs of any item can be left out without loss.

The items' words are broadcast, behind a check of their size (MAX_CHARS); a larger benchmark is worked off in blocks.

Results on odd input: null and empty texts match nothing; items with fewer than MIN_WORDS words, or null, are left
out, since a few words can't identify an item, and so are items with a null id; several texts under one item id are
several items; rows with a null doc_id are reported with it, but never dropped by drop_contaminated; repeated rows are each reported; other columns pass through; empty tables give no matches.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestead.llm.common import hash_words, materialize, mix, named, pieces, small_batches, table, text_bytes

MAX_EDITS, MIN_WORDS, PART = 0.2, 5, 64
#: Characters of items that are broadcast at once, at most, unless one item alone has more.
MAX_CHARS = 4_000_000
SAMPLED, FAR, RECALL = 2, 0.5, 0.995
REPEATS = math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - FAR) ** SAMPLED))
#: Documents that are dropped through a broadcast of their ids, at most; beyond, through a shuffle.
BROADCAST_IDS = 1_000_000
_U = np.uint64
_PAIR = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


def normal(text: str | Column) -> Column:
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"[^\p{L}\p{N}]+", " ")


def edits_allowed(n: int, share: float) -> int:
    return int(share * n + 1e-9)


def best_stretch(items: np.ndarray, texts: np.ndarray, anchored: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Row by row, the least edit distance between an item and a stretch of the text, and the stretch's end.

    anchored: the stretch must begin with the text. All rows of one item length are worked on at once.
    """
    p, n = texts.shape
    j = np.arange(n + 1, dtype=np.int32)
    row = np.tile(j if anchored else np.zeros(n + 1, np.int32), (p, 1))
    for k in range(items.shape[1]):
        new = row + 1
        np.minimum(new[:, 1:], row[:, :-1] + (texts != items[:, k : k + 1]), out=new[:, 1:])
        row = np.minimum.accumulate(new - j, axis=1) + j  # insertions run along the row
    end = row.argmin(1)
    return row[np.arange(p), end], end


def embed(h: np.ndarray, at: np.ndarray, steps: int, seed: int, wanted: np.ndarray) -> np.ndarray:
    """A hash of the embeddings' symbols at the wanted steps, for the windows of h that begin at `at`."""
    i, out = at.copy(), np.zeros(len(at), _U)
    wanted = set(wanted.tolist())
    for step in range(steps):
        if step % 64 == 0:
            bits = mix(h ^ mix(np.array([seed * 1000 + step], _U)))
        if step in wanted:
            out = mix(out * _PAIR[0] + h[i])
        i += ((bits[i] >> _U(step % 64)) & _U(1)).astype(np.int64)
    return out


class Items:
    """The benchmark's items, and by length class their parts, with the parts' sampled embeddings."""

    def __init__(self, ids: list[int], texts: list[str], share: float) -> None:
        buf, at = text_bytes(pa.array(texts, pa.string()))
        h, first = hash_words(buf, at)
        self.items = [(int(z - a), i, h[a:z]) for i, a, z in zip(ids, first[:-1], first[1:], strict=True) if z - a >= MIN_WORDS]
        # parts: words, item number, hashes, place in the item
        items = []
        for k, (n, _, words) in enumerate(self.items):
            cut = np.linspace(0, n, -(-n // PART) + 1).astype(int)
            items += [(int(z - a), k, words[a:z], int(a)) for a, z in zip(cut[:-1], cut[1:], strict=True)]
        items.sort(key=lambda x: (x[0], x[1], x[3]))
        self.share, self.classes = share, []
        pairs = np.unique(np.concatenate([_pairs(x[2]) for x in items])) if items else np.zeros(0, _U)
        self.bits = max(16, 4 + int(len(pairs) + 1).bit_length())
        self.known = np.zeros(1 << self.bits, bool)
        self.known[(pairs >> _U(64 - self.bits)).astype(np.int64)] = True
        while items:
            some = [x for x in items if x[0] <= items[0][0] * 1.25]
            items = items[len(some) :]
            lo, hi = some[0][0], some[-1][0]
            need = max(1, min(n - 1 - 2 * edits_allowed(n, share) for n, *_ in some))
            reach = hi + edits_allowed(hi, share)
            draws = []
            flat = np.concatenate([np.concatenate([x[2], np.zeros(2 * hi, _U)]) for x in some])
            starts = np.cumsum([0, *[x[0] + 2 * hi for x in some]])[:-1]
            for rep in range(REPEATS):
                wanted = np.random.Generator(np.random.PCG64([lo, rep])).choice(lo * 2 - 2, SAMPLED, replace=False)
                keys = embed(flat, starts, int(wanted.max()) + 1, rep + 1, wanted)
                order = np.argsort(keys, kind="stable")
                draws.append((rep + 1, wanted, keys[order], order))
            self.classes.append((some, lo, need, reach, draws))


def _pairs(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * _PAIR[0] + h[1:] * _PAIR[1])


def find(items: Items, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
    """(text number, item id, first word, words, edits) of each text's best stretch for each item that it holds."""
    buf, at = text_bytes(texts)
    h, first = hash_words(buf, at)
    if len(h) < 2 or not items.classes:
        return []
    own = np.append((_pairs(h) >> _U(64 - items.bits)).astype(np.int64), 0)
    ok = items.known[own]
    ok[first[1:][first[1:] > 0] - 1] = False  # no pair crosses a text's end
    count = np.concatenate([[0], np.cumsum(ok)])
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for some, lo, need, reach, draws in items.classes:
        start = np.flatnonzero(count[np.minimum(np.arange(len(h)) + reach, len(h))] - count[:-1] >= need)
        if not len(start):
            continue
        # only what the walks can read is embedded: the stretches behind the starts, one behind another
        where, own_at = _stretches(start, 2 * lo)
        some_h = np.concatenate([h, np.zeros(2 * lo, _U)])[where]
        cand = []
        for seed, wanted, keys, order in draws:
            own = embed(some_h, own_at, int(wanted.max()) + 1, seed, wanted)
            a, z = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            hit = np.flatnonzero(z > a)
            size = (z - a)[hit]
            pos = np.repeat(a[hit] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            cand.append(np.stack([order[pos], np.repeat(start[hit], size)], 1))
        cand = np.unique(np.concatenate(cand), axis=0)
        if not len(cand):
            continue
        doc = np.searchsorted(first, cand[:, 1], "right") - 1
        whole, place = np.array([x[1] for x in some])[cand[:, 0]], np.array([x[3] for x in some])[cand[:, 0]]
        span = np.array([x[0] for x in items.items])[whole]
        # a verification covers the starts near it: one for each half item
        lead = np.unique(np.stack([whole, doc, (cand[:, 1] - place - first[doc]) // np.maximum(1, span // 2)], 1), axis=0)
        for k in np.unique(lead[:, 0]):
            n, item_id, words = items.items[k]
            d, half = lead[lead[:, 0] == k, 1], max(1, n // 2)
            at_ = first[d] + lead[lead[:, 0] == k, 2] * half
            slack = edits_allowed(n, items.share)
            lo_, width = np.maximum(first[d], at_ - half - slack), 3 * n + 4 * slack
            idx = lo_[:, None] + np.arange(width)[None, :]
            view = np.where(idx < first[d + 1][:, None], h[np.minimum(idx, len(h) - 1)], _U(0))
            for g in range(0, len(d), 512):
                dist, end = best_stretch(np.tile(words, (len(d[g : g + 512]), 1)), view[g : g + 512])
                for x in np.flatnonzero(dist <= slack):
                    new = (int(dist[x]), int(lo_[g + x] + end[x] - first[d[g + x]]), n)
                    if (old := best.get(key := (int(d[g + x]), item_id))) is None or new < old[:3]:
                        best[key] = (*new, view[g + x, : end[x]][::-1], words[::-1])
    out = []
    for (d, item_id), (dist, end, _, back, words) in sorted(best.items(), key=lambda x: x[0]):
        _, size = best_stretch(words[None, :], back[None, :], anchored=True)
        out.append((d, item_id, end - int(size[0]), int(size[0]), dist))
    return out


def _stretches(at: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The places from each of the ascending starts to `reach` behind it, without repeats, and the starts' numbers among them."""
    n = np.minimum(np.diff(at, append=at[-1] + reach), reach)
    first = np.cumsum(n) - n
    return np.repeat(at - first, n) + np.arange(n.sum()), first


def matches(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS, text: str = "text", key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """One row (key, item_id, first_word, n_words, n_edits) for each document and item that it holds, its best stretch."""
    small_batches(docs.sparkSession)
    rows = benchmark.select(F.col(item).cast("long").alias("i"), normal("text").alias("t")).where("i IS NOT NULL AND length(t) > 0").distinct()
    chars = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = -(-chars // MAX_CHARS) or 1
    kind, out = dict(docs.dtypes)[key], None
    d = docs.select(F.col(key).alias("key"), normal(text).alias("text"))
    for k in range(blocks):
        some = sorted(rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).collect())
        shared = docs.sparkSession.sparkContext.broadcast(([r.i for r in some], [r.t for r in some]))

        def run(batches, shared=shared):
            items = Items(*shared.value, max_edits)
            for whole in batches:
                for b in pieces(whole):
                    hits = find(items, b.column("text"))
                    x = [pa.array([h[c] for h in hits], pa.int64()) for c in range(5)]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(x[0]), *x[1:]], ["key", "item_id", "first_word", "n_words", "n_edits"])

        part = d.mapInArrow(run, f"key {kind}, item_id long, first_word long, n_words long, n_edits long")
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("key", key)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without those that hold an item of the benchmark."""
    gone = materialize(matches(docs, benchmark, max_edits, text, key).select(key).where(F.col(key).isNotNull()).distinct(), "contaminated")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, key, "left_anti").select(*named(docs.columns))


def op2_decontamination(spark, sf_dir) -> DataFrame:
    return matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


QUERIES = {"op2_decontamination": op2_decontamination}
ORACLES = {}
