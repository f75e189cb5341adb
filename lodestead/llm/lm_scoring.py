"""Operator 6, LM scoring: a gated recurrent language model in numpy with a class-factored softmax.

1. Word counts of all training documents are summed by Spark; they give the unigram base score of every text.
2. The model's vocabulary is the VOCABULARY most frequent words, the end and "another word". Each word belongs to a
   class (about equal shares of the square root of the counts), and P(word | state) = P(class | state) * P(word | class,
   state). Another word has, in addition, its share of the remaining counts, so the model gives every text a probability.
3. Texts are read once more and become ids. Training documents are dealt into shards of about SHARD_TOKENS tokens by a
   hash of their ids, so their number grows with the input, and each shard trains a model: truncated backpropagation through windows of
   WINDOW tokens with the state carried on, by Adam. After each of ROUNDS rounds, which take a share of the documents
   each and all of them together, Spark averages the shards' weights by their tokens. Shards and their order depend on
   the documents alone, not on partitions. Output weights start at zero and biases at the log shares of the words,
   so that the model begins as the unigram model.
4. Scoring runs all texts of a batch side by side, longest first; the state goes on from window to window to the end.

Counts of the most frequent words (at most HEAD) and the model (its size is fixed by parameters) are broadcast; rarer words meet
their counts in a join. Words are told apart by 64-bit hashes.

Results on odd input: null and empty texts consist of the end alone; rows with a null doc_id are trained on and scored
(a null remainder isn't held out) and keep their null id; repeated rows are each scored; other columns aren't read; an
empty table gives an empty table; without training documents both scores are those of no knowledge (N = V = 0).
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestead.llm.common import discard, hash_words, materialize, pieces, ragged, small_batches, table, text_bytes

HEAD, VOCABULARY, CLASSES, HIDDEN = 131_072, 2046, 32, 16
WINDOW, LANES, UPDATES, RATE, ROUNDS = 32, 256, 120, 0.02, 2
#: Tokens of a shard, about; a shard with fewer than EPOCH_TOKENS a round is learned again, EPOCHS times at most.
SHARD_TOKENS, EPOCH_TOKENS, EPOCHS = 2_000_000, 500_000, 4
#: Tokens that are scored side by side, at most, unless a text alone has more.
SIDE_BY_SIDE = 3_000_000
END = 0x5EED_0E4D  # stands for the end among word hashes
_F = np.float32


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))


def _count(batches):
    """Counts of a partition's words; they are merged now and then, so memory holds its distinct words."""
    words, counts, ends, kept = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, []

    def merged():
        w = np.concatenate([words, *[k[0] for k in kept]])
        u, i = np.unique(w, return_inverse=True)
        return u, np.bincount(i, np.concatenate([counts, *[k[1] for k in kept]]), len(u)).astype(np.int64)

    for whole in batches:
        for b in pieces(whole):
            h, _ = hash_words(*text_bytes(b.column("text")), lower=True)
            kept.append(np.unique(h, return_counts=True))
            ends += b.num_rows
            if sum(len(k[0]) for k in kept) > 1_000_000:
                (words, counts), kept = merged(), []
    words, counts = merged()
    words, counts = np.append(words, np.uint64(END)), np.append(counts, ends)
    for a in range(0, len(words), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(words[a : a + 100_000].view(np.int64)), pa.array(counts[a : a + 100_000])], ["word", "c"])


class Words:
    """The most frequent words: sorted hashes, counts, and the model's ids (by class; 0: the end, 1: another word)."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, distinct: int, ends: int) -> None:
        order = np.lexsort((words, -counts))
        top = order[:VOCABULARY]
        self.total, self.distinct, self.ends = total, distinct, ends
        weight = np.concatenate([[ends, max(0, total - ends - counts[top].sum())], counts[top]]).astype(float) + 0.5
        self.shares = weight / weight.sum()
        root = np.concatenate([[0, 0], np.cumsum(np.sqrt(weight[2:]))])
        cls = np.minimum((root / max(root[-1], 1e-9) * (CLASSES - 2)).astype(int), CLASSES - 3) + 2
        cls[:2] = 0, 1
        self.starts = np.searchsorted(cls, np.arange(CLASSES + 1))
        self.cls = cls
        rank = np.argsort(words)
        self.words, self.counts = words[rank], counts[rank]
        ids = np.full(len(words), 1, np.int32)
        ids[top] = np.arange(2, 2 + len(top))
        self.ids = ids[rank]
        # what a word beyond the vocabulary has of "another word": its count in all that remains, unknown ones included
        self.rest = max(0.0, total - ends - counts[top].sum()) + 0.5 * max(1, distinct - len(top))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's place in self.words, and whether it is one of them."""
        if not len(self.words):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return at, self.words[at] == h


class Gru:
    """The model; self.p holds its weights. forward() and learn() work on whatever lanes they are given."""

    NAMES = ("emb", "wx", "bx", "u", "wc", "bc", "ww", "bw")

    def __init__(self, words: Words, flat: np.ndarray | None = None) -> None:
        n, h = len(words.shares), HIDDEN
        rng = np.random.Generator(np.random.PCG64(7))
        share = np.array([words.shares[a:z].sum() for a, z in zip(words.starts[:-1], words.starts[1:], strict=True)])
        self.starts, self.cls = words.starts, words.cls
        self.p = {
            "emb": rng.normal(0, 0.3, (n, h)).astype(_F), "wx": rng.normal(0, 0.3, (h, 3 * h)).astype(_F), "bx": np.zeros(3 * h, _F), "u": rng.normal(0, 0.25, (h, 3 * h)).astype(_F),
            "wc": np.zeros((h, CLASSES), _F), "bc": np.log(np.maximum(share, 1e-12)).astype(_F), "ww": np.zeros((n, h), _F), "bw": np.log(words.shares / np.maximum(share[words.cls], 1e-12)).astype(_F),
        }
        if flat is not None:
            at = 0
            for k in self.NAMES:
                size = self.p[k].size
                self.p[k] = flat[at : at + size].astype(_F).reshape(self.p[k].shape)
                at += size
        self.inputs = None

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.NAMES])

    def step(self, x: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
        """x: what the input words give the gates."""
        h = HIDDEN
        a = s @ self.p["u"]
        g = np.tanh((x[:, : 2 * h] + a[:, : 2 * h]) * _F(0.5)) * _F(0.5) + _F(0.5)
        z, r = g[:, :h], g[:, h:]
        c = np.tanh(x[:, 2 * h :] + r * a[:, 2 * h :])
        return c + z * (s - c), z, r, c, a[:, 2 * h :]

    def log_p(self, s: np.ndarray, y: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probabilities of words y in states s; with grads, also the loss's derivative by s."""
        p, k = self.p, self.cls[y]
        order = np.argsort(k.astype(np.int16), kind="stable")  # a class's words lie together
        ends = np.searchsorted(k, np.arange(CLASSES + 1), sorter=order)
        s, k, y = s[order], k[order], y[order]
        i = np.arange(len(y))
        logit = s @ p["wc"] + p["bc"]
        logit -= logit.max(1, keepdims=True)
        own = logit[i, k]
        e = np.exp(logit, out=logit)
        total = e.sum(1)
        out, ds = own - np.log(total), None
        if grads is not None:
            d = e / total[:, None]
            d[i, k] -= 1
            grads["wc"] += s.T @ d
            grads["bc"] += d.sum(0)
            ds = d @ p["wc"].T
        for c in range(CLASSES):
            a, z = self.starts[c], self.starts[c + 1]
            if z - a < 2 or ends[c] == ends[c + 1]:
                continue  # a class of one word adds nothing
            at = slice(ends[c], ends[c + 1])
            w, j = p["ww"][a:z], i[: ends[c + 1] - ends[c]]
            logit = s[at] @ w.T + p["bw"][a:z]
            logit -= logit.max(1, keepdims=True)
            own = logit[j, y[at] - a]
            e = np.exp(logit, out=logit)
            total = e.sum(1)
            out[at] += own - np.log(total)
            if grads is not None:
                e /= total[:, None]
                e[j, y[at] - a] -= 1
                grads["ww"][a:z] += e.T @ s[at]
                grads["bw"][a:z] += e.sum(0)
                ds[at] += e @ w
        back = np.empty_like(order)
        back[order] = i
        return out[back], None if ds is None else ds[back]

    def loss_and_grads(self, x: np.ndarray, y: np.ndarray, learned: np.ndarray, s: np.ndarray) -> tuple[float, dict, np.ndarray]:
        """Of one window: the negative log probability of the learned words y after the inputs x (steps by lanes), its
        derivatives, and the last state. s: the state before; an end among the inputs resets it."""
        h, p, lanes = HIDDEN, self.p, x.shape[1]
        emb = p["emb"][x]
        gate = emb @ p["wx"] + p["bx"]
        kept, states = [], np.empty((len(y), lanes, h), gate.dtype)
        for i in range(len(y)):
            on = (x[i] != 0).astype(gate.dtype)[:, None]
            was = s * on
            s, z, r, c, an = self.step(gate[i], was)
            kept.append((was, z, r, c, an, on))
            states[i] = s
        g = {k: np.zeros_like(w) for k, w in p.items()}
        ds = np.zeros_like(states)
        lp, ds[learned] = self.log_p(states[learned], y[learned], g)
        dgate, da, back = np.empty_like(gate), np.empty((lanes, 3 * h), gate.dtype), np.zeros((lanes, h), gate.dtype)
        before, after = np.empty_like(states), np.empty_like(gate)
        for i in range(len(y) - 1, -1, -1):
            was, z, r, c, an, on = kept[i]
            d = ds[i] + back
            dc = d * (1 - z) * (1 - c * c)
            da[:, :h] = d * (was - c) * z * (1 - z)
            da[:, h : 2 * h] = dc * an * r * (1 - r)
            dgate[i, :, : 2 * h] = da[:, : 2 * h]
            dgate[i, :, 2 * h :] = dc
            da[:, 2 * h :] = dc * r
            before[i], after[i] = was, da
            back = (d * z + da @ p["u"].T) * on
        flat = dgate.reshape(-1, 3 * h)
        g["u"] += before.reshape(-1, h).T @ after.reshape(-1, 3 * h)
        g["wx"] += emb.reshape(-1, h).T @ flat
        g["bx"] += flat.sum(0)
        order = np.argsort(x.reshape(-1), kind="stable")
        words, first = np.unique(x.reshape(-1)[order], return_index=True)
        g["emb"][words] = np.add.reduceat((flat @ p["wx"].T)[order], first)
        return float(-lp.sum()), g, s

    def learn(self, stream: np.ndarray) -> None:
        """Truncated backpropagation through a stream of ids, cut into lanes; the end resets a lane's state.

        Each id but the first is predicted once; lanes that end early are filled up, and what fills them isn't learned.
        A short stream gets fewer lanes, so that it makes enough steps.
        """
        n = len(stream) - 1
        if n < 1:
            return
        lanes = max(1, min(LANES, n // (WINDOW * UPDATES)))
        steps = -(-n // lanes)
        fill = np.zeros(lanes * steps - n, stream.dtype)
        given, wanted = (np.append(x, fill).reshape(lanes, steps).T for x in (stream[:-1], stream[1:]))
        real = (np.arange(lanes * steps) < n).reshape(lanes, steps).T
        s, p = np.zeros((lanes, HIDDEN), _F), self.p
        m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
        for t, a in enumerate(range(0, steps, WINDOW), 1):
            learned = real[a : a + WINDOW]
            _, g, s = self.loss_and_grads(given[a : a + WINDOW], wanted[a : a + WINDOW], learned, s)
            rate = RATE * np.sqrt(1 - 0.999**t) / (1 - 0.9**t) * min(1.0, t / 20)
            for k, w in p.items():
                d = g[k] / _F(learned.sum())
                m[k] += _F(0.1) * (d - m[k])
                v[k] += _F(0.001) * (d * d - v[k])
                w -= _F(rate) * m[k] / (np.sqrt(v[k]) + _F(1e-6))

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each text of ids, its end included."""
        out, sizes = np.zeros(len(texts)), np.array([len(x) + 1 for x in texts])
        order = np.argsort(-sizes, kind="stable")
        size = sizes[order]
        first = np.cumsum(size) - size
        flat = np.zeros(size.sum(), np.int32)
        for k, i in enumerate(order):
            flat[first[k] : first[k] + size[k] - 1] = texts[i]
        table = self.p["emb"] @ self.p["wx"] + self.p["bx"]
        s, t, now = np.zeros((len(texts), HIDDEN), _F), 0, np.zeros(len(texts), np.int64)
        while t < (size[0] if len(size) else 0):
            states, ys, who = [], [], []
            done = 0
            while t < size[0] and done < 20_000:
                n = int(np.searchsorted(-size, -t, "left"))  # lanes that still run
                s = self.step(table[now[:n]], s[:n])[0]
                now = flat[first[:n] + t]
                states.append(s)
                ys.append(now)
                who.append(np.arange(n))
                t, done = t + 1, done + n
            lp, _ = self.log_p(np.concatenate(states), np.concatenate(ys))
            out[: len(who[0])] += np.bincount(np.concatenate(who), lp, len(who[0]))
        back = np.empty(len(texts))
        back[order] = out
        return back


def _dump(words: Words, flat: np.ndarray) -> bytes:
    f = io.BytesIO()
    np.savez(f, words=words.words, counts=words.counts, n=np.array([words.total, words.distinct, words.ends]), flat=flat)
    return f.getvalue()


def _load(data: bytes) -> tuple[Words, Gru]:
    x = np.load(io.BytesIO(data))
    w = Words(x["words"], x["counts"], *map(int, x["n"]))
    return w, Gru(w, x["flat"] if len(x["flat"]) else None)


def _read(shared):
    """Texts become ids; what the counts give is worked out at once, so that the texts are read no more."""

    def run(batches):
        words, _ = _load(shared.value)
        denominator = words.total + 0.5 * (words.distinct + 1)
        own = np.log10((words.counts + 0.5) / denominator)
        end = np.log10((words.ends + 0.5) / denominator)
        inside = np.log10((words.counts + 0.5) / words.rest)
        for whole in batches:
            for b in pieces(whole):
                h, first = hash_words(*text_bytes(b.column("text")), lower=True)
                at, ok = words.find(h)
                doc = np.repeat(np.arange(b.num_rows), np.diff(first))
                if len(words.words):
                    ids = np.where(ok, words.ids[at], 1)
                    add = lambda x, on: np.bincount(doc[on], x[at[on]], b.num_rows).astype(float)  # noqa: B023, E731
                    base, extra = add(own, ok) + end, add(inside, ok & (ids == 1))
                else:
                    ids, base, extra = np.ones(len(h), np.int64), np.zeros(b.num_rows) + end, np.zeros(b.num_rows)
                known = np.bincount(doc[ok], minlength=b.num_rows) + int(words.ends > 0)
                starts = np.concatenate([[0], np.cumsum(np.bincount(doc[~ok], minlength=b.num_rows))])
                yield pa.RecordBatch.from_arrays(
                    [b.column("key"), b.column("held_out"), b.column("deal"), pa.array(np.diff(first) + 1), pa.array(known), pa.array(base), pa.array(extra), ragged(ids.astype(np.int16), first, pa.int16()), ragged(h[~ok].view(np.int64), starts)],
                    ["key", "held_out", "deal", "n_tokens", "known", "base", "extra", "ids", "tail"],
                )

    return run


def _train(shared):
    """A model for each shard from its rows, which lie together and in one order; its weights and tokens."""

    def run(batches):
        words, gru = _load(shared.value)
        now, stream, given = None, [], gru.flat()

        def learned():
            ids = np.concatenate([np.zeros(1, np.int32), *stream])
            own = Gru(words, given)
            for _ in range(min(EPOCHS, -(-EPOCH_TOKENS // len(ids)))):
                own.learn(ids)
            yield pa.RecordBatch.from_arrays([ragged(own.flat(), np.array([0, len(given)]), pa.float32()), pa.array([len(ids) - 1], pa.int64())], ["w", "n"])

        for b in batches:
            shard, at = b.column("shard").to_numpy(), b.column("ids").offsets.to_numpy()
            ids = b.column("ids").values.to_numpy()
            for k in range(b.num_rows):
                if shard[k] != now and stream:
                    yield from learned()
                    stream = []
                now = shard[k]
                stream.append(np.append(ids[at[k] : at[k + 1]], 0).astype(np.int32))
        if stream:
            yield from learned()

    return run


def _score(shared):
    def run(batches):
        _, gru = _load(shared.value)
        todo, texts, n = [], [], 0

        def flush():
            model = gru.score(texts) / np.log(10)
            k = 0
            for b in todo:
                extra = b.column("extra").to_numpy()
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in _SLIM), pa.array(model[k : k + b.num_rows] + extra)], [*_SLIM, "score"])
                k += b.num_rows

        for b in batches:
            at, ids = b.column("ids").offsets.to_numpy(), b.column("ids").values.to_numpy().astype(np.int32)
            texts += [ids[a:z] for a, z in zip(at[:-1], at[1:], strict=True)]
            todo.append(pa.RecordBatch.from_arrays([b.column(c) for c in [*_SLIM, "extra"]], [*_SLIM, "extra"]))
            n += int(at[-1] - at[0])
            if n > SIDE_BY_SIDE:
                yield from flush()
                todo, texts, n = [], [], 0
        if todo:
            yield from flush()

    return run


_SLIM = ["key", "held_out", "n_tokens", "known", "base", "tail", "row"]


def _most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows with the largest counts, about `most`: whole classes of the counts' logarithm and, of the next one, an even
    share by the words' hash. So nothing is sorted in one place and only the classes' sizes come to the driver beforehand."""
    grade = F.floor(F.log2("c") * 16)
    least, next_, have, part = 1 << 20, 1 << 20, 0, 0
    for r in counts.groupBy(grade.alias("g")).agg(F.count("*").alias("n")).orderBy(F.desc("g")).collect():
        if have + r.n > most:
            next_, part = r.g, int((most - have) / r.n * 2**20)
            break
        have, least = have + r.n, r.g
    return counts.where((grade >= least) | ((grade == next_) & (F.pmod(F.xxhash64("word"), F.lit(2**20)) < part)))


def score_texts(docs: DataFrame, text: str = "text", key: str = "doc_id", learn_from: Column | None = None) -> DataFrame:
    """One row per document: key, held_out, n_tokens, n_known, train_tokens, base_score and score (both log10)."""
    small_batches(docs.sparkSession)
    spark, kind = docs.sparkSession, dict(docs.dtypes)[key]
    out = held_out(key) if learn_from is None else ~learn_from
    d = docs.select(F.col(key).alias("key"), out.alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = materialize(d.where("NOT held_out").select("text").mapInArrow(_count, "word long, c long").groupBy("word").agg(F.sum("c").alias("c")).where("c > 0"), "counts")
    total, distinct, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.max(F.when(F.col("word") == END, F.col("c"))), F.lit(0))).first()
    head = _most_frequent(counts.where(F.col("word") != END), HEAD).toPandas()
    words = Words(head["word"].to_numpy().view(np.uint64), head["c"].to_numpy(), total, distinct, ends)
    flat = np.zeros(0, _F)
    shared = spark.sparkContext.broadcast(_dump(words, flat))
    form = f"key {kind}, held_out boolean, deal long, n_tokens long, known long, base double, extra double, ids array<short>, tail array<long>"
    deal = F.xxhash64(F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit("deal"))
    rows = materialize(d.withColumn("deal", deal).mapInArrow(_read(shared), form).withColumn("row", F.monotonically_increasing_id()), "ids")

    # shards are dealt by the documents' ids and trained in an order of their own, so the model doesn't depend on partitions
    shards = -(-int(total) // SHARD_TOKENS) or 1
    train = rows.where("NOT held_out").select((F.pmod(F.shiftrightunsigned("deal", 32), F.lit(shards))).cast("int").alias("shard"), F.pmod("deal", F.lit(ROUNDS)).alias("round"), "deal", "ids")
    for k in range(ROUNDS):
        shared = spark.sparkContext.broadcast(_dump(words, flat))
        part = train.where(F.col("round") == k).repartition(shards, "shard").sortWithinPartitions("shard", "deal", "ids")
        models = part.select("shard", "ids").mapInArrow(_train(shared), "w array<float>, n long")
        got = models.select("n", F.posexplode("w").alias("i", "x")).groupBy("i").agg((F.sum(F.col("x").cast("double") * F.col("n")) / F.sum("n")).alias("x"))
        got = got.toPandas().sort_values("i")["x"].to_numpy().astype(_F)
        flat = got if len(got) else flat
    shared = spark.sparkContext.broadcast(_dump(words, flat))
    slim = f"key {kind}, held_out boolean, n_tokens long, known long, base double, tail array<long>, row long, score double"
    scored = materialize(rows.mapInArrow(_score(shared), slim), "scores")
    discard(rows)
    # words beyond the head: their counts come by a join, one row for each document and word
    rare = scored.where("size(tail) > 0").select("row", F.explode("tail").alias("word"))
    rare = rare.join(counts, "word", "left").groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("s"), F.count("c").alias("k"))
    n = F.size("tail")
    d = scored.join(rare, "row", "left")
    more = F.coalesce("s", F.lit(0.0))
    return d.select(
        F.col("key").alias(key), "held_out", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + more - n * F.lit(float(np.log10(total + 0.5 * (distinct + 1))))).alias("base_score"), (F.col("score") + more - n * F.lit(float(np.log10(words.rest)))).alias("score"),
    )


def op6_lm_scoring(spark, sf_dir) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op6_lm_scoring": op6_lm_scoring}
ORACLES = {}
