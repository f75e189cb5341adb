"""Operator 8, toxicity: misspelled lexicon terms are caught by Levenshtein automata run over the lexicon's trie.

1. From a bounded sample of labelled documents (LEARN_FROM rows with the least hashes), words that are far more frequent
   in toxic documents (and occur in LEAST_TOXIC and one in a hundred of them at least) become the lexicon (at most LEXICON terms), weighted by their log odds.
2. The terms' Levenshtein automata and their trie are one automaton: a state is a set of (trie node, edits). It is made
   deterministic state by state as words ask for it; a word is read once, whatever the lexicon's size. Terms of five
   letters may differ by one edit, of twelve by two, shorter ones not at all. Near words that are more at home in clean
   documents than in toxic ones (log odds of their counts under CLEAN_ODDS, whatever the sample's size) aren't taken for
   misspellings, and terms with such near words, seen once, in a share of the clean documents over NOISE by more than chance
   aren't sought misspelled.
3. Around each hit, a window of words is scored for quotation (quotation marks, words of reporting) against address
   (second person); a logistic regression over sums of hits in abuse and in quotation gives the score; a misspelled hit
   counts as MISSPELLED of an exact one. Only the text is an input of it.

Results on odd input: null and empty texts have no hits and get the score of a document without hits; labels that are
null, or of documents that aren't there, are ignored; rows with a null doc_id are scored; repeated rows are each scored;
a document with several labels counts once, as toxic if one of them says so; without labels the lexicon is empty and
every score is 0.5 at most (predicted 0); other columns aren't read; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestead.llm.common import discard, materialize, pieces, small_batches, table

LEARN_FROM, LEXICON, LEAST_TOXIC, LEAST_ODDS, CONTEXT = 20_000, 1_000, 6, 3.0, 8
CLEAN_ODDS, NOISE, MISSPELLED = -0.5, 0.001, 0.7
#: Words whose verdict a Python worker remembers; beyond it, it starts anew. States of the automaton, likewise.
REMEMBERED, STATES = 400_000, 200_000
_WORD = re.compile(r"[^\W_]+")
_QUOTES = frozenset("\"“”«»„‟‘’")
#: Words of reporting and of address in the four languages.
REPORTING = frozenset("said says wrote called quote quoted word term dit disait écrit mot terme sagte schrieb nannte wort begriff dijo dice escribió palabra término".split())
ADDRESS = frozenset("you your yours tu toi ton vous votre du dich dein ihr euch tú te usted ustedes vosotros".split())


def edits_for(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 12 else 2


class Automaton:
    """The union of the terms' Levenshtein automata over their trie, made deterministic on demand."""

    def __init__(self, terms: list[str]) -> None:
        self.terms = terms
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.most: list[int] = [0]
        for k, term in enumerate(terms):
            node, allowed = 0, edits_for(term)
            for c in term:
                self.most[node] = max(self.most[node], allowed)
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.ends.append(-1)
                    self.most.append(0)
                node = self.next[node][c]
            self.most[node] = max(self.most[node], allowed)
            self.ends[node] = k
        self.forget()

    def forget(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.start = self._state({0: 0})

    def _state(self, at: dict[int, int]) -> int:
        """The number of a set of trie nodes with their edits, closed under words that skip letters of a term."""
        todo = list(at)
        while todo:
            node = todo.pop()
            for child in self.next[node].values():
                e = at[node] + 1
                if e <= self.most[child] and e < at.get(child, 99):
                    at[child] = e
                    todo.append(child)
        key = frozenset(at.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            hits = [(e, self.ends[n]) for n, e in key if self.ends[n] >= 0 and e <= edits_for(self.terms[self.ends[n]])]
            self.accepts.append(min(hits) if hits else None)
        return self.ids[key]

    def _move(self, state: int, c: str) -> int:
        at: dict[int, int] = {}
        for node, e in self.sets[state]:
            if e + 1 <= self.most[node]:  # a letter too many
                at[node] = min(at.get(node, 99), e + 1)
            for letter, child in self.next[node].items():
                cost = e + (letter != c)
                if cost <= self.most[child]:
                    at[child] = min(at.get(child, 99), cost)
        out = self._state(at) if at else -1
        self.moves[state][c] = out
        return out

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the nearest term that the word may be a spelling of."""
        if len(self.sets) > STATES:
            self.forget()
        s = self.start
        for c in word:
            s = self.moves[s][c] if c in self.moves[s] else self._move(s, c)
            if s < 0:
                return None
        return self.accepts[s]


FEATURES = ("abuse", "quoted", "terms", "per_word")


class Reader:
    def __init__(self, terms: list[str], weights: list[float], clean: list[str], strict: list[str]) -> None:
        self.automaton, self.weights, self.seen = Automaton(terms), weights, {}
        self.clean, self.strict = frozenset(clean), frozenset(strict)

    def look(self, word: str) -> tuple[int, int] | None:
        if len(self.seen) > REMEMBERED:
            self.seen = {}
        hit = self.automaton.match(word)
        if hit is not None and hit[0] and (word in self.clean or self.automaton.terms[hit[1]] in self.strict):
            hit = None
        self.seen[word] = hit
        return hit

    def features(self, text: str) -> list[float]:
        text = text.lower()
        words, seen, look = _WORD.findall(text), self.seen, self.look
        hits = {w: h for w in set(words) if (h := seen[w] if w in seen else look(w)) is not None}
        if not hits:
            return [0.0] * len(FEATURES)
        sums, terms, n = [0.0] * 2, set(), len(words)
        spans = [m.span() for m in _WORD.finditer(text)]
        for i, w in enumerate(words):
            if w in hits:
                edits, term = hits[w]
                terms.add(term)
                lo, hi = max(0, i - CONTEXT), min(n, i + CONTEXT + 1)
                near = words[lo:hi]
                marks_before = sum(c in _QUOTES for c in text[spans[lo][0] : spans[i][0]])
                marks_after = sum(c in _QUOTES for c in text[spans[i][1] : spans[hi - 1][1]])
                quoted = (marks_before % 2 and marks_after > 0) or any(x in REPORTING for x in near)
                addressed = any(x in ADDRESS for x in near)
                share = 0.8 if quoted and not addressed else 0.4 if quoted else 0.0
                weight = self.weights[term] * (MISSPELLED if edits else 1)
                sums[0] += weight * (1 - share)
                sums[1] += weight * share
        return [*np.log1p(sums).tolist(), float(len(terms)), float(np.log1p(100 * sum(sums) / n))]


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _read(shared):
    def run(batches) -> Iterator[pa.RecordBatch]:
        reader = Reader(*shared.value)
        for whole in batches:
            for b in pieces(whole):
                x = np.array([reader.features(t) for t in b.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(x[:, k]) for k in range(len(FEATURES))]], [*b.schema.names[:-1], *FEATURES])

    return run


def measure(docs: DataFrame, lexicon: tuple, columns: list[str]) -> DataFrame:
    """docs (columns, then text) with the features instead of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    d = docs.select(*columns, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kinds = dict(docs.dtypes)
    return d.mapInArrow(_read(shared), ", ".join([f"`{c}` {kinds[c]}" for c in columns] + [f"{f} double" for f in FEATURES]))


def _misspellings(shared):
    def run(batches):
        automaton = Automaton(shared.value)
        for b in batches:
            hit = [automaton.match(w) for w in b.column("w").to_pylist()]
            term = pa.array([automaton.terms[h[1]] if h and h[0] else None for h in hit], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, term], ["w", "p", "n", "term"]).filter(term.is_valid())

    return run


def learn(docs: DataFrame, labels: DataFrame, rows: int = LEARN_FROM) -> tuple[tuple, np.ndarray]:
    """(terms, their log odds, clean words near them, terms not to be sought misspelled) and the regression's weights, from at most `rows` labelled documents."""
    small_batches(docs.sparkSession)
    y = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    d = docs.join(F.broadcast(y), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    d = materialize(d, "labelled")
    try:
        total = {r.toxic: r.n for r in d.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        pos, neg = total.get(1, 0), total.get(0, 0)
        if not pos or not neg:
            return ([], [], [], []), np.append(np.full(1, -5.0), np.zeros(len(FEATURES)))
        w = d.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("w"))
        w = w.groupBy("w").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n"))
        odds = F.log((F.col("p") + 0.5) / (pos + 1)) - F.log((F.col("n") + 0.5) / (neg + 1))
        top = w.where(F.length("w") >= 3).withColumn("o", odds).where((F.col("p") >= max(LEAST_TOXIC, pos // 100)) & (F.col("o") >= LEAST_ODDS)).orderBy(F.desc("o"), "w").limit(LEXICON).collect()
        terms = [r.w for r in top]
        shared = docs.sparkSession.sparkContext.broadcast(terms)
        near = w.where(odds < LEAST_ODDS).mapInArrow(_misspellings(shared), "w string, p long, n long, term string").collect()
        clean, noise = [r.w for r in near if np.log((r.p + 1) / (r.n + 1)) < CLEAN_ODDS], dict.fromkeys(terms, 0)
        for r in near:  # words that were seen once tell how many there are that weren't
            noise[r.term] += r.n == 1 and not r.p
        lexicon = (terms, [float(r.o) for r in top], sorted(clean), sorted(t for t, n in noise.items() if n - np.sqrt(n) > NOISE * neg))
        x = measure(d, lexicon, ["toxic", "doc_id"]).orderBy("doc_id").toPandas()
    finally:
        discard(d)
    a = np.column_stack([np.ones(len(x)), x[list(FEATURES)].to_numpy()])
    t, beta, ridge = x["toxic"].to_numpy(float), np.zeros(a.shape[1]), 0.5 * np.eye(a.shape[1])
    ridge[0, 0] = 1e-3
    for _ in range(30):  # Newton's method, with a ridge
        q = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        beta = beta + np.linalg.solve(a.T @ (a * (q * (1 - q))[:, None]) + ridge, a.T @ (t - q) - ridge @ beta)
    return lexicon, beta


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted and the features."""
    lexicon, beta = learn(docs.select("doc_id", "text"), labels)
    d = measure(docs.select("doc_id", "text"), lexicon, ["doc_id"])
    z = F.lit(float(beta[0]))
    for f, b in zip(FEATURES, beta[1:], strict=True):
        z = z + F.col(f) * float(b)
    d = d.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z)))))
    return d.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *FEATURES)


def op8_toxicity(spark, sf_dir) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLES = {}
