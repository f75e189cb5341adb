"""Operator 9, byte-level BPE encoding and decoding in length-bucketed padded numpy matrices.

A text is split by the vocabulary's pattern; each distinct match is encoded once for many texts. Matches of like length
lie in one padded matrix of ids. In each round every row merges its leftmost pair of least rank, found in a hash table
of pairs, and rows without a pair leave. A match beyond LONGEST bytes is a matrix of one row; there a round merges its pair wherever it
occurs, as one place a round would cost the square of the length. Decoding gathers the ids' bytes.

Results on odd input: a null or empty text has no ids and decodes to an empty text; very long texts are encoded whole;
other columns aren't read; repeated rows each give a row; an empty table gives an empty table; null ids decode to nothing.
"""

from __future__ import annotations

import base64
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestead.llm.common import pieces, ragged, small_batches, table

LONGEST = 512
#: Encoded matches that a Python worker remembers; beyond it, it starts anew.
REMEMBERED = 100_000
_NONE = np.int32(2**31 - 1)


def read_ranks(text: bytes) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank in each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, text.splitlines()) if a}


class Coder:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {(ranks[t[:k]], ranks[t[k:]]): r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        keys = np.array([a << 32 | b for a, b in pairs], np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.keys, self.vals = np.full(1 << self.bits, 2**64 - 1, np.uint64), np.full(1 << self.bits, _NONE, np.int32)
        vals, self.probes = np.array(list(pairs.values()), np.int32), 0
        while len(keys):
            slot = (self._hash(keys) + np.uint64(self.probes)) & np.uint64((1 << self.bits) - 1)
            _, one = np.unique(slot, return_index=True)
            one = one[self.vals[slot[one]] == _NONE]
            self.keys[slot[one]], self.vals[slot[one]] = keys[one], vals[one]
            keys, vals = np.delete(keys, one), np.delete(vals, one)
            self.probes += 1
        self.size = max(ranks.values()) + 1
        tokens = [b""] * self.size
        for t, r in ranks.items():
            tokens[r] = t
        self.token_len = np.array(list(map(len, tokens)), np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.forget()

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids; _NONE where none merges. Negative ids are padding."""
        key = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64) & np.uint64(0xFFFFFFFF)
        out, slot = np.full(key.shape, _NONE, np.int32), self._hash(key)
        for _ in range(self.probes):
            hit = self.keys[slot] == key
            out[hit] = self.vals[slot[hit]]
            slot = (slot + np.uint64(1)) & np.uint64((1 << self.bits) - 1)
        out[(a < 0) | (b < 0)] = _NONE
        return out

    def merge_rows(self, rows: list[bytes]) -> list[np.ndarray]:
        """The ids of byte strings of like length."""
        width = max(map(len, rows))
        ids = np.full((len(rows), width + 1), -1, np.int32)
        size = np.array(list(map(len, rows)))
        flat = self.byte[np.frombuffer(b"".join(rows), np.uint8)]
        r, c = np.repeat(np.arange(len(rows)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        ids[r, c] = flat
        ranks = self.rank(ids[:, :-1], ids[:, 1:])
        at, out = np.arange(len(rows)), [None] * len(rows)
        while len(at):
            best = ranks.argmin(1)
            low = ranks[np.arange(len(at)), best]
            done = low == _NONE
            if done.any():  # compaction: finished rows leave, and so do columns that no row needs
                n = (ids[done] >= 0).sum(1)
                for k, row, m in zip(at[done], ids[done], n, strict=True):
                    out[k] = row[:m]
                go = ~done
                at, ids, ranks, best, low = at[go], ids[go], ranks[go], best[go], low[go]
                if not len(at):
                    break
                need = int((ids >= 0).sum(1).max()) + 1
                ids, ranks = ids[:, :need], ranks[:, : need - 1]
            i, col = np.arange(len(at)), np.arange(ids.shape[1])[None, :]
            src = np.minimum(col + (col > best[:, None]), ids.shape[1] - 1)
            ids[i, best] = low
            ids = np.take_along_axis(ids, src, 1)
            ids[:, -1] = -1
            col = col[:, :-1]
            ranks = np.take_along_axis(ranks, np.minimum(col + (col > best[:, None]), ranks.shape[1] - 1), 1)
            ranks[:, -1] = _NONE
            ranks[i, best] = self.rank(ids[i, best], ids[i, best + 1])
            left = i[best > 0]
            ranks[left, best[left] - 1] = self.rank(ids[left, best[left] - 1], ids[left, best[left]])
        return out

    def merge_row(self, text: bytes) -> np.ndarray:
        """The ids of one long byte string: a round merges the pair of least rank wherever it occurs, leftmost first.

        A merge that makes a pair of still lower rank ends its round, so the merges and their order are those of one pair a round.
        """
        ids = self.byte[np.frombuffer(text, np.uint8)]
        ranks = self.rank(ids[:-1], ids[1:])
        while len(ranks) and (low := ranks.min()) != _NONE:
            at = np.flatnonzero(ranks == low)
            first = np.flatnonzero(np.diff(at, prepend=-2) > 1)  # of places side by side, every other one merges
            at = at[(np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))) % 2 == 0]
            left = np.where(np.diff(at, prepend=-3) == 2, low, ids[np.maximum(at - 1, 0)])
            left[at == 0] = -1
            right = np.append(ids, [-1, -1])[at + 2]
            made = np.minimum(self.rank(left, np.full(len(at), low, np.int32)), self.rank(np.full(len(at), low, np.int32), right))
            at = at[: int(np.argmax(made < low)) + 1] if (made < low).any() else at
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids[at] = low
            ids, ranks = ids[keep], np.append(ranks, _NONE)[keep][:-1]
            new = at - np.arange(len(at))
            for x in (new[new > 0] - 1, new[new < len(ranks)]):
                ranks[x] = self.rank(ids[x], ids[x + 1])
        return ids

    def forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.flat, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def learn(self, new: list[str]) -> None:
        """Encode matches that aren't remembered yet, and remember them."""
        raw = [t.encode() for t in new]
        out: list = [None] * len(raw)
        buckets: dict[int, list[int]] = {}
        for k, t in enumerate(raw):
            if (r := self.ranks.get(t)) is not None:
                out[k] = np.array([r], np.int32)
            elif len(t) > LONGEST:
                out[k] = self.merge_row(t)
            else:
                buckets.setdefault(-(-len(t) // 4) if len(t) <= 32 else 8 + len(t).bit_length(), []).append(k)
        for ks in buckets.values():
            step = max(1, (1 << 20) // max(len(raw[k]) for k in ks))
            for a in range(0, len(ks), step):
                for k, ids in zip(ks[a : a + step], self.merge_rows([raw[k] for k in ks[a : a + step]]), strict=True):
                    out[k] = ids
        base = len(self.slot)
        self.slot.update(zip(new, range(base, base + len(new)), strict=True))
        self.flat = np.concatenate([self.flat, *out])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(list(map(len, out)))])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one behind another, and each text's first, then the end."""
        found = [self.find(t) if t else [] for t in texts]
        if len(self.slot) > REMEMBERED:
            self.forget()
        if new := [t for t in dict.fromkeys(x for f in found for x in f) if t not in self.slot]:
            self.learn(new)
        slots = np.fromiter((self.slot[x] for f in found for x in f), np.int64)
        size = self.at[slots + 1] - self.at[slots]
        ids = self.flat[_gather(self.at[slots], size)]
        ends = np.concatenate([[0], np.cumsum(size)])
        return ids, ends[np.cumsum([0, *map(len, found)])]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids' bytes one behind another, and where each id's bytes begin, then the end."""
        size = self.token_len[ids]
        return self.token_bytes[_gather(self.token_at[ids], size)], np.concatenate([[0], np.cumsum(size)])


def _gather(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices at[0], at[0] + 1, ... size[0] of them, then those from at[1], and so on."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - (ends - size), size)


_CODER: dict[int, Coder] = {}


def _coder(shared, pattern: str) -> Coder:
    """This worker's coder; it is built once, from the broadcast rank file."""
    key = hash((shared.value, pattern))
    if key not in _CODER:
        _CODER.clear()
        _CODER[key] = Coder(read_ranks(shared.value), pattern)
    return _CODER[key]


def _share(docs: DataFrame, path: str):
    small_batches(docs.sparkSession)
    data = Path(path).read_bytes()
    if len(data) > 64 << 20:
        raise ValueError(f"{path} is too large to broadcast as a vocabulary")
    return docs.sparkSession.sparkContext.broadcast(data)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: key and ids (array<int>), by the ranks in the driver's file `path`."""
    shared = _share(docs, path)

    def run(batches):
        coder = _coder(shared, pattern)
        for whole in batches:
            for b in pieces(whole):
                ids, at = coder.encode(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), ragged(ids, at, pa.int32())], ["key", "ids"])

    kind = dict(docs.dtypes)[key]
    d = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return d.mapInArrow(run, f"key {kind}, ids array<int>").select(F.col("key").alias(key), "ids")


def decode(coded: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """One row per row of coded: key, ids and decoded (binary)."""
    shared = _share(coded, path)

    def run(batches):
        coder = _coder(shared, pattern)
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                b = whole.slice(a, 256)
                ids = b.column("ids")
                data, at = coder.decode(ids.flatten().to_numpy())
                o = ids.offsets.to_numpy() - ids.offsets[0].as_py()
                out = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(at[o].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
                yield pa.RecordBatch.from_arrays([b.column("key"), ids, out], ["key", "ids", "decoded"])

    kind = dict(coded.dtypes)[key]
    d = coded.select(F.col(key).alias("key"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return d.mapInArrow(run, f"key {kind}, ids array<int>, decoded binary").select(F.col("key").alias(key), "ids", "decoded")


def round_trip(docs: DataFrame, name: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    import public_tokenizers as tokenizers

    path = tokenizers.path(name)
    d = decode(encode(docs, path, tokenizers.PATTERN), path, tokenizers.PATTERN)
    return d.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op9_byte_bpe(spark, sf_dir) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op9_byte_bpe": op9_byte_bpe}
ORACLES = {}
