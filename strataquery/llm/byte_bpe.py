"""Byte-level BPE encoding and decoding over length-bucketed padded numpy matrices.

A text is split by the tokenizer's pattern; each match is encoded by itself. Matches not seen before are put into
matrices of like length, one row each, padded with -1. Each round looks up the rank of every adjacent pair in a hash
table of pairs, merges the leftmost pair of least rank in every row, closes the gap, and drops rows without a pair that
merges. A match that is itself a token is that token. Matches over ``LONG`` bytes, for which one merge a round would
take quadratic time, use a heap of pairs with the same order of merges.

Defined results: null text is empty (no ids); special tokens are ordinary text; the ids of a repeated text repeat;
an empty table gives an empty result; other columns are ignored. Memory: one Arrow batch and a cache of at most
``CACHE`` matches, cleared when full. No shuffle; a lost task is simply run again.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquery.llm.common import bound_batches

NO_RANK = np.int32(2**31 - 1)
CACHE = 100_000
LONG = 200


class PairTable:
    """Open-addressed hash table from a pair of ids to the id of what they join to."""

    def __init__(self, left: np.ndarray, right: np.ndarray, joined: np.ndarray):
        self.bits = max(10, int(len(left)).bit_length() + 2)
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, NO_RANK, dtype=np.int32)
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at, todo, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(todo):
            self.probes += 1
            free = self.keys[at[todo]] == -1
            # of pairs that want the same free slot the first gets it
            _, first = np.unique(at[todo][free], return_index=True)
            won = todo[free][first]
            self.keys[at[won]], self.values[at[won]] = keys[won], joined[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NO_RANK where there is none; a negative id has no pair."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where((found == keys) & (left >= 0) & (right >= 0), self.values[at], NO_RANK)
        open_ = np.flatnonzero((found != keys) & (found != -1) & (left >= 0) & (right >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


class Bpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.vocab = {i: token for token, i in self.ranks.items()}
        self.texts = {i: str(i) for i in self.vocab}
        self.split = regex.compile(pattern).findall
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = [(self.ranks[t[:k]], self.ranks[t[k:]], i) for t, i in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        self.pairs = PairTable(*(np.array(x, dtype=np.int32) for x in zip(*pairs)))
        self.joins = {(a, b): i for a, b, i in pairs}
        self.cache: dict[str, tuple[int, ...]] = {}

    def _long(self, word: bytes) -> tuple[int, ...]:
        ids = self.byte[np.frombuffer(word, dtype=np.uint8)].tolist()
        after, before, n = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), len(ids)
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.joins.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] is not None else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue  # one of the two has been merged since
            ids[i], ids[j] = rank, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := self.joins.get((rank, ids[after[i]]))) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[after[i]]))
            if (p := before[i]) >= 0 and (r := self.joins.get((ids[p], rank))) is not None:
                heapq.heappush(heap, (r, p, ids[p], rank))
        return tuple(x for x in ids if x is not None)

    def _matrix(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Words of 2 bytes or more and like length."""
        width = max(map(len, words))
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ids = np.full((len(words), width), -1, dtype=np.int32)
        ids[np.arange(width) < lengths[:, None]] = self.byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        ranks = self.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(words), width - 1)
        out: list = [None] * len(words)
        rows = np.arange(len(words))
        while True:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            over = best == NO_RANK
            if over.any():
                for row, line, n in zip(rows[over].tolist(), ids[over].tolist(), lengths[over].tolist()):
                    out[row] = tuple(line[:n])
                go = ~over
                rows, ids, ranks, at, best, lengths = rows[go], ids[go], ranks[go], at[go], best[go], lengths[go]
                if not len(rows):
                    return out
                width = int(lengths.max())
                ids, ranks = ids[:, :width], ranks[:, : max(1, width - 1)]
            k = np.arange(len(rows))
            # close the gap: what stands after the pair moves one place to the left
            move = np.arange(ids.shape[1] - 1) > at[:, None]
            ids[:, :-1] = np.where(move, ids[:, 1:], ids[:, :-1])
            ids[k, at] = best
            ids[k, lengths - 1] = -1
            lengths = lengths - 1
            if ranks.shape[1] > 1:
                ranks[:, :-1] = np.where(move[:, : ranks.shape[1] - 1], ranks[:, 1:], ranks[:, :-1])
            ranks[k, np.maximum(lengths - 1, 0)] = NO_RANK
            left = np.maximum(at - 1, 0)
            ranks[k, left] = np.where(at > 0, self.pairs.get(ids[k, left], ids[k, at]), ranks[k, left])
            right = np.minimum(at + 1, ids.shape[1] - 1)
            has = at + 1 < lengths
            ranks[k[has], at[has]] = self.pairs.get(ids[k[has], at[has]], ids[k[has], right[has]])
            ranks[k[~has], np.minimum(at[~has], ranks.shape[1] - 1)] = NO_RANK

    def learn(self, words) -> None:
        """Puts words into the cache."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            raw = word.encode()
            if (whole := self.ranks.get(raw)) is not None:
                self.cache[word] = (whole,)
            elif len(raw) > LONG:
                self.cache[word] = self._long(raw)
            else:
                buckets.setdefault((len(raw) + 3) // 4, []).append((word, raw))
        for same in buckets.values():
            for start in range(0, len(same), 4096):
                part = same[start : start + 4096]
                self.cache.update(zip((w for w, _ in part), self._matrix([r for _, r in part])))

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text. Texts are taken in runs of about a million characters, each run's new matches at once."""
        run: list[list[str]] = []
        chars = 0
        for text in texts:
            run.append(self.split(text))
            chars += len(text)
            if chars > 1_000_000:
                yield from self._run(run)
                run, chars = [], 0
        yield from self._run(run)

    def _run(self, run: list[list[str]]) -> Iterator[list[int]]:
        words = set().union(*run) if run else set()
        if len(self.cache) > CACHE:
            self.cache.clear()
        self.learn(words.difference(self.cache))
        get = self.cache.__getitem__
        for parts in run:
            yield list(chain.from_iterable(map(get, parts)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))

    def joined(self, ids: list[int]) -> str:
        return ",".join(map(self.texts.__getitem__, ids))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> Bpe:
    return Bpe(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every whole text."""

    bound_batches(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = load(path, pattern)
        for part in texts:
            yield pd.Series(list(bpe.encode(part.fillna("").tolist())), dtype=object)

    return docs.select(F.col(id_col).alias("doc_id"), ids(F.col(text_col)).alias("ids"))


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text_bytes of every row of ids; ids that cut a character still give its bytes."""

    bound_batches(encoded.sparkSession)

    @F.pandas_udf("binary")
    def back(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = load(path, pattern)
        for part in ids:
            yield pd.Series([bpe.decode([] if x is None else list(x)) for x in part], dtype=object)

    return encoded.select("doc_id", back("ids").alias("text_bytes"))


def digest_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes, then decodes the ids, in one pass that returns only digests."""

    bound_batches(docs.sparkSession)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = load(path, pattern)
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        for part in texts:
            rows = [(len(ids), sha(bpe.joined(ids).encode()), sha(bpe.decode(ids))) for ids in bpe.encode(part.fillna("").tolist())]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("d")).select("doc_id", "d.*")
