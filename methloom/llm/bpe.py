"""Byte-pair encoding of whole corpora by a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves every pre-token
that is itself a token. Tier two: the rest is merged pair by pair, lowest rank
first, with a heap over a linked list of byte strings.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from methloom.core import ship

#: Where the vocabularies lie; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the public pattern that cuts text into pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens remembered per worker; a bound on memory, without effect on results.
MEMO = 200_000
#: Texts tokenized at a time within an Arrow batch.
SLICE_CHARS = 2_000_000

_GOLDEN = 0x9E3779B97F4A7C15


def _slot(h: np.ndarray, d, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = h + np.uint64(_GOLDEN) * (np.asarray(d).astype(np.uint64) + np.uint64(1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) % np.uint64(n)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: n keys to the places 0..n-1, by displacement per bucket."""

    TRIES = 16

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 4)
        h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, n)
        if len(np.unique(h)) < n:
            raise ValueError("two keys share a 64-bit hash, or a key is repeated")
        b = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        counts = np.bincount(b, minlength=self.buckets)
        ends = np.cumsum(counts)
        free = np.ones(n, bool)
        self.shift = np.zeros(self.buckets, np.int64)
        self.place = np.empty(n, np.int64)  # place -> key number
        for k in np.argsort(-counts, kind="stable"):
            c = counts[k]
            if c < 2:
                break
            members = order[ends[k] - c : ends[k]]
            first, many = 0, self.TRIES
            while True:
                tries = np.arange(first, first + many)
                slots = _slot(h[members][None, :], tries[:, None], n)
                good = free[slots].all(1)
                if c > 1:
                    s = np.sort(slots, 1)
                    good &= (s[:, 1:] != s[:, :-1]).all(1)
                if good.any():
                    t = int(good.argmax())
                    self.shift[k] = first + t
                    free[slots[t]] = False
                    self.place[slots[t]] = members
                    break
                first, many = first + many, min(4 * many, 4096)
        # Buckets of one key name a free place outright.
        single = np.flatnonzero(counts == 1)
        spare = np.flatnonzero(free)
        self.shift[single] = -1 - spare
        self.place[spare] = order[ends[single] - 1]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Key numbers; of a string that is no key, any number (compare the key itself)."""
        d = self.shift[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        return self.place[np.where(d < 0, -1 - d, _slot(hashes, np.maximum(d, 0), self.n))]


class Encoder:
    """The encoder of one rank file (base64 token, rank per line)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.keys = list(ranks)
        self.ids = np.fromiter(ranks.values(), np.int64, len(ranks))
        self.hash = PerfectHash(self.keys)
        self.split = regex.compile(pattern).findall
        self.memo: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Merge the bytes of a pre-token: the pair of lowest rank first, of equals the leftmost."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # a live node i spans piece[i:end[i]]
        before = list(range(-1, n - 1))
        heap = []

        def push(i: int) -> None:
            j = end[i]
            if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            # Stale if i was absorbed, or either part has grown since.
            if j <= i or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, -1
            if stop < n:
                before[stop] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def learn(self, pieces: Iterable[str]) -> None:
        """Resolve the pre-tokens that aren't remembered yet."""
        memo = self.memo
        distinct = dict.fromkeys(pieces)  # once: pieces may be an iterator
        new = [p for p in distinct if p not in memo]
        if not new:
            return
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = list(distinct)
        raw = [p.encode() for p in new]
        at = self.hash.find(np.fromiter((xxhash.xxh3_64_intdigest(r) for r in raw), np.uint64, len(raw)))
        keys, ids = self.keys, self.ids
        for p, r, k in zip(new, raw, at.tolist()):
            memo[p] = (int(ids[k]),) if keys[k] == r else self.merge(r)

    def pieces(self, text: str) -> list[tuple[str, tuple[int, ...]]]:
        parts = self.split(text)
        self.learn(parts)
        return [(p, self.memo[p]) for p in parts]

    def encode(self, text: str) -> list[int]:
        return [t for _, ids in self.pieces(text) for t in ids]

    def counts(self, text: str) -> tuple[list[str], list[int]]:
        """The pre-tokens and how many ids each has."""
        parts = self.split(text)
        self.learn(parts)
        return parts, list(map(len, map(self.memo.__getitem__, parts)))

    def count(self, text: str) -> int:
        return sum(self.counts(text)[1])

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets."""
        split = [self.split(t) if t else [] for t in texts]
        self.learn(p for parts in split for p in parts)
        memo = self.memo
        flat: list[int] = []
        offsets = np.zeros(len(texts) + 1, np.int64)
        for i, parts in enumerate(split):
            for p in parts:
                flat += memo[p]
            offsets[i + 1] = len(flat)
        return np.array(flat, np.int32), offsets


@lru_cache(maxsize=4)
def encoder(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Encoder:
    """The encoder of a ``<name>.tiktoken`` file; built once per worker."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    return Encoder(ranks)


def slices(texts: list[str | None], chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of about ``chars`` characters, at least one text each."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and size + n > chars:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def encode_corpus(df: DataFrame, id_col: str, text_col: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``id_col`` and ``ids`` (array<int>) of every row, without special tokens.

    Empty and null texts have the defined ids ``[]``. Strings of special tokens
    are ordinary text. Whole texts are encoded, however long; a text is cut at
    pre-tokens only, as the tokenizer's own pattern does. Needs no shuffle. Rows
    with a null or repeated id are encoded like any other; other columns are
    ignored. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, folder)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                flat, offsets = enc.encode_batch(texts[a:b])
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids], names=["id", "ids"])

    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(df[f"`{id_col}`"].alias("id"), df[f"`{text_col}`"].cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", id_col)
