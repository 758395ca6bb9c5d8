"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 8).

Texts are cut by the vocabulary's pattern; the distinct pieces are encoded together. Pieces of like length form padded matrices in
which every row merges its leftmost pair of minimum rank each round: pairs are looked up in a hash table, rows are compacted.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from srcatlas.plans.runtime import spread

#: The pattern that cuts texts before the merges, fixed by the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Widths of the padded matrices; longer pieces are merged one by one with a heap, for a row of w bytes costs w rounds of w columns.
WIDTHS = (2, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256)
#: Pieces kept encoded per worker, and rows of a matrix at a time.
CACHE, ROWS = 300_000, 65_536
NONE = np.int32(2**31 - 1)


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class BytePairs:
    """Ranks of a vocabulary file and the hash table of all pairs of tokens that merge."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.of_byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int32)
        left, right, merged = [], [], []
        for token, rank in self.rank.items():
            for i in range(1, len(token)):
                a, b = self.rank.get(token[:i]), self.rank.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        self._build(np.array(left, np.int64), np.array(right, np.int64), np.array(merged, np.int32))
        self.cache: dict[str, list[int]] = {}

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _build(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        """Open addressing with linear probing; a batch of keys is placed per probe distance."""
        self.bits = max(4, int(len(left) * 4).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        key, self.probes = (left << 20) | right, 0
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            self.probes += 1
            free = todo[self.keys[slot[todo]] == -1]
            self.keys[slot[free]] = key[free]  # the last writer of a slot wins
            won = free[self.keys[slot[free]] == key[free]]
            self.values[slot[won]] = merged[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merged token for each pair, NONE where the two do not merge (a or b below 0: never)."""
        key = (a.astype(np.int64) << 20) | b.astype(np.int64)
        key[(a < 0) | (b < 0)] = -2
        slot = self._slot(key)
        found = np.full(key.shape, NONE, np.int32)
        open_ = np.flatnonzero(key.ravel() != -2)
        flat_key, flat_slot, flat_found = key.ravel(), slot.ravel(), found.ravel()
        for _ in range(self.probes):
            held = self.keys[flat_slot[open_]]
            hit = held == flat_key[open_]
            flat_found[open_[hit]] = self.values[flat_slot[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
            if not len(open_):
                break
            flat_slot[open_] = (flat_slot[open_] + 1) & ((1 << self.bits) - 1)
        return flat_found.reshape(key.shape)

    def _matrix(self, ids: np.ndarray) -> list[np.ndarray]:
        """ids: rows padded with -1. Each round merges every row's leftmost minimum-rank pair and closes the gap."""
        done: list[np.ndarray | None] = [None] * len(ids)
        rows, columns = np.arange(len(ids)), np.arange(ids.shape[1])
        ranks = self.lookup(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            ends = best == NONE
            if ends.any():
                for r in np.flatnonzero(ends):
                    done[rows[r]] = ids[r][ids[r] >= 0]
                keep = ~ends
                rows, ids, ranks, at, best = rows[keep], ids[keep], ranks[keep], at[keep], best[keep]
                if not len(rows):
                    break
            every = np.arange(len(rows))
            ids[every, at] = best
            shift = columns[None, :-1] + (columns[None, :-1] > at[:, None])
            ids[:, :-1] = np.take_along_axis(ids, shift, 1)
            ids[:, -1] = -1
            if ranks.shape[1] > 1:
                ranks[:, :-1] = np.take_along_axis(ranks, shift[:, :-1], 1)
            ranks[:, -1] = NONE
            for side in (at - 1, at):  # only the pairs beside the new token change
                ok = (side >= 0) & (side < ranks.shape[1])
                ranks[every[ok], side[ok]] = self.lookup(ids[every[ok], side[ok]], ids[every[ok], side[ok] + 1])
        return done

    def _long(self, data: bytes) -> list[int]:
        """One long piece by a heap of pairs over a linked list; the same order of merges."""
        ids = self.of_byte[np.frombuffer(data, np.uint8)]
        following, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        first = self.lookup(ids[:-1], ids[1:])
        heap = [(int(r), int(i)) for i, r in zip(np.flatnonzero(first != NONE), first[first != NONE])]
        heapq.heapify(heap)
        ids, alive = ids.tolist(), [True] * len(ids)
        pair: dict[tuple[int, int], int] = {}

        def rank(a: int, b: int) -> int:
            if (a, b) not in pair:
                pair[a, b] = int(self.lookup(np.array([a]), np.array([b]))[0])
            return pair[a, b]

        while heap:
            r, i = heapq.heappop(heap)
            j = following[i] if alive[i] else len(ids)
            if j >= len(ids) or rank(ids[i], ids[j]) != r:
                continue
            ids[i], alive[j], following[i] = r, False, following[j]
            if following[i] < len(ids):
                before[following[i]] = i
                if (x := rank(r, ids[following[i]])) != NONE:
                    heapq.heappush(heap, (x, i))
            if before[i] >= 0 and (x := rank(ids[before[i]], r)) != NONE:
                heapq.heappush(heap, (x, before[i]))
        return [x for x, ok in zip(ids, alive) if ok]

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        result: list[list[int] | None] = [None] * len(pieces)
        data = [p.encode("utf-8", "surrogatepass") for p in pieces]
        length = np.array([len(x) for x in data], np.int64)
        low = 0
        for width in WIDTHS:
            bucket = np.flatnonzero((length > low) & (length <= width))
            low = width
            for s in range(0, len(bucket), ROWS):
                part = bucket[s : s + ROWS]
                raw = np.frombuffer(b"".join(data[i].ljust(width, b"\0") for i in part), np.uint8).reshape(len(part), width)
                ids = np.where(np.arange(width)[None, :] < length[part][:, None], self.of_byte[raw], -1).astype(np.int32)
                for i, row in zip(part, self._matrix(ids)):
                    result[i] = row.tolist()
        for i in np.flatnonzero(length > low):
            result[i] = self._long(data[i])
        return [[] if r is None else r for r in result]

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        cut = [PIECES(t) if t else [] for t in texts]
        if len(self.cache) > CACHE:
            self.cache.clear()
        new = list({p for pieces in cut for p in pieces if p not in self.cache})
        kept = {p: ids for p, ids in zip(new, self.encode_pieces(new))}
        self.cache.update((p, ids) for p, ids in kept.items() if len(p) <= 64)
        cache = self.cache
        return [[i for p in pieces for i in (cache[p] if p in cache else kept[p])] for pieces in cut]

    def decode(self, ids: list[int]) -> bytes:
        if not hasattr(self, "_bytes"):
            self._bytes = {r: t for t, r in self.rank.items()}
        return b"".join(self._bytes[i] for i in ids)


PIECES = regex.compile(PATTERN).findall
_LOADED: dict[str, BytePairs] = {}


def pairs_of(path: str) -> BytePairs:
    """The vocabulary of a file, read once per worker."""
    if path not in _LOADED:
        _LOADED[path] = BytePairs(path)
    return _LOADED[path]


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    pairs = pairs_of(path)
    for batch in batches:
        for s in range(0, batch.num_rows, 256):
            part = batch.slice(s, 256)
            rows = pairs.encode_batch(part.column("text").to_pylist())
            kept = [n for n in part.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), pa.array(rows, pa.list_(pa.int32()))], names=[*kept, "ids"])


def token_ids(documents: DataFrame, path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ids): every document's token ids, without special tokens, beside the columns to `keep`.

    Strings that look like special tokens are ordinary text. Null and empty texts give an empty list. Every row gives a row,
    repeated or null doc_ids included; other columns are ignored.
    """
    rows = documents.select("doc_id", *keep, "text")
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "text")
    return spread(rows).mapInArrow(partial(_encode, path=path or vocabulary_path()), f"{schema}, ids array<int>")
