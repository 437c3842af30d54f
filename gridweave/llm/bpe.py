"""Byte pair encoding of many short words at once, by contiguous rank arrays.

A word is a row of parts (symbol ids) and, beside it, a row of ranks: that of merging each part with the
next one. A step finds the least rank of each row (the leftmost of equal ones), merges there, deletes the
boundary, and looks up the two ranks beside it. Rows without a mergeable pair leave. Words of one length
share a matrix, so a step is a few numpy calls for thousands of words. The vocabulary comes from a
tokenizer file whose path is a parameter; nothing is trained here.

Scanning a row for its least rank takes time in proportion to its length, and so do the merges; words of
more than LONG bytes (runs of one character, text without spaces) are merged with a heap instead.
"""

from __future__ import annotations

import functools
import heapq
import json

import numpy as np

NEVER = np.int32(2**31 - 1)
ROWS = 1 << 15
LONG = 256


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones themselves, others from 256 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in set(kept) else chr(next(others)) for b in range(256)]


class Merges:
    """Ranks and results of merges, looked up for arrays of pairs in a table with open addressing."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        model = content["model"]
        vocab = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in content["added_tokens"]}
        suffix = model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.last = np.array([vocab[s + suffix] for s in symbols], np.int32)
        self.tokens = {i: t for t, i in (vocab | self.specials).items()}
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.uint64)
        right = np.array([vocab[b] for _, b in pairs], np.uint64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        # The first of two equal pairs would lose to the later one in a dictionary; so it does here.
        keys, at = np.unique(((left << np.uint64(20)) | right)[::-1], return_index=True)
        ranks = (len(pairs) - 1 - at).astype(np.int32)
        self.bits = 20
        size = 1 << self.bits
        self.keys = np.full(size + 64, np.uint64(2**64 - 1))
        self.ranks = np.full(size + 64, NEVER)
        self.merged = np.zeros(len(pairs) + 1, np.int32)
        self.merged[: len(pairs)] = merged
        for key, rank, slot in zip(keys, ranks, self._slot(keys), strict=True):
            while self.keys[slot] != 2**64 - 1:
                slot += 1
            self.keys[slot], self.ranks[slot] = key, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NEVER for those that do not merge."""
        keys = (left.astype(np.uint64) << np.uint64(20)) | right.astype(np.uint64)
        shape, keys = keys.shape, keys.ravel()
        slots = self._slot(keys)
        out = self.ranks[slots]
        seen = self.keys[slots]
        open_ = np.flatnonzero((seen != keys) & (seen != 2**64 - 1))
        out[(seen != keys)] = NEVER
        while len(open_):
            slots[open_] += 1
            seen = self.keys[slots[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.ranks[slots[open_[hit]]]
            open_ = open_[~hit & (seen != 2**64 - 1)]
        return out.reshape(shape)

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """Symbol ids of each word after all merges."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        edges = np.flatnonzero(np.diff(lengths[order], prepend=-1))
        for lo, hi in zip(edges, [*edges[1:], len(words)], strict=True):
            n = int(lengths[order[lo]])
            if n > LONG:
                for i in order[int(lo) : int(hi)]:
                    out[i] = self._merge_long(words[i])
                continue
            step = max(1, ROWS * 8 // max(n, 1))
            for at in range(int(lo), int(hi), step) if n else ():
                rows = order[at : min(at + step, int(hi))]
                raw = np.frombuffer(b"".join(words[i] for i in rows), np.uint8).reshape(len(rows), n)
                parts = self.inner[raw]
                parts[:, -1] = self.last[raw[:, -1]]
                for i, ids in zip(rows, self._merge(parts), strict=True):
                    out[i] = ids
        return out

    def _merge_long(self, word: bytes) -> np.ndarray:
        """One long word: the least (rank, place) comes from a heap, parts are linked to their neighbours."""
        raw = np.frombuffer(word, np.uint8)
        first = self.inner[raw]
        first[-1] = self.last[raw[-1]]
        parts, n = first.tolist(), len(first)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(int(r), i, parts[i], parts[i + 1]) for i, r in enumerate(self.rank(first[:-1], first[1:])) if r != NEVER]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i] if parts[i] == left else n
            if j >= n or parts[j] != right:
                continue  # one of the two has been merged since
            parts[i], parts[j] = int(self.merged[rank]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n:
                    r = self.rank_of(parts[a], parts[b])
                    if r is not None:
                        heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return np.array([p for p in parts if p >= 0], np.int32)

    def rank_of(self, left: int, right: int) -> int | None:
        key = (left << 20) | right
        slot = ((key * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> (64 - self.bits)
        while (seen := int(self.keys[slot])) != 2**64 - 1:
            if seen == key:
                return int(self.ranks[slot])
            slot += 1
        return None

    def _merge(self, parts: np.ndarray) -> list[np.ndarray]:
        done: list[np.ndarray] = [np.zeros(0, np.int32)] * len(parts)
        live = np.arange(len(parts))
        ranks = self.rank(parts[:, :-1], parts[:, 1:])
        while True:
            width = parts.shape[1]
            if width == 1:
                for i, row in zip(live, parts, strict=True):
                    done[i] = row
                return done
            at = ranks.argmin(axis=1)
            least = np.take_along_axis(ranks, at[:, None], 1)[:, 0]
            ended = least == NEVER
            if ended.any():
                for i, row in zip(live[ended], parts[ended], strict=True):
                    done[i] = row
                if ended.all():
                    return done
                going = ~ended
                live, parts, ranks, at, least = live[going], parts[going], ranks[going], at[going], least[going]
            each = np.arange(len(live))
            parts[each, at] = self.merged[least]
            columns = np.arange(width - 1)
            parts = np.take_along_axis(parts, columns + (columns > at[:, None]), 1)  # the part after the merged one goes
            if width == 2:
                ranks = np.zeros((len(live), 0), np.int32)
                continue
            ranks = np.take_along_axis(ranks, columns[:-1] + (columns[:-1] >= at[:, None]), 1)  # and so does its boundary
            has_left, has_right = at > 0, at < width - 2
            ranks[each[has_left], at[has_left] - 1] = self.rank(parts[each[has_left], at[has_left] - 1], parts[each[has_left], at[has_left]])
            ranks[each[has_right], at[has_right]] = self.rank(parts[each[has_right], at[has_right]], parts[each[has_right], at[has_right] + 1])


@functools.cache
def load(path: str) -> Merges:
    """The merges of a tokenizer file, once per process."""
    return Merges(path)
