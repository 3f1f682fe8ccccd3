"""Weighted acyclic automata that count word sequences.

A ``Counter`` accepts sequences of labels, each with a weight: how often it was seen. It is kept as its paths in
order, so its states are the prefixes that neighbouring paths share, and the weight of a state is the sum over the
paths through it: the number of sequences that begin so. Shards are built from sorted sequences, cut at prefixes into
ranges, and the parts of one range from many shards are united by summing the weights of equal paths.
"""

from __future__ import annotations

import struct
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import zstandard

HEAD = struct.Struct("<IIQ")
JOINT = b"\xff"  # between words that are written together: no UTF-8 text has it


def _keys(paths: np.ndarray, size: int) -> list[np.ndarray]:
    """Numbers that order paths as their labels do, the most significant first."""
    bits = max(1, int(size).bit_length())
    width, per_key = paths.shape[1], 64 // bits
    keys = []
    for at in range(0, width, per_key):
        key = np.zeros(len(paths), np.uint64)
        for place in range(at, min(at + per_key, width)):
            key = (key << np.uint64(bits)) | paths[:, place].astype(np.uint64)
        keys.append(key)
    return keys


class Counter:
    """Paths over ``words``: label ``i + 1`` is ``words[i]``, and 0 fills a path that has ended.

    ``words`` are distinct and sorted by their bytes, ``paths`` distinct and in the order of their labels.
    """

    def __init__(self, words: Sequence[bytes], paths: np.ndarray, weights: np.ndarray):
        self.words, self.paths, self.weights = words, paths, weights
        self._shared: np.ndarray | None = None

    @classmethod
    def of(cls, words: Sequence[bytes], paths: np.ndarray, weights: np.ndarray | None = None) -> Counter:
        """From paths in any order, equal ones added up."""
        weights = np.ones(len(paths), np.int64) if weights is None else weights
        if not len(paths):
            return cls(words, paths, weights)
        keys = _keys(paths, len(words))
        order = np.lexsort(keys[::-1])
        new = np.ones(len(order), bool)
        new[1:] = False
        for key in keys:
            ordered = key[order]
            new[1:] |= ordered[1:] != ordered[:-1]
        starts = np.flatnonzero(new)
        return cls(words, paths[order[starts]], np.add.reduceat(weights[order], starts))

    def shared(self) -> np.ndarray:
        """How many leading labels each path shares with the one before."""
        if self._shared is None:
            same = np.zeros(self.paths.shape, bool)
            same[1:] = self.paths[1:] == self.paths[:-1]
            self._shared = np.logical_and.accumulate(same, axis=1).sum(axis=1, dtype=np.uint8)
        return self._shared

    def place(self, bound: bytes) -> int:
        """The number of paths before ``bound``, the words of a path written together."""
        low, high = 0, len(self.paths)
        for i, word in enumerate(bound.split(JOINT)):
            label = bisect_left(self.words, word) + 1
            column = self.paths[:, i]
            low, high = bisect_left(column, label, low, high), bisect_right(column, label, low, high)
            # A word that is not here has its place between others: what has a label from it on is past the bound.
            if low == high or label > len(self.words) or self.words[label - 1] != word:
                break
        return low

    def split(self, bounds: Sequence[bytes]) -> Iterator[tuple[int, Counter]]:
        """The parts between neighbouring bounds, by the number of the range; empty ones are left out."""
        places = [0, *(self.place(bound) for bound in bounds), len(self.paths)]
        for i in range(len(places) - 1):
            if places[i] < places[i + 1]:
                part = slice(places[i], places[i + 1])
                yield i, Counter(self.words, self.paths[part], self.weights[part])

    def pack(self) -> bytes:
        """Only the words in use, and of each path only what it does not share with the one before."""
        in_use = np.zeros(len(self.words) + 1, bool)
        in_use[self.paths] = True
        in_use[0] = False
        used = np.flatnonzero(in_use)
        paths = np.where(in_use, np.cumsum(in_use), 0).astype("<u4")[self.paths]
        shared = self.shared()
        fresh = np.arange(paths.shape[1]) >= shared[:, None]
        words = JOINT.join([self.words[i - 1] for i in used.tolist()])
        wide = np.dtype("<u1" if not len(self.weights) or self.weights.max() < 256 else "<u8")
        weights = bytes([wide.itemsize]) + self.weights.astype(wide).tobytes()
        # By bytes of equal rank, which compress better.
        labels = np.ascontiguousarray(paths[fresh].view(np.uint8).reshape(-1, 4).T).tobytes()
        body = HEAD.pack(len(paths), paths.shape[1], len(words)) + words + shared.tobytes() + weights + labels
        return zstandard.ZstdCompressor(level=1).compress(body)

    @classmethod
    def unpack(cls, packed: bytes) -> Counter:
        body = zstandard.ZstdDecompressor().decompress(packed)
        count, width, length = HEAD.unpack_from(body)
        at = HEAD.size + length
        words = body[HEAD.size : at].split(JOINT) if length else []
        shared = np.frombuffer(body, np.uint8, count, at)
        at += count
        wide = np.dtype(f"<u{body[at]}")
        weights = np.frombuffer(body, wide, count, at + 1).astype(np.int64)
        raw = np.frombuffer(body, np.uint8, offset=at + 1 + count * wide.itemsize)
        labels = np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()
        fresh = np.arange(width) >= shared[:, None]
        # A shared label is that of the last path that brought one of its own in this place.
        brought = np.maximum.accumulate(np.where(fresh, np.arange(count)[:, None], 0), axis=0)
        own = np.zeros((count, width), np.uint32)
        own[fresh] = labels
        return cls(words, np.take_along_axis(own, brought, axis=0), weights)

    @classmethod
    def union(cls, parts: Iterable[Counter], most: int = 4_000_000) -> Counter:
        """All paths, weights of equal ones added; more than ``most`` paths are united step by step."""
        held: list[Counter] = []
        for part in parts:
            held.append(part)
            if len(held) > 1 and sum(len(some.paths) for some in held) > most:
                held = [cls._united(held)]
        return cls._united(held)

    @classmethod
    def _united(cls, parts: list[Counter]) -> Counter:
        words = sorted({word for part in parts for word in part.words})
        label = {word: i + 1 for i, word in enumerate(words)}
        paths = [np.array([0, *map(label.__getitem__, part.words)], np.uint32)[part.paths] for part in parts]
        return cls.of(words, np.concatenate(paths), np.concatenate([part.weights for part in parts]))

    def states(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the states after ``depth`` labels: where each one's first path is, and its weight."""
        if not len(self.paths):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        starts = np.flatnonzero(self.shared() < depth)
        sums = np.add.reduceat(self.weights, starts)
        real = self.paths[starts, depth - 1] > 0
        return starts[real], sums[real]
