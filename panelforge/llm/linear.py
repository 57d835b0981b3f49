"""Regularised linear classifiers on hashed features, trained on a bounded sample."""

from __future__ import annotations

import itertools
import zlib

import numpy as np

BITS = 18


def place(feature: str, bits: int = BITS) -> int:
    """Where a feature falls in the hashed space; the same in every process."""
    return zlib.crc32(feature.encode()) & ((1 << bits) - 1)


class Sparse:
    """Rows of hashed features, each row scaled to length one, with a constant feature at the end."""

    def __init__(self, rows: list[list[int]], bits: int = BITS):
        self.size = (1 << bits) + 1
        n = len(rows)
        given = np.fromiter(itertools.chain.from_iterable(rows), np.int64)
        of_row = np.repeat(np.arange(n), np.fromiter(map(len, rows), np.int64, n))
        entries = np.concatenate([of_row * self.size + given, np.arange(1, n + 1) * self.size - 1])
        entries.sort()
        entries = entries[np.append(True, entries[1:] != entries[:-1])] if n else entries
        self.row, self.index = (entries // self.size).astype("i4"), (entries % self.size).astype("i4")
        lengths = np.bincount(self.row, minlength=n)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.value = np.repeat((1 / np.sqrt(lengths)).astype("f4"), lengths) if n else np.zeros(0, "f4")

    @classmethod
    def joined(cls, row: np.ndarray, index: np.ndarray, n: int, bits: int = BITS) -> "Sparse":
        """n rows from pairs of row and feature in any order; a feature met twice counts twice."""
        out = object.__new__(cls)
        out.size = (1 << bits) + 1
        row = np.concatenate([row, np.arange(n)])
        index = np.concatenate([index, np.full(n, out.size - 1)])
        order = np.argsort(row, kind="stable")
        lengths = np.bincount(row, minlength=n)
        out.ends = np.cumsum(lengths)
        out.starts = out.ends - lengths
        out.index, out.row = index[order].astype("i4"), row[order].astype("i4")
        out.value = np.repeat((1 / np.sqrt(lengths)).astype("f4"), lengths)
        return out

    def rows(self, keep: np.ndarray) -> "Sparse":
        """The rows where keep is true."""
        out, entry = object.__new__(Sparse), keep[self.row]
        lengths = (self.ends - self.starts)[keep]
        out.size, out.ends = self.size, np.cumsum(lengths)
        out.starts = out.ends - lengths
        out.index, out.value = self.index[entry], self.value[entry]
        out.row = np.repeat(np.arange(len(lengths), dtype="i4"), lengths)
        return out

    def narrowed(self) -> tuple[tuple[np.ndarray, int], "Sparse"]:
        """The features that occur with the width of the space, and the rows over those features only."""
        found, place_of = np.unique(self.index, return_inverse=True)
        out = object.__new__(Sparse)
        out.__dict__ |= self.__dict__ | {"size": len(found), "index": place_of.astype("i4")}
        return (found, self.size), out

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weights[self.index] * self.value, self.starts) if len(self.starts) else np.zeros(0)

    def back(self, residual: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, weights=self.value * residual[self.row], minlength=self.size)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: Sparse, y: np.ndarray, l2: float = 1e-5, rounds: int = 120, rate: float = 0.8) -> np.ndarray:
    """Weights of a logistic regression by full batches and Adam steps, over the features that occur.

    The rarer class weighs more per row, by the square root of the ratio of the counts.
    """
    used, x = x.narrowed()
    full = np.zeros(used[1])
    full[used[0]] = _descend(x, y, l2, rounds, rate)
    return full


def _descend(x: Sparse, y: np.ndarray, l2: float, rounds: int, rate: float) -> np.ndarray:
    y = np.asarray(y, float)
    weight = np.where(y > 0, max(1.0, y.sum()) ** -0.5, max(1.0, (1 - y).sum()) ** -0.5)
    weight /= max(weight.sum(), 1e-12)
    w = np.zeros(x.size)
    first, second = np.zeros(x.size), np.zeros(x.size)
    for t in range(1, rounds + 1):
        grad = x.back(weight * (sigmoid(x.dot(w)) - y)) + l2 * w
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        step = rate * (1 - t / (rounds + 1))
        w -= step * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return w


def best_threshold(scores: np.ndarray, y: np.ndarray, slack: float = 0.004) -> tuple[float, float]:
    """A cut for the scores of held-out rows, and its F1: of those whose F1 is within slack of the best, the one nearest 0."""
    if not len(scores) or not np.any(y):
        return 0.0, 0.0
    order = np.argsort(-scores, kind="stable")
    s, t = scores[order], np.asarray(y, float)[order]
    hits = np.cumsum(t)
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + t.sum())
    f1 = np.where(np.append(s[1:] != s[:-1], True), f1, -1)
    good = np.flatnonzero(f1 >= f1.max() - slack)
    below = np.append(s[1:], s[-1] - 2.0)
    cuts = np.clip(0.0, (s[good] + below[good]) / 2, s[good])
    k = int(np.argmin(np.abs(cuts)))
    return float(cuts[k]), float(f1[good[k]])
