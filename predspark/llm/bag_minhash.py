"""Weighted minwise signatures of bags of word shingles, by hierarchical Poisson processes (BagMinHash)."""

from __future__ import annotations

import math

import numpy as np
import xxhash

from .token_index import mixed64

SHINGLE = 5
#: Components of a signature, in BANDS bands of ROWS: at a similarity of 0.8 one pair in 2e7 shares no band.
ROWS, BANDS = 4, 32
SIZE = ROWS * BANDS
#: Distinct words that a worker remembers; shingles whose signatures are drawn together, in some 20 arrays as long.
REMEMBERED, TOGETHER = 200_000, 200_000


class Shingler:
    """Texts to bags of shingles: sorted distinct 64-bit hashes of 5 words in a row, and how often each occurs.  A text
    of 1 to 4 words is one shingle; a text without words has none."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def bags(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        out = []
        for text in texts:
            words = text.encode("utf-8", "surrogatepass").split()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            h = np.fromiter((known[w] for w in words), np.uint64, len(words))
            n = min(SHINGLE, len(h))
            s = np.full(max(0, len(h) - n + 1) if n else 0, n, np.uint64)
            for k in range(n):
                s = mixed64(s ^ h[k : len(h) - n + k + 1], 21)
            out.append(np.unique(s, return_counts=True))
        return out


def uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], size: int = SIZE) -> np.ndarray:
    """(len(bags), size) components, equal in two bags with the probability of their weighted Jaccard similarity.

    Weights are whole numbers, the levels below a weight are 0, 1, ..., and each level of an element is a Poisson
    process of points in time with rate 1; a point falls on one component.  Levels are taken in intervals [0, 1),
    [1, 2), [2, 4), [4, 8), ...: one process with the interval's rate, whose points fall on a level of it; an interval
    that only partly lies below the weight gives its points on levels below it.  So a weight costs as many processes
    as it has binary digits, and bags share the points below the smaller of two weights.  A component is its least
    time.  Points are drawn in order of time to a horizon at which all components are likely to be filled, in rounds
    over all bags at once; a bag that is not filled is drawn anew with twice the horizon."""
    out = np.full((len(bags), size), np.inf)
    weight = np.array([int(w.sum()) for _, w in bags], np.float64)
    horizon = size * (math.log(size) + 3) / np.maximum(weight, 1)
    todo = np.flatnonzero(weight > 0)
    while len(todo):
        out[todo] = np.inf
        group, at = [], 0
        for i in todo.tolist():
            group.append(i)
            at += len(bags[i][0])
            if at >= TOGETHER:
                draw(bags, group, horizon, out)
                group, at = [], 0
        if group:
            draw(bags, group, horizon, out)
        todo = todo[np.isinf(out[todo]).any(1)]
        horizon[todo] *= 2
    return out


def draw(bags: list, group: list[int], horizon: np.ndarray, out: np.ndarray) -> None:
    size = out.shape[1]
    element = np.concatenate([bags[i][0] for i in group])
    weight = np.concatenate([bags[i][1] for i in group]).astype(np.float64)
    owner = np.repeat(np.array(group), [len(bags[i][0]) for i in group])
    flat = out.reshape(-1)
    low, high, k = 0.0, 1.0, 0
    while True:
        rate = high - low
        key, w, o = mixed64(element, 100 + k), weight, owner
        t, end = np.zeros(len(key)), horizon[o]
        j = 0
        while len(key):
            h = mixed64(key, 1000 + j)
            t = t - np.log(uniform(h)) / rate
            live = t <= end
            key, t, end, w, o, h = key[live], t[live], end[live], w[live], o[live], h[live]
            spot = mixed64(h, 5)
            level = low + np.floor(uniform(mixed64(h, 6)) * rate)
            good = level < w
            np.minimum.at(flat, o[good] * size + (spot[good] % np.uint64(size)).astype(np.int64), t[good])
            j += 1
        more = weight > high
        if not more.any():
            return
        element, weight, owner = element[more], weight[more], owner[more]
        low, high, k = high, high * 2, k + 1


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(bags, bands) 64-bit keys, one for each band of each signature, different for different bands."""
    bits = signature.view(np.uint64).reshape(len(signature), signature.shape[1] // rows, rows)
    key = np.broadcast_to(np.arange(bits.shape[1], dtype=np.uint64), bits.shape[:2]).copy()
    for r in range(rows):
        key = mixed64(key ^ bits[:, :, r], 30)
    return key.view(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """(sum of minima, sum of maxima) of two bags: the similarity as an exact fraction."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    return shared, int(a[1].sum()) + int(b[1].sum()) - shared
