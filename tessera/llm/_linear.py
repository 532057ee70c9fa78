"""What the text classifiers share: hashed n-gram places of whole texts, and the fit of probabilities."""

from __future__ import annotations

import numpy as np

from tessera.llm._words import mix64


def char_grams(raw: np.ndarray, orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of bytes or code points: bucket of each, and the place it starts at. Grams that hold a blank inside are left out, word ends are kept."""
    x = raw.astype(np.uint32)
    blank = raw == 32
    buckets, places = [], []
    for n in orders:
        size = len(x) - n + 1
        if size <= 0:
            continue
        h = np.full(size, 2166136261 + 97 * n, np.uint32)
        inside = np.zeros(size, bool)
        for k in range(n):
            h = (h ^ x[k : k + size]) * np.uint32(16777619)
            h ^= h >> np.uint32(15)
            if 0 < k < n - 1:
                inside |= blank[k : k + size]
        keep = np.flatnonzero(~inside)
        h = h[keep] * np.uint32(0x9E3779B1)
        buckets.append((h >> np.uint32(32 - bits)).astype(np.int64))
        places.append(keep)
    if not buckets:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(buckets), np.concatenate(places)


def hashed(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of 64-bit hashes."""
    return (mix64(hashes) >> np.uint64(64 - bits)).astype(np.int64)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits that gives held-back labels the greatest likelihood."""
    grid = np.geomspace(0.05, 20, 121)
    loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit_platt(z: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and offset of the logistic curve from scores to probabilities, by Newton's method with a small prior."""
    a, b = 1.0, 0.0
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - t) * z).sum() + 1e-3 * (a - 1), (p - t).sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)
