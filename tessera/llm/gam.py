"""A quality classifier: a generalised additive model with pairwise interactions.

A text is described by the numbers of FEATURES. Each is cut into bins at quantiles of the training sample and
has a table of one value a bin; some pairs of features have a table over coarser bins of both. The logit is
the sum of what the tables hold, so a score can be read off and explained. Tables are the sums of shallow
trees: boosting goes over the features in a cycle, fits a tree of two levels to the gradient within the bins
of one feature and adds a small part of it to that feature's table. Pairs are chosen by what one cut in each
feature gains on what is left, and boosted in the same way. Rows held back say when to stop, and a logistic
curve fitted to them calibrates the scores.

Features are computed from whole texts where the texts are; what the driver holds is FEATURES numbers for each
row of a sample of at most PER_CLASS texts a class.

Defined cases: null and empty texts have features of zero and a score as any other; labels other than 0 and 1,
of null ids or of unknown documents are ignored; equal texts of a class count once in the sample; with labels
of one class only, or none, each text scores that class's smoothed share, or one half; repeated rows get equal
scores; very long texts are measured whole; an empty table gives no row; other columns stay, but those named as
the added ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._sample import labelled_texts
from tessera.llm._util import bounded_batches, with_text
from tessera.llm._words import Words, groups, runs

PER_CLASS = 4096
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE = 200, 100, 0.1
PATIENCE = 25  # rounds without gain on the rows held back
RIDGE = 1.0  # added to each leaf's weight
GOOD_FROM = 0.7
FEATURES = (
    "log_words", "log_chars", "word_length", "longest_word", "upper", "digits", "symbols", "marks", "exclaims", "blanks", "wide",
    "line_words", "same_lines", "ended_lines", "distinct_words", "top_word", "same_neighbours", "same_triples", "short_words", "marked_words", "entropy",
)

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digits": b"0123456789",
    "symbols": b"#*$%&|<>@^~_=+\\/{}[]",
    "marks": b".,;:?",
    "exclaims": b"!",
    "blanks": b" \t\n\v\f\r",
}
_IN = {k: np.isin(np.arange(256), np.frombuffer(v, np.uint8)) for k, v in _CLASSES.items()}
_WORDY = _IN["upper"] | _IN["lower"] | _IN["digits"] | (np.arange(256) >= 128)


def measures(raws: list[bytes]) -> np.ndarray:
    """FEATURES of each text, from its UTF-8 bytes."""
    out = np.zeros((len(raws), len(FEATURES)))
    for a, b in groups(raws):
        w = Words(raws[a:b])
        buf = np.frombuffer(w.buf, np.uint8)
        lengths, windows = w.stop - w.start, runs(w.hash, 3)
        same = np.concatenate([[False], w.hash[1:] == w.hash[:-1]])
        marked = ~_WORDY[buf[w.stop - 1]] if len(w.stop) else np.zeros(0, bool)
        for k, (i, j) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
            raw, n = raws[a + k], j - i
            if n:
                out[a + k] = _one(raw, w.hash[i:j], lengths[i:j], windows[i : max(i, j - 2)], int(same[i + 1 : j].sum()), int(marked[i:j].sum()))
    return out


def _one(raw: bytes, words: np.ndarray, lengths: np.ndarray, windows: np.ndarray, same: int, marked: int) -> list[float]:
    n, size = len(words), len(raw)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    of = {k: int(hist[member].sum()) for k, member in _IN.items()}
    wide = int(hist[128:].sum())
    lines = [x.strip() for x in raw.split(b"\n")]
    lines = [x for x in lines if x]
    counts = np.unique(words, return_counts=True)[1]
    share = hist[hist > 0] / size
    return [
        np.log1p(n), np.log1p(size), float(lengths.mean()), float(np.log1p(lengths.max())), of["upper"] / max(1, of["upper"] + of["lower"]), of["digits"] / size,
        of["symbols"] / size, of["marks"] / size, of["exclaims"] / size, of["blanks"] / size, wide / size, n / len(lines), 1 - len(set(lines)) / len(lines),
        sum(x.endswith((b".", b"!", b"?", b":")) for x in lines) / len(lines), len(counts) / n, float(counts.max()) / n, same / n,
        1 - len(np.unique(windows)) / len(windows) if len(windows) else 0.0, float((lengths <= 2).sum()) / n, marked / n, float(-(share * np.log2(share)).sum()),
    ]


@dataclass
class Additive:
    """Cuts and tables of features and of pairs; the logit is their sum and the offset, before calibration."""

    offset: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    slope: float = 1.0
    shift: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.offset)
        for j, table in enumerate(self.tables):
            z += table[np.searchsorted(self.cuts[j], x[:, j], side="right")]
        for (i, j), table in self.pairs.items():
            z += table[np.searchsorted(self.pair_cuts[i], x[:, i], side="right"), np.searchsorted(self.pair_cuts[j], x[:, j], side="right")]
        return z

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logit(x) + self.shift, -40, 40)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    """Values between which bins lie, some bins - 1 quantiles of what a feature takes."""
    return np.unique(np.quantile(x, np.arange(1, bins) / bins, method="closest_observation"))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values of a tree of two levels over the bins of one feature, from the sums of gradient and weight in each."""
    out = np.empty(len(g))

    def split(a: int, b: int, levels: int) -> None:
        left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
        all_g, all_h = g[a:b].sum(), h[a:b].sum()
        if levels and b - a > 1:
            gains = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
            k = int(np.argmax(gains))
            if gains[k] > 1e-9:
                split(a, a + k + 1, levels - 1)
                split(a + k + 1, b, levels - 1)
                return
        out[a:b] = all_g / (all_h + RIDGE)

    split(0, len(g), 2)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts a pair of features once each."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    if min(g.shape) < 2:
        return 0.0, np.full(g.shape, g.sum() / (h.sum() + RIDGE))

    def four(c: np.ndarray) -> list[np.ndarray]:
        a = c[:-1, :-1]
        right, down, total = c[:-1, -1:] - a, c[-1:, :-1] - a, c[-1, -1]
        return [a, right, down, total - a - right - down]

    parts = list(zip(four(cg), four(ch), strict=True))
    gains = sum(_gain(x, y) for x, y in parts) - _gain(cg[-1, -1], ch[-1, -1])
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    value = [x[i, j] / (y[i, j] + RIDGE) for x, y in parts]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = value
    return float(gains[i, j]), out


class _Boost:
    """Logits of all rows while tables are boosted; rows held back choose the round."""

    def __init__(self, y: np.ndarray, weight: np.ndarray, held: np.ndarray, z: np.ndarray):
        self.y, self.weight, self.held, self.z = y, weight, held, z
        self.fit = ~held

    def gradient(self) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(self.z, -40, 40)))
        return self.weight * (self.y - p), np.maximum(self.weight * p * (1 - p), 1e-9)

    def loss(self) -> float:
        seen = self.held if self.held.any() else self.fit
        t = np.where(self.y > 0, self.z, -self.z)[seen]
        return float((self.weight[seen] * np.logaddexp(0, -t)).sum())

    def cycle(self, terms: list[tuple[np.ndarray, tuple[int, ...]]], values, rounds: int) -> list[np.ndarray]:
        """Tables of terms (bin of each row, shape), boosted in turn; `values` makes a tree of sums of gradient and weight."""
        tables = [np.zeros(shape) for _, shape in terms]
        best, best_tables, best_z, since = self.loss(), [t.copy() for t in tables], self.z.copy(), 0
        for _ in range(rounds):
            for (at, shape), table in zip(terms, tables, strict=True):
                g, h = (np.bincount(at[self.fit], s[self.fit], table.size).reshape(shape) for s in self.gradient())
                step = RATE * values(g, h)
                table += step
                self.z = self.z + step.ravel()[at]
            now, since = self.loss(), since + 1
            if now < best:
                best, best_tables, best_z, since = now, [t.copy() for t in tables], self.z.copy(), 0
            elif since >= PATIENCE:
                break
        self.z = best_z
        return best_tables


def _curve(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve that fits labels best, of a grid; a slope over 1 is never needed to rank, so classes that part wholly don't make it steep."""
    best = (np.inf, 1.0, 0.0)
    for slope in np.geomspace(0.1, 1.0, 21):
        for shift in np.linspace(-3, 3, 61):
            t = slope * z + shift
            best = min(best, (float((weight * np.logaddexp(0, np.where(y > 0, -t, t))).sum()), float(slope), float(shift)))
    return best[1:]


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, held: np.ndarray) -> Additive:
    """A model of rows x with labels y; `held` rows only choose rounds and calibrate."""
    share = float((weight * y).sum() / weight.sum())
    model = Additive(float(np.log(share / (1 - share))))
    model.cuts = [_cuts(x[~held, j], BINS) for j in range(x.shape[1])]
    boost = _Boost(y, weight, held, np.full(len(y), model.offset))
    bins = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.cuts)]
    model.tables = boost.cycle([(b, (len(c) + 1,)) for b, c in zip(bins, model.cuts, strict=True)], _tree, ROUNDS)
    model.pair_cuts = [_cuts(x[~held, j], PAIR_BINS) for j in range(x.shape[1])]
    coarse = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.pair_cuts)]
    sizes = [len(c) + 1 for c in model.pair_cuts]
    g, h = boost.gradient()
    found = []
    for i, j in combinations(range(x.shape[1]), 2):
        at = (coarse[i] * sizes[j] + coarse[j])[boost.fit]
        sums = [np.bincount(at, s[boost.fit], sizes[i] * sizes[j]).reshape(sizes[i], sizes[j]) for s in (g, h)]
        found.append((-_quadrants(*sums)[0], i, j))
    chosen = [(i, j) for _, i, j in sorted(found)[:PAIRS]]
    terms = [(coarse[i] * sizes[j] + coarse[j], (sizes[i], sizes[j])) for i, j in chosen]
    model.pairs = dict(zip(chosen, boost.cycle(terms, lambda g, h: _quadrants(g, h)[1], PAIR_ROUNDS), strict=True))
    if len(set(y[held].tolist())) == 2:
        model.slope, model.shift = _curve(boost.z[held], y[held], weight[held])
    return model


def _texts(batch: pa.RecordBatch, at: int) -> list[bytes]:
    return [(t.as_py() or "").encode() for t in batch.column(at)]


def training_rows(docs: DataFrame, labels: DataFrame, label: str, allowed: Column | None) -> DataFrame:
    """(label, h, measures) of the sample."""
    sample = labelled_texts(docs, labels, label, PER_CLASS, allowed)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [pa.array(list(r), pa.float64()) for r in measures(_texts(batch, 2)).T]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *x], names=["label", "h", *FEATURES])

    return sample.select(F.col(label).cast("int"), "h", "text").mapInArrow(run, "label int, h long, " + ", ".join(f"{f} double" for f in FEATURES))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", allowed: Column | None = None) -> Additive:
    """Fits a model to labels (doc_id and `label`), of rows of labels where `allowed` holds."""
    rows = sorted(tuple(r) for r in training_rows(docs, labels, label, allowed).collect())  # 2 * PER_CLASS rows of numbers at most
    wanted = labels.where("doc_id is not null").where(F.lit(True) if allowed is None else allowed)
    total = dict(wanted.where(f"{label} in (0, 1)").groupBy(F.col(label).cast("int").alias("k")).count().collect())
    y = np.asarray([r[0] for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        share = (int(y.sum()) + 1) / (len(y) + 2) if len(y) else 0.5
        return Additive(float(np.log(share / (1 - share))))
    x = np.asarray([r[2:] for r in rows])
    weight = np.asarray([total[k] / (y == k).sum() for k in (0, 1)])[y]  # the sample stands for all labelled rows
    held = np.asarray([(r[1] >> 7) % 4 == 0 for r in rows])
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(y), bool)
    return fit(x, y, weight / weight.mean(), held)


def score(docs: DataFrame, model: Additive, good_from: float = GOOD_FROM) -> DataFrame:
    """docs with `score` and `predicted`. The model's size is fixed by FEATURES, BINS and PAIRS."""
    names = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bounded_batches(docs.sparkSession)
    source, at = with_text(docs, names)
    schema = docs.select(*names).schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.probability(measures(_texts(batch, at)))
            cols = [pa.array(p, pa.float64()), pa.array((p >= good_from).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *cols], names=[*names, "score", "predicted"])

    return source.mapInArrow(run, schema)
