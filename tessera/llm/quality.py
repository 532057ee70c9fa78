"""Quality rules: exact measures of a text, and a logistic regression over hashed n-grams.

The model's features are the words, the pairs of neighbouring words (a pair of equal words is one
feature, whatever the word) and the 1- to 3-grams of characters, hashed into tables; a text is the mean of
each family. It is trained by stochastic gradient descent in numpy on a bounded sample of the texts that
`labels` covers, PER_CLASS different ones of each class; each is read whole, and its features are counted where
it is, so that the driver gets counts of at most 2**WORD_BITS + 2**CHAR_BITS features a row. On rows held back, a logistic curve turns scores into probabilities. Texts are scored
in Arrow batches, whole, and kept at or over a fixed probability unless a base rule fails them.

Defined cases: null and empty texts have no words and fail the base rule; with labels of one class only,
or none, the model keeps every text; labels of null ids or unknown documents are ignored, repeated ones
and equal texts of a class count once, those of one id that disagree each; repeated rows get equal results; an empty table gives no row; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._linear import char_grams, fit_platt, hashed
from tessera.llm._sample import labelled_texts
from tessera.llm._util import bounded_batches, with_text
from tessera.llm._words import Words, groups, mix64, runs

PER_CLASS = 3008  # labelled texts of each class that training looks at, at most
KEEP_FROM = 0.3  # probability of good quality from which a text is kept
LEAST_WORDS = 50
MOST_REPEATED = 50  # of 100 words
WORD_BITS, CHAR_BITS, ORDERS = 16, 14, (1, 2, 3)
_SYMBOLS = b"#*$%&|<>"
_BLANK = b" \t\n\v\f\r"
_TO_SPACE = str.maketrans("\t\n\v\f\r", "     ")
_EQUAL = np.uint64(0x5851F42D4C957F2D)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass
class QualityModel:
    """Weights of both feature tables, offset, and the calibration curve."""

    words: np.ndarray
    grams: np.ndarray
    offset: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, z: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -40, 40))))

    def score(self, word_places: np.ndarray, gram_places: np.ndarray) -> float:
        z = self.offset
        if len(word_places):
            z += float(self.words[word_places].mean())
        if len(gram_places):
            z += float(self.grams[gram_places].mean())
        return z


def features(words: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and pairs, and of character n-grams."""
    pairs = runs(words, 2)
    if len(pairs):
        pairs = np.where(words[1:] == words[:-1], _EQUAL, mix64(pairs))
    return hashed(np.concatenate([words, pairs]), WORD_BITS), char_grams(np.frombuffer(text.translate(_TO_SPACE).encode("utf-32-le"), "<u4"), ORDERS, CHAR_BITS)[0]


def measures(text: str, raw: bytes, windows: np.ndarray, n_words: int) -> tuple[int, int, int, int, int]:
    """The five measures of one text; windows: hashes of its runs of three words."""
    word_chars = len(text) - (len(raw) - len(raw.translate(None, _BLANK)))
    n_symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if len(windows):
        _, which, n = np.unique(windows, return_inverse=True, return_counts=True)
        twice = n[which] >= 2
        if twice.any():
            covered = np.zeros(n_words, bool)
            for k in range(3):
                covered[k : k + len(twice)] |= twice
            repeated = int(covered.sum())
    return n_words, word_chars, n_symbols, len(lines) - len(set(lines)), repeated


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(h, quality, words, word_shares, grams, gram_shares) of the sampled texts: features as bytes of unsigned 16-bit and 32-bit float numbers."""
    sample = labelled_texts(docs, labels, "quality", PER_CLASS)
    bounded_batches(docs.sparkSession)
    kinds = ("words", "word_shares", "grams", "gram_shares")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: dict[str, list[bytes]] = {k: [] for k in kinds}
            for text in batch.column(2).to_pylist():
                for k, at in enumerate(features(Words([text.encode()]).hash, text)):
                    found, n = np.unique(at, return_counts=True)
                    cols[kinds[2 * k]].append(found.astype(np.uint16).tobytes())
                    cols[kinds[2 * k + 1]].append((n / max(1, n.sum())).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, pa.binary()) for c in cols.values())], names=["h", "quality", *kinds])

    return sample.select("h", F.col("quality").cast("int"), "text").mapInArrow(run, "h long, quality int, " + ", ".join(f"{k} binary" for k in kinds))


def train(docs: DataFrame, labels: DataFrame, epochs: int = 15, rate: float = 20.0, seed: int = 11) -> QualityModel:
    """Fits a model. What the driver holds is bounded by two classes of PER_CLASS rows of counts."""
    model = QualityModel(np.zeros(1 << WORD_BITS), np.zeros(1 << CHAR_BITS))
    rows = sorted(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in training_rows(docs, labels).collect())
    y = np.asarray([r[1] for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        model.shift = 40.0
        return model
    found = [[(np.frombuffer(r[k], np.uint16), np.frombuffer(r[k + 1], np.float32)) for k in (2, 4)] for r in rows]
    held = np.asarray([(r[0] >> 7) % 4 == 0 for r in rows])
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(rows), bool)
    fit = np.flatnonzero(~held)
    weight = np.where(y == 1, 0.5 / max(1, (y[fit] == 1).sum()), 0.5 / max(1, (y[fit] == 0).sum())) * len(fit)
    rng = np.random.default_rng(seed)

    def raw_score(i: int) -> float:
        (a, s), (b, t) = found[i]
        return float(model.words[a] @ s + model.grams[b] @ t + model.offset)

    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(fit):
            e = weight[i] * (1 / (1 + np.exp(-np.clip(raw_score(i), -40, 40))) - y[i])
            for table, (at, share) in zip((model.words, model.grams), found[i], strict=True):
                table[at] -= step * e * share
            model.offset -= 0.001 * step * e
    check = np.flatnonzero(held) if held.any() else np.arange(len(rows))
    model.slope, model.shift = fit_platt(np.asarray([raw_score(i) for i in check]), y[check])
    model.words, model.grams = model.words.astype(np.float32), model.grams.astype(np.float32)
    return model


def judge(docs: DataFrame, model: QualityModel, keep_from: float = KEEP_FROM) -> DataFrame:
    """docs with the measures, `base_failed`, `probability` and `kept`. The model's size is fixed."""
    added = (*MEASURES, "base_failed", "probability", "kept")
    names = [c for c in docs.columns if c not in added]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*names).schema
    for m in MEASURES:
        schema = schema.add(m, "long")
    schema = schema.add("base_failed", "boolean").add("probability", "double").add("kept", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(at)]
            raws = [t.encode() for t in texts]
            rows = []
            for a, b in groups(raws):
                w = Words(raws[a:b])
                windows = runs(w.hash, 3)
                for k, (i, j) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
                    raw = raws[a + k]
                    got = measures(texts[a + k], raw, windows[i : max(i, j - 2)], j - i)
                    failed = got[0] < LEAST_WORDS or 100 * got[4] > MOST_REPEATED * got[0]
                    p = m.probability(m.score(*features(w.hash[i:j], texts[a + k])))
                    rows.append((*got, failed, p, not failed and p >= keep_from))
            kinds = (*(pa.int64() for _ in MEASURES), pa.bool_(), pa.float64(), pa.bool_())
            cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *cols], names=[*names, *added])

    bounded_batches(docs.sparkSession)
    source, at = with_text(docs, names)
    return source.mapInArrow(run, schema)
