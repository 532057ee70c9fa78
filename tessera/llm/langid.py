"""Language ID by averaged hashed subword embeddings and a linear softmax.

A text is lower-cased and all but letters become blanks; its subwords are the 2- to 4-grams of bytes of
its words, with a blank as word end. Each subword has an embedding in a hashed table; the mean of a
text's embeddings goes through a linear layer and softmax. Table and layer are trained by stochastic
gradient descent in numpy on a bounded sample of labelled rows: PER_LANGUAGE different texts of each
language, fewer where languages are so many that all together would pass MOST_ROWS, but never under
LEAST_ROWS. Every language is learned. On rows held back from training, a temperature calibrates the
probabilities, and the rejection threshold is set so that it turns away at most a given share of rightly
labelled rows.

The model reads texts only, all of each, in training as in prediction; subwords are counted where the texts
are, and the driver gets counts of at most 2**BITS subwords a row. With few languages, table and layer are
multiplied out, and a prediction sums rows of that product.

Defined cases: a text that is null or has no letter is `und`, scored 0 and rejected; ties go to the
language first in order of name; a null or repeated doc_id means nothing; equal texts of a language count once
in the sample; a very long text is read whole; with no labelled row at all every text is `und`; repeated rows
get equal predictions; an empty table gives no row; other columns stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._linear import char_grams, fit_temperature, softmax
from tessera.llm._sample import sample_texts
from tessera.llm._util import bounded_batches, with_text

PER_LANGUAGE, MOST_ROWS, LEAST_ROWS = 1024, 8192, 16  # labelled texts that training looks at: of a language, of all, of a language however many there are
_BATCH = 8  # rows of one step of the descent
_SLICE = 1000  # rows a task hands on at once
REJECTED_SHARE = 0.0005  # of rightly labelled rows held back
BITS, DIM, ORDERS = 15, 16, (2, 3, 4)
_BLANK = re.compile(r"[\W\d_]+")


@dataclass
class LanguageModel:
    """Languages, embeddings and layer (or None and their product), offsets, temperature and rejection threshold."""

    languages: list[str]
    table: np.ndarray
    layer: np.ndarray | None
    offset: np.ndarray
    temperature: float
    threshold: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, calibrated probability, rejected)."""
        if not self.languages or not has_letter(text):
            return "und", 0.0, True
        buckets = subwords(text)
        z = self.table[buckets].mean(axis=0) if len(buckets) else np.zeros(self.table.shape[1])
        z = (z if self.layer is None else z @ self.layer) + self.offset
        p = softmax(np.asarray(z, np.float64) / self.temperature)
        k = int(np.argmax(p))
        return self.languages[k], float(p[k]), bool(p[k] < self.threshold)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def subwords(text: str) -> np.ndarray:
    """Buckets of a text's subwords."""
    raw = np.frombuffer(f" {_BLANK.sub(' ', text.lower())} ".encode(), np.uint8)
    return char_grams(raw, ORDERS, BITS)[0]


def training_rows(docs: DataFrame, allowed: Column) -> DataFrame:
    """(lang, h, buckets, shares) of the sampled texts that have a letter: their subwords as bytes of unsigned 16-bit and 32-bit float numbers."""
    rows = docs.where(allowed & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    languages = max(1, rows.select("lang").distinct().count())
    sample = sample_texts(rows, "lang", max(LEAST_ROWS, min(PER_LANGUAGE, MOST_ROWS // languages)))
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, h, at, shares = [], [], [], []
            for name, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found, n = np.unique(subwords(text), return_counts=True)
                if len(found) and has_letter(text):
                    lang.append(name)
                    h.append(key)
                    at.append(found.astype(np.uint16).tobytes())
                    shares.append((n / n.sum()).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(h, pa.int64()), pa.array(at, pa.binary()), pa.array(shares, pa.binary())], names=["lang", "h", "buckets", "shares"])

    return sample.select("lang", "h", "text").mapInArrow(run, "lang string, h long, buckets binary, shares binary")


def _means(table: np.ndarray, at: list[np.ndarray], shares: list[np.ndarray]) -> np.ndarray:
    """The mean embedding of each row, rows one after the other in one gather."""
    first = np.cumsum([0, *(len(x) for x in at[:-1])])
    return np.add.reduceat(table[np.concatenate(at)] * np.concatenate(shares)[:, None], first, axis=0)


def train(docs: DataFrame, allowed: Column, epochs: int = 12, rate: float = 0.5, seed: int = 7) -> LanguageModel:
    """Fits a model on rows where `allowed` holds."""
    rows = sorted((r.h, r.lang, bytes(r.buckets), bytes(r.shares)) for r in training_rows(docs, allowed).collect())
    at, shares = [np.frombuffer(r[2], np.uint16) for r in rows], [np.frombuffer(r[3], np.float32) for r in rows]
    names = sorted({r[1] for r in rows})
    if not names:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32), None, np.zeros(0), 1.0, 1.0)
    place = {n: k for k, n in enumerate(names)}
    y = np.asarray([place[r[1]] for r in rows])
    held = np.asarray([(r[0] >> 7) % 4 == 0 for r in rows]) & (len(rows) >= 8)
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (1 << BITS, DIM))
    layer, offset = rng.normal(0, 0.1, (DIM, len(names))), np.zeros(len(names))
    fit = np.flatnonzero(~held)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(fit)
        for batch in (order[a : a + _BATCH] for a in range(0, len(order), _BATCH)):
            mean = _means(table, [at[i] for i in batch], [shares[i] for i in batch])
            error = softmax(mean @ layer + offset)
            error[np.arange(len(batch)), y[batch]] -= 1
            back = error @ layer.T
            layer -= step * mean.T @ error
            offset -= 0.1 * step * error.sum(axis=0)
            for i, to in zip(batch, back, strict=True):
                table[at[i]] -= step * 20 * shares[i][:, None] * to
    z = np.concatenate([_means(table, at[a : a + 256], shares[a : a + 256]) @ layer + offset for a in range(0, len(rows), 256)])
    check = np.flatnonzero(held) if held.any() else np.arange(len(rows))
    temperature = fit_temperature(z[check], y[check])
    p = softmax(z[check] / temperature)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y[check]])
    threshold = min(0.5, float(right[int(REJECTED_SHARE * len(right))])) if len(right) else 0.0
    if len(names) <= DIM:
        return LanguageModel(names, (table @ layer).astype(np.float32), None, offset, temperature, threshold)
    return LanguageModel(names, table.astype(np.float32), layer.astype(np.float32), offset, temperature, threshold)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with `lang_pred`, `score` and `rejected`. The model's size is fixed but for DIM numbers a language: 2**BITS rows of DIM numbers."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bounded_batches(docs.sparkSession)
    source, at = with_text(docs, names)
    schema = docs.select(*names).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in (b.slice(a, _SLICE) for b in batches for a in range(0, b.num_rows, _SLICE)):
            got = [m.predict(t.as_py()) for t in batch.column(at)]
            cols = [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *cols], names=[*names, "lang_pred", "score", "rejected"])

    return source.mapInArrow(run, schema)


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the doc_id as text, modulo 4; null for a null doc_id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4))
