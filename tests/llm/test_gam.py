"""The additive model against plain versions of its features and its sum, and its held-out accuracy."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import _sample, gam, langid, queries

SF = "/root/testdata/sf0.01"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _plain(text):
    raw = (text or "").encode()
    words = WORD.findall(raw)
    if not words:
        return [0.0] * len(gam.FEATURES)
    n, size = len(words), len(raw)
    share = lambda chars: sum(b in chars for b in raw) / size
    letters = [b for b in raw if b < 128 and chr(b).isalpha()]
    lines = [x.strip() for x in raw.split(b"\n") if x.strip()]
    counts = Counter(words)
    triples = [tuple(words[i : i + 3]) for i in range(n - 2)]
    wordy = lambda b: b >= 128 or chr(b).isalnum()
    return [
        math.log1p(n), math.log1p(size), sum(map(len, words)) / n, math.log1p(max(map(len, words))), sum(chr(b).isupper() for b in letters) / max(1, len(letters)),
        share(b"0123456789"), share(b"#*$%&|<>@^~_=+\\/{}[]"), share(b".,;:?"), share(b"!"), share(b" \t\n\v\f\r"), sum(b >= 128 for b in raw) / size,
        n / len(lines), 1 - len(set(lines)) / len(lines), sum(x[-1:] in (b".", b"!", b"?", b":") for x in lines) / len(lines), len(counts) / n, max(counts.values()) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n, 1 - len(set(triples)) / len(triples) if triples else 0.0, sum(len(w) <= 2 for w in words) / n,
        sum(not wordy(w[-1]) for w in words) / n, -sum(c / size * math.log2(c / size) for c in Counter(raw).values()),
    ]


TEXTS = [None, "", " \n\t", "one", "One two. One two.\nONE two!\n\nx # | é", "a a a a a a", "é" * 40, "word " * 3000, "x" * 200_000, "l1\n" * 50 + "12 34 ##"]


def test_measures():
    got = gam.measures([(t or "").encode() for t in TEXTS])
    assert np.allclose(got, [_plain(t) for t in TEXTS])


def test_sum_of_tables():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, len(gam.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(int)  # no feature tells anything without the other
    model = gam.fit(x, y, np.ones(600), rng.random(600) < 0.25)
    assert (0, 1) in model.pairs
    fresh = rng.normal(size=(400, len(gam.FEATURES)))
    assert (((fresh[:, 0] > 0) ^ (fresh[:, 1] > 0)) == (model.probability(fresh) > 0.5)).mean() > 0.8
    for row, p in zip(fresh[:40], model.probability(fresh[:40]), strict=True):
        z = model.offset
        for j, table in enumerate(model.tables):
            z += table[sum(c <= row[j] for c in model.cuts[j])]
        for (i, j), table in model.pairs.items():
            z += table[sum(c <= row[i] for c in model.pair_cuts[i])][sum(c <= row[j] for c in model.pair_cuts[j])]
        assert math.isclose(p, 1 / (1 + math.exp(-(model.slope * z + model.shift))), rel_tol=1e-9)


def test_tree_values():
    g, h = np.array([4.0, 4, -2, -2, 6, 6]), np.ones(6)
    assert np.allclose(gam._tree(g, h), [8 / 3, 8 / 3, -4 / 3, -4 / 3, 4, 4])
    gain, out = gam._quadrants(np.array([[3.0, -3], [-3, 3]]), np.ones((2, 2)))
    assert gain > 0 and np.allclose(out, [[1.5, -1.5], [-1.5, 1.5]])


def test_held_out_accuracy(spark):
    got = queries.QUERIES["op13_quality_classifier"](spark, SF)
    kinds = dict(got.dtypes)
    assert (kinds["doc_id"], kinds["held_out"], kinds["score"], kinds["predicted"]) == ("bigint", "boolean", "double", "int")
    rows = got.collect()
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in label]
    assert sum(r.predicted == label[r.doc_id] for r in held) >= 0.97 * len(held)


def test_edges(spark):
    schema = "doc_id long, text string, Score string, held_out int"
    docs = spark.createDataFrame([(i % 7 or None, t, "s", 1) for i, t in enumerate(TEXTS)], schema)
    for labels, share in (([], 0.5), ([(1, 1), (2, 1), (99, 0), (None, 0)], 0.75), ([(1, 5)], 0.5)):
        model = gam.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        rows = gam.score(docs, model)
        assert rows.columns == ["doc_id", "text", "held_out", "score", "predicted"]
        found = rows.collect()
        assert len(found) == len(TEXTS) and (share == 0.75 or all(math.isclose(r.score, share) for r in found))
    assert gam.score(spark.createDataFrame([], schema), model).collect() == []


@pytest.mark.parametrize("case", ["one id", "repeated labels", "null ids"])
def test_sample_is_bounded(spark, case):
    n = 3000
    docs = spark.range(n).select((F.lit(1) if case == "one id" else F.when(F.col("id") >= 0, None) if case == "null ids" else F.col("id")).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = spark.range(n).select((F.lit(1) if case != "null ids" else F.lit(None)).cast("long").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    got = _sample.labelled_texts(docs, labels, "quality", 64)
    rows = got.collect()
    assert all(sum(r.quality == k for r in rows) <= 64 for k in (0, 1)) and (case == "null ids") == (not rows)


def test_never_learns_from_the_held_fold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    fold = langid.fold() != 2
    ids = {r.doc_id for r in labels.where(fold).collect()}
    drawn = _sample.labelled_texts(docs, labels, "quality", 4096, fold)
    texts = {r.text for r in docs.where(F.col("doc_id").isin(list(ids))).collect()}
    assert {r.text for r in drawn.collect()} <= texts
