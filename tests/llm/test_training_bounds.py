"""What training draws: bounded whatever ids repeat, every language, rows without ids, whole texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import _sample, langid, quality

SF = "/root/testdata/sf0.001"

def everything():
    return F.lit(True)


def _docs(spark, n, doc_id, lang):
    return spark.range(n).select(doc_id.cast("long").alias("doc_id"), F.concat(F.lit("the text of row "), F.conv("id", 10, 26), F.lit(" is a text")).alias("text"), lang.cast("string").alias("lang"))


@pytest.mark.parametrize("doc_id", ["1", "null", "id"])
def test_language_rows(spark, monkeypatch, doc_id):
    monkeypatch.setattr(langid, "PER_LANGUAGE", 64)
    docs = _docs(spark, 20_000, F.expr(doc_id), F.when(F.col("id") % 2 == 0, "a").otherwise("b"))
    rows = langid.training_rows(docs, everything()).collect()
    assert {lang: sum(r.lang == lang for r in rows) for lang in ("a", "b")} == {"a": 64, "b": 64}


def test_every_language_is_learned(spark):
    words = [f"{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}{chr(97 + k % 11)}" for k in range(300)]
    rows = [(i, f"{words[k]} {words[k]}{words[k]} " * 3 + "x" * i, f"l{k:03d}") for k in range(300) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, everything(), epochs=3)
    assert len(model.languages) == 300 and model.layer is not None
    assert len(langid.training_rows(docs, everything()).collect()) == 1200
    assert 0 <= model.predict(rows[0][1])[1] <= 1


def test_both_forms_of_a_model_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs, everything())
    rng = np.random.default_rng(1)
    table, layer = rng.normal(size=(1 << langid.BITS, langid.DIM)), rng.normal(size=(langid.DIM, len(model.languages)))
    one = langid.LanguageModel(model.languages, table @ layer, None, model.offset, 1.0, 0.0)
    two = langid.LanguageModel(model.languages, table, layer, model.offset, 1.0, 0.0)
    for text in ("the and of", "der und", "1 2", "é"):
        a, b = one.predict(text), two.predict(text)
        assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-9


def test_predictions_against_a_plain_version(spark):
    """Every row's prediction, from the definition: subwords by slicing, means and sums in loops."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40")
    model = langid.train(docs, everything(), epochs=2)
    for r in langid.predict(docs, model).collect():
        text = r.text or ""
        if not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        raw = f" {langid._BLANK.sub(' ', text.lower())} ".encode()
        z = [float(o) for o in model.offset]
        buckets = []
        for n in langid.ORDERS:
            for i in range(len(raw) - n + 1):
                if b" " not in raw[i + 1 : i + n - 1]:
                    h = 2166136261 + 97 * n
                    for b in raw[i : i + n]:
                        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
                        h ^= h >> 15
                    buckets.append(((h * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - langid.BITS))
        for b in buckets:
            z = [x + float(model.table[b][k]) / len(buckets) for k, x in enumerate(z)]
        p = np.exp(np.asarray(z) / model.temperature - max(z) / model.temperature)
        p /= p.sum()
        assert r.lang_pred == model.languages[int(np.argmax(p))] and abs(r.score - p.max()) < 1e-4


@pytest.mark.parametrize("shared", [True, False])
def test_quality_rows(spark, monkeypatch, shared):
    monkeypatch.setattr(quality, "PER_CLASS", 64)
    docs = _docs(spark, 5000, F.lit(1) if shared else F.col("id"), F.lit("en"))
    labels = spark.range(5000).select((F.lit(1) if shared else F.col("id")).cast("long").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    rows = quality.training_rows(docs, labels).collect()
    assert {k: sum(r.quality == k for r in rows) for k in (0, 1)} == {0: 64, 1: 64}


def test_long_texts_are_read_whole(spark):
    text = "start " + "filler " * 30_000 + "finish"
    docs = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    (row,) = langid.training_rows(docs, everything()).collect()
    assert set(np.frombuffer(bytes(row.buckets), np.uint16)) == set(langid.subwords(text))
    assert [r.text for r in _sample.sample_texts(docs, "lang", 16).collect()] == [text]


def test_pipeline_keeps_a_corpus_without_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.language(spark, docs, SF).count()
    bare = corpus_pipeline.language(spark, docs.withColumn("doc_id", F.lit(None).cast("long")), SF)
    assert bare.columns == list(corpus_pipeline.COLUMNS) and abs(bare.count() - kept) <= 4 and kept >= 190
