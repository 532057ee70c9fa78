import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import kd_shard, langid, quality, topk

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, score double, size long"


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_held_out_accuracy(real):
    held = F.coalesce(langid.fold() == 2, F.lit(False))
    model = langid.train(real, ~held)
    got = langid.predict(real.withColumn("held", held), model)
    n, right, rejected = got.where("held").agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred")), F.count_if("rejected")).first()
    assert right >= 0.98 * n and rejected <= 0.01 * n
    assert 0 <= got.agg(F.min("score")).first()[0] and got.agg(F.max("score")).first()[0] <= 1


def test_language_edges(spark, real):
    model = langid.train(real, F.lit(True))
    rows = [(1, None, "en", 9.0, 1), (2, "", "en", 9.0, 1), (3, "12 ½ !!", None, 9.0, 1), (4, "日本", None, 9.0, 1), (5, "the and of", "de", 9.0, 1), (5, "the and of", "de", 9.0, 1), (6, "der und " * 20000, None, 9.0, 1)]
    got = langid.predict(spark.createDataFrame(rows, DOCS), model)
    assert got.columns == ["doc_id", "text", "lang", "size", "lang_pred", "score", "rejected"]
    by = {r.doc_id: r for r in got.collect()}
    assert all(by[i].lang_pred == "und" and by[i].rejected and by[i].score == 0 for i in (1, 2, 3))
    assert by[4].lang_pred in model.languages and by[5].lang_pred == "en" and by[6].lang_pred == "de"
    assert langid.predict(spark.createDataFrame([], DOCS), model).collect() == []
    nothing = langid.train(real, F.lit(False))
    assert {r.lang_pred for r in langid.predict(spark.createDataFrame(rows, DOCS), nothing).collect()} == {"und"}


def test_quality_held_out_and_measures(spark, real):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(real, labels.where("doc_id % 3 != 0"))
    got = quality.judge(real, model).join(labels, "doc_id").where("doc_id % 3 = 0 and not base_failed")
    wrong = got.where(F.col("kept") != (F.col("quality") == 1)).count()
    assert wrong <= 0.03 * got.count()


def test_quality_edges(spark, real):
    schema = "doc_id long, text string, kept string"
    text = "a b c a b c\n\nx\nx\n x\n#$ é" + "\t\n" + "w " * 3
    rows = [(1, None, "z"), (2, "", "z"), (3, text, "z"), (4, "one two three four five six seven eight nine ten " * 10, "z"), (5, " ".join(f"word{i}" for i in range(60)), "z")]
    none = quality.train(spark.createDataFrame([], schema), spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    by = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, schema), none).collect()}
    m = lambda i: tuple(by[i][c] for c in quality.MEASURES)
    assert m(1) == m(2) == (0, 0, 0, 0, 0) and by[1].base_failed and not by[1].kept
    assert m(3) == (14, 15, 2, 1, 6)
    assert m(4)[4] == 100 and by[4].base_failed
    assert m(5)[4] == 0 and by[5].kept and not by[5].base_failed
    assert quality.judge(spark.createDataFrame([], schema), none).collect() == []


def _brute_top(rows, k):
    out = set()
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    ints = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in good]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for q in sorted({i for i, _ in ints if i % 5 == 0}):
        qv = min(v for i, v in ints if i == q)
        best = sorted((-dot(qv, v), i) for i, v in ints if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("blocks", [(512, 8192), (7, 40)])
def test_top_k(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", blocks[1])
    monkeypatch.setattr(topk, "SAMPLE_ROWS", 60)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.3, 8).tolist()) for i in range(300)]
    rows += [(300 + i, rows[10][1]) for i in range(30)] + [(5, rows[7][1]), (400, None), (405, []), (410, [1.0, None] + [0.0] * 6), (415, [float("nan")] * 8), (420, [float("inf")] * 8), (None, rows[1][1]), (425, [0.0] * 8), (430, rows[3][1][:3])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(4)
    got = {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 5 == 0, k=20).collect()}
    assert got == _brute_top(rows, 20)


def test_top_k_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 5 == 0).collect()] == [(0, 1, 1, 64 * 128)]
    assert topk.top_k(df.limit(0), F.lit(True)).collect() == []


@pytest.mark.parametrize("size", [3e4, 1e6])
def test_top_k_of_large_components(spark, monkeypatch, size):
    """Scores past 24 and past 53 bits."""
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 50)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(0, size, 8).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 5 == 0, k=7).collect()} == _brute_top(rows, 7)


def test_top_k_of_clusters_and_too_large(spark, monkeypatch):
    """Far clusters, where most pairs of blocks are dropped."""
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 20)
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 40, (6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.05, 8)).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 5 == 0, k=20).collect()} == _brute_top(rows, 20)
    with pytest.raises(ValueError, match="64 bits"):
        topk.top_k(spark.createDataFrame([(0, [1e9] * 8)], "vec_id long, embedding array<double>"), F.lit(True))


def _check_shards(rows, n):
    assert {r.shard for r in rows} <= set(range(n))
    for s in range(n):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


def test_shards(spark, real):
    dims = {"length": F.length("text"), "id": F.col("doc_id")}
    rows = kd_shard.kd_shards(real, dims, shards=7).collect()
    _check_shards(rows, 7)
    weight = [sum(r.size for r in rows if r.shard == s) for s in range(7)]
    assert max(weight) - min(weight) <= 2 * max(r.size for r in rows)
    text = {r.doc_id: r.text for r in real.collect()}
    assert all(r.size == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in rows)


def test_shards_edges(spark):
    same = [(i, "same text", None, 1.0, 5) for i in range(100)] + [(None, None, None, 1.0, 5), (7, "", None, 1.0, 5), (7, "x" * 500, None, 1.0, 5)]
    rows = kd_shard.kd_shards(spark.createDataFrame(same, DOCS), {"length": F.length("text")}, shards=4).collect()
    assert len(rows) == 103
    _check_shards(rows, 4)
    weight = [sum(r.size for r in rows if r.shard == s) for s in range(4)]
    assert max(weight) - min(weight) <= 508
    few = kd_shard.kd_shards(spark.createDataFrame(same[:3], DOCS), {"length": F.length("text")}, shards=24).collect()
    assert len(few) == 3
    _check_shards(few, 24)
    assert kd_shard.kd_shards(spark.createDataFrame([], DOCS), {"length": F.length("text")}, shards=24).collect() == []
    by_size = kd_shard.kd_shards(spark.createDataFrame(same, DOCS), {"length": F.length("text")}, target_bytes=600).collect()
    assert len({r.shard for r in by_size}) == 4
