import random
import zlib

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tessera.llm import langid
from tests.llm import brute


def test_stages_against_brute_force(spark, tmp_path):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = [tuple(r[c] for c in cp.COLUMNS) for r in real]
    r = random.Random(4)
    for i in range(12):
        words = rows[i][1].split(" ")
        if len(words) > 60:
            words[r.randrange(len(words))] = "changed"
        rows.append((1000 + i, " ".join(words), *rows[i][2:]))
    rows += [(2000, None, None, "s", None), (2001, "", "en", "s", 0), (2002, "123 456", "en", "s", 7), (2003, rows[0][1] + " token=abcdef123", "en", "s", 1), rows[5]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    model = langid.train(docs, F.coalesce(langid.fold() != 2, F.lit(True)))
    now = [(d, t) for d, t, *_ in rows if not model.predict(t)[2]]
    assert len(now) >= len(rows) - 4
    first, kept = {(d, c) for d, _, c in brute.jaccard(now, 5, 80) if d == c}, []
    for d, t in sorted(now):
        if (d, d) in first and d not in {k for k, _ in kept}:
            kept.append((d, t))
    after = [(d, k if n else t) for (d, t), (_, _, n, k) in zip(kept, brute.substring(kept, 35))]
    after = [(d, brute.masked(t)) for d, t in after]
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {d: zlib.crc32(np.asarray([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for d, t in after}

    out: dict = {}
    for p in sorted(cp.run(spark, str(tmp_path)).collect(), key=lambda p: p.start):
        out[p.doc_id] = out.get(p.doc_id, b"") + bytes(p.ids)
    assert {d: zlib.crc32(b) for d, b in out.items()} == want


def test_stage_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert tuple(out.columns) == cp.COLUMNS, name
        assert out.dtypes == docs.select(*cp.COLUMNS).dtypes


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, "/root/testdata/sf0.001").collect() == []
