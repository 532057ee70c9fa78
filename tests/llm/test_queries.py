"""The registered queries over a whole small table, their columns against plain versions."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from tessera.llm import queries, secret_scan, substring
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def _rows(spark, name, types):
    df = queries.QUERIES[name](spark, SF)
    assert {c: dict(df.dtypes)[c] for c in types} == types
    return df.collect()


def test_op1(spark, texts):
    types = dict(doc_id="bigint", size="bigint", text_crc32="bigint", law="string", shard="int", slot="bigint", grown_shard="int")
    rows = _rows(spark, "op1_kd_shards", types)
    assert {(r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in rows} == {(d, len(t.encode()) + 8, zlib.crc32(t.encode()), "bytes", None) for d, t in texts.items()}
    weight = [0] * 24
    for r in rows:
        weight[r.shard] += r.size
    assert max(weight) - min(weight) <= 2 * max(r.size for r in rows)
    for s in range(24):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_op2(spark, texts):
    rows = _rows(spark, "op2_language_id", dict(doc_id="bigint", held_out="boolean", lang_pred="string", score="double"))
    assert {(r.doc_id, r.held_out) for r in rows} == {(d, zlib.crc32(str(d).encode()) % 4 == 2) for d in texts}
    for r in rows:
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (not any(map(str.isalpha, texts[r.doc_id])))


@pytest.fixture(scope="module")
def bpe():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


def _crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_op3(spark, texts, bpe):
    types = {c: "bigint" for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
    got: dict = {}
    rows = _rows(spark, "op3_packing", types)
    for r in rows:
        assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0
        got.setdefault(r.doc_id, []).append(r)
    assert len({r.sequence_id for r in rows}) == len(rows) and got.keys() == texts.keys()
    for d, pieces in got.items():
        ids, at = [*bpe(texts[d]), 1], 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), _crc(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)


def test_op4(spark, texts):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {(d, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids))) for d, t in texts.items() for ids in [lib.encode(t)]}
    rows = _rows(spark, "op4_sentencepiece", dict(doc_id="bigint", n_tokens="bigint", ids_sha256="string", decoded_sha256="string"))
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == want


def test_op5(spark, texts, bpe):
    want, at = set(), 0
    for d in sorted(texts):
        ids = [*bpe(texts[d]), 0]
        want.add((d, at, len(ids), _crc(ids)))
        at += len(ids)
    rows = _rows(spark, "op5_token_store", {c: "bigint" for c in ("doc_id", "start", "n_tokens", "ids_crc32")})
    assert {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows} == want


def test_op8(spark, texts):
    types = {c: "bigint" for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")} | {"base_failed": "boolean", "kept": "boolean"}
    rows = _rows(spark, "op8_quality_rules", types)
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id]
        words, lines = brute.WORD.findall(t), [x for x in t.split("\n") if brute.WORD.search(x)]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        repeated = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)} if len(words) < 3000 else None
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)))
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert repeated is None or r.n_repeat_words == len(repeated)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)


def test_columns_of_any_name(spark):
    names = ["id", "kinds", "kinds_", "text_key", "places", "text_", "ID2"]
    schema = "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)
    rows = [(1, "password = abcdef1234", *names), (2, None, *names), (3, "", *names)]
    docs = spark.createDataFrame(rows, schema)
    found = secret_scan.find_secrets(docs)
    assert found.columns == [*docs.columns, "secrets"] and {r.doc_id: len(r.secrets) for r in found.collect()} == {1: 1, 2: 0, 3: 0}
    kept = substring.remove_repeats(docs)
    assert kept.columns == [*docs.columns, "n_words", "n_removed", "kept"]
    assert sorted(tuple(r)[2 : 2 + len(names)] for r in kept.collect()) == [tuple(names)] * 3


def test_very_long_texts(spark):
    long = " ".join(f"word{i % 70_000}" for i in range(300_000))  # 2.9 MB
    docs = spark.createDataFrame([(1, long + " token: 0123456789"), (2, "short text")], "doc_id long, text string")
    assert [len(r.secrets) for r in secret_scan.find_secrets(docs).orderBy("doc_id").collect()] == [1, 0]
    got = {r.doc_id: r for r in substring.remove_repeats(docs).collect()}
    assert (got[1].n_words, got[1].n_removed) == (300_002, 300_000) and got[2].n_removed == 0
