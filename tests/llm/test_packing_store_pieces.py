import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import packing, pieces, store
from tessera.llm._ids import byte_bpe, encoder
from tessera.llm._util import new_path

SCHEMA = "doc_id long, text string, length string, start int"
TEXTS = [
    "Plain words, and more words.",
    "",
    None,
    "two  spaces\n\n and\ttabs \r\n",
    "déjà vu — „Größe“ 12½ €5",
    "日本語 текст 🙂 á ​",
    "<|endoftext|> in the text",
    "same text",
    "same text",
    "word " * 7000,
    "x" * 5000,
    "▁ marks ▁▁ and  spaces   ",
    " lead",
    "<s> </s> <unk> <0x0A>",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(3, "another text under a known id", "clash", 2), (None, "no id", "clash", 3)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def ids():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_library(ids):
    encode = encoder(*byte_bpe())
    rng = np.random.default_rng(1)
    chars = list("abcXYZ  \n\t'sé0½.,!?-_<|>") + ["'ll", " €", "—", " ", "Ḁ", "字"]
    texts = TEXTS + ["".join(rng.choice(chars, 60)) for _ in range(400)]
    for t in texts:
        assert encode(t).tolist() == ids(t)


@pytest.mark.parametrize("n", [0, 1, 2, 7, 64, 100, 2047, 2048, 2049, 5000])
def test_binary_lengths(n):
    got = packing.binary_lengths(n, 2048)
    assert sum(got) == n and got == sorted(got, reverse=True) and all(x & (x - 1) == 0 for x in got)


def test_packing(docs, ids):
    rows = packing.pack(docs).collect()
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    assert [r.length for r in sorted(rows, key=lambda r: r.sequence_id)] == sorted((r.length for r in rows), reverse=True)
    whole = sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    got: dict = {}
    for r in sorted(rows, key=lambda r: r.start):
        assert r.offset == 0 and len(r.ids) == 4 * r.length and r.length & (r.length - 1) == 0
        got.setdefault((str(r.doc_id), r.doc_tokens), []).append(r.ids)
    assert len({k[0] for k in got}) == len({k for k, _ in whole})
    for d, t in whole:
        want = np.asarray([*ids(t), 1], "<u4").tobytes()
        if d not in ("3",):
            assert b"".join(got[d, len(want) // 4]) == want
    assert sum(r.length for r in rows) == sum(len(ids(t)) + 1 for _, t in whole)


def test_packing_empty(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).collect() == []


def test_store_round_trip(spark, docs, ids):
    path = new_path(spark, "store")
    store.write_store(docs, path)
    rows = sorted(store.read_store(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in docs.collect()), key=lambda d: -1 if d is None else d)
    at = 0
    for r in rows:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    want = sorted(np.asarray([*ids(r.text), 0], "<u4").tobytes() for r in docs.collect())
    assert sorted(bytes(r.ids) for r in rows) == want
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("hash").distinct().count()
    homes = {(r.hash, r.home) for r in chunks.collect()}
    held = {(h, r.row) for r in spark.read.parquet(f"{path}/recipes").collect() for h in r.recipe}
    assert held == homes | {(r.hash, r.row) for r in spark.read.parquet(f"{path}/guests").collect()}


def test_store_finds_damage(spark, docs):
    path = new_path(spark, "store")
    store.write_store(docs, path)
    chunks = spark.read.parquet(f"{path}/chunks")
    kept = [tuple(r) for r in chunks.collect()][1:]
    spark.createDataFrame(kept, chunks.schema).write.mode("overwrite").parquet(f"{path}/chunks2")
    with pytest.raises(Exception, match="missing or damaged"):
        other = new_path(spark, "store")
        for part in ("recipes", "guests", "manifest"):
            spark.read.parquet(f"{path}/{part}").write.parquet(f"{other}/{part}")
        spark.read.parquet(f"{path}/chunks2").write.parquet(f"{other}/chunks")
        store.read_store(spark, other).collect()
    other = new_path(spark, "store")
    spark.read.parquet(f"{path}/recipes").where("doc_id != 4").write.parquet(f"{other}/recipes")
    spark.read.parquet(f"{path}/manifest").write.parquet(f"{other}/manifest")
    with pytest.raises(ValueError, match="manifest"):
        store.verify_manifest(spark, other)


def test_store_empty(spark):
    path = new_path(spark, "store")
    store.write_store(spark.createDataFrame([], SCHEMA), path)
    assert store.read_store(spark, path).collect() == []


def test_chunks_survive_an_insertion():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 50000, 20000).astype("<u2")
    b = np.concatenate([a[:5000], rng.integers(0, 50000, 7).astype("<u2"), a[5000:]])

    def chunks(x):
        ends = store.cut_points(x)
        assert ends[-1] == len(x) and all(p < q for p, q in zip(ends, ends[1:]))
        return {x[i:j].tobytes() for i, j in zip([0, *ends], ends)}

    assert len(chunks(a) & chunks(b)) > 0.8 * len(chunks(a))


def test_merkle_depends_on_order():
    a, b, c = (hashlib.sha256(x).digest() for x in (b"a", b"b", b"c"))
    assert len({store.merkle([a, b, c]), store.merkle([b, a, c]), store.merkle([a, b]), store.merkle([])}) == 4


def test_pieces_match_the_library(docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    rows = pieces.encode_documents(docs).collect()
    assert len(rows) == docs.count()
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    for r in rows:
        options = [t or "" for d, t in texts if d == r.doc_id]
        text = next(t for t in options if lib.encode(t) == list(r.ids))
        assert r.decoded == lib.decode(list(r.ids))
        raw = text.encode()
        assert all(0 <= b <= e <= len(raw) for b, e in zip(r.begins, r.ends))
        assert (r.ends[-1] if r.ends else 0) == len(raw) and list(r.begins[1:]) == list(r.ends[:-1])
        for i, b, e in zip(r.ids, r.begins, r.ends):
            if not lib.is_byte(i):
                assert raw[b:e].decode().replace(" ", "▁") in lib.id_to_piece(i)


def test_pieces_of_odd_texts():
    m = pieces.PieceModel(P.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(4)
    pool = list("abc  ▁▁éüß\n\t0123日本語한국😀\x00\u200b\u0301ÀñΩж.,;!-_=+") + ["<s>", "</s>", "<0x41>", "the ", " and"]
    texts = ["".join(rng.choice(pool, rng.integers(0, 40))) for _ in range(3000)]
    texts += ["".join(rng.choice(list("abcdefgh01"), 200_000)), " " * 5000, "é" * 3000]
    assert [m.encode(t)[0].tolist() for t in texts] == m.lib.encode(texts)


def test_merging_without_a_library():
    kinds = dict(normal=1, unknown=2, unused=5)
    rows = [("<unk>", 0.0, kinds["unknown"]), ("▁", -9.0, 1), *((c, -10.0, 1) for c in "abc"), ("ab", -1.0, 1), ("bc", -2.0, 1), ("abc", -3.0, kinds["unused"]), ("▁ab", -4.0, 1)]
    v = pieces.Vocabulary(rows)
    assert v.merged("▁ab") == ["▁ab"] and v.merged("▁abc") == ["▁", "ab", "c"] and v.merged("bcab") == ["bc", "ab"] and v.merged("abcabc") == ["ab", "c", "ab", "c"]
    ids, sizes = v.encode("▁ab" + "日本" + "a")
    assert ids.tolist() == [8, 0, 4 - 2] and sizes.tolist() == [5, 6, 1]
    with pytest.raises(ValueError, match="user-defined"):
        pieces.Vocabulary([("x", 0.0, 4)])


def _trie(mapping: dict[bytes, bytes]) -> bytes:
    """A compiled character map for keys of one or two bytes, laid out by hand: every node has a block of 256 units."""
    units, strings, places = [0] * (256 * 8), b"", {}
    for k, v in mapping.items():
        places[k] = len(strings)
        strings += v + b"\0"
    blocks, free = {b"": 256}, 512
    for k in mapping:
        for i in range(1, len(k) + 1):
            if k[:i] not in blocks:
                blocks[k[:i]] = free
                free += 256
    units[0] = (256 ^ 0) << 10
    for prefix, block in blocks.items():
        if prefix:
            at = blocks[prefix[:-1]] ^ prefix[-1]
            units[at] = ((block ^ at) << 10) | prefix[-1] | (256 if prefix in mapping else 0)
            if prefix in mapping:
                units[block] = places[prefix] | 1 << 31
    raw = np.asarray(units, "<u4").tobytes()
    return len(raw).to_bytes(4, "little") + raw + strings


def test_longest_prefix_normalisation():
    m = pieces.CharMap(_trie({b"a": b"1", b"ab": b"xyz", b"\xc3\xa9": b"e"}))
    assert m.longest(b"abc", 0) == (2, b"xyz") and m.longest(b"ac", 0) == (1, b"1") and m.longest(b"c", 0) is None
    model = pieces.PieceModel.__new__(pieces.PieceModel)
    model.map, model.dummy_prefix, model.squeeze, model.escape = m, True, True, True
    out, align = model.normalise("  abé  c ".encode())
    mark = "▁".encode()
    assert out == mark + b"xyze" + mark + b"c"
    assert align.tolist() == [2, 2, 2, 2, 2, 2, 4, 6, 6, 6, 8, 9]


def test_store_crc_of_the_query(spark, docs, ids):
    path = new_path(spark, "store")
    store.write_store(docs.where("doc_id = 4"), path)
    got = store.read_store(spark, path).select(F.crc32("ids").alias("c")).first().c
    assert got == zlib.crc32(np.asarray([*ids(TEXTS[4]), 0], "<u4").tobytes())
