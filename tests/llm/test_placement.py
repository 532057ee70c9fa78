"""The k-d tree's placement against a plain recursive split, and the quality verdict against plain sums."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import kd_shard, quality
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_shards_are_boxes_of_a_tree(spark):
    """Equal texts stay together, and shards can be parted by cuts in one dimension at a time, over and over, as leaves of a k-d tree can."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    dims = {"length": F.octet_length(text), "wide": F.octet_length(text) - F.length(text)}
    got = kd_shard.kd_shards(docs, dims, shards=8).join(docs.select("doc_id", "text"), "doc_id").collect()
    places = [((len((r.text or "").encode()), len((r.text or "").encode()) - len(r.text or "")), r.shard) for r in got]

    def parted(rows):
        """Whether some dimension parts the shards in two groups, of which one lies before the other or touches it, and so do these in turn."""
        shards = {s for _, s in rows}
        if len(shards) <= 1:
            return True
        for d in (0, 1):
            ends = sorted((min(p[d] for p, t in rows if t == s), max(p[d] for p, t in rows if t == s), s) for s in shards)
            for i in range(1, len(ends)):
                if max(e[1] for e in ends[:i]) <= min(e[0] for e in ends[i:]):
                    first = {e[2] for e in ends[:i]}
                    if parted([r for r in rows if r[1] in first]) and parted([r for r in rows if r[1] not in first]):
                        return True
        return False

    assert parted(places)
    weight = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    assert max(weight) <= 1.35 * min(weight)
    by_text = {}
    for r in got:
        by_text.setdefault(zlib.crc32((r.text or "").encode()), set()).add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())


def test_verdict_against_plain_sums(spark):
    """kept and probability from their definition: means of weights over n-grams taken by slicing."""
    from tessera.llm._linear import hashed
    from tessera.llm._words import Words, mix64

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), epochs=3)
    for r in quality.judge(docs.where("doc_id < 60"), model).collect():
        text = r.text or ""
        words = brute.WORD.findall(text)
        hashes = [int(Words([w.encode()]).hash[0]) for w in words]
        features = [int(hashed(np.asarray([h], np.uint64), quality.WORD_BITS)[0]) for h in hashes]
        for a, b in zip(range(len(words)), range(1, len(words))):
            pair = Words([f"{words[a]} {words[b]}".encode()]).hash
            if words[a] == words[b]:
                value = np.asarray([quality._EQUAL], np.uint64)
            else:
                from tessera.llm._words import runs

                value = mix64(runs(pair, 2))
            features.append(int(hashed(value, quality.WORD_BITS)[0]))
        plain = text.translate(quality._TO_SPACE)
        grams = []
        for n in quality.ORDERS:
            for i in range(len(plain) - n + 1):
                piece = plain[i : i + n]
                if " " not in piece[1:-1]:
                    h = 2166136261 + 97 * n
                    for c in piece:
                        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
                        h ^= h >> 15
                    grams.append(((h * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - quality.CHAR_BITS))
        z = model.offset + (sum(float(model.words[k]) for k in features) / len(features) if features else 0) + (sum(float(model.grams[k]) for k in grams) / len(grams) if grams else 0)
        p = 1 / (1 + np.exp(-np.clip(model.slope * z + model.shift, -40, 40)))
        assert r.probability == pytest.approx(p, abs=2e-3)
        assert r.kept == (not r.base_failed and r.probability >= quality.KEEP_FROM)
