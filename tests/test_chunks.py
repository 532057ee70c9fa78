"""Chunks of documentation items, in batch and as a stream, against a loop over the items."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import doc_index

SCHEMA = "category string, item_id long, bytes long, body string"


def _plain(items, most_items, most_bytes):
    out, now, chunk, n, held = [], object(), 1, 0, 0
    for category, item, size, body in sorted(items, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2])):
        if category != now:
            now, chunk, n, held = category, 1, 0, 0
        if n and (n >= most_items or held + size > most_bytes):
            chunk, n, held = chunk + 1, 0, 0
        n, held = n + 1, held + size
        out.append((category, item, size, chunk))
    return sorted(out, key=str)


def _items(rng, n, categories, sizes):
    return [(rng.choice(categories), rng.randrange(n // 2), rng.choice(sizes), f"b{i}") for i in range(n)]


@pytest.mark.parametrize(("most_items", "most_bytes", "block"), [(50, 51_200, 4096), (3, 40, 12), (7, 100, 28)])
def test_chunks(spark, monkeypatch, most_items, most_bytes, block):
    monkeypatch.setattr(doc_index, "BLOCK", block)
    rng = random.Random(block)
    items = _items(rng, 600, ["a"] * 6 + ["b", None, "c"], [0, 1, 5, 20, 41, 60_000])
    got = doc_index.chunked(spark.createDataFrame(items, SCHEMA), most_items, most_bytes)
    rows = got.collect()
    assert got.columns == ["category", "item_id", "bytes", "body", "chunk"] and sorted(r.body for r in rows) == sorted(i[3] for i in items)
    assert sorted(((r.category, r.item_id, r.bytes, r.chunk) for r in rows), key=str) == _plain(items, most_items, most_bytes)


def test_items_of_one_id(spark, tmp_path):
    """Two items of one id and one without category: as many come out as go in."""
    items = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), (None, 2, "z"), ("b", None, "w")], "category string, item_id long, body string")
    doc_index.write(items, f"{tmp_path}/out")
    back = doc_index.read(spark, f"{tmp_path}/out", "item_id long, body string")
    assert {(r.category, r.item_id, r.body) for r in back.collect()} == {tuple(r) for r in items.collect()} and back.count() == 4
    assert doc_index.chunked(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("cuts", [1, 2, 5])
def test_stream_equals_batch(spark, tmp_path, cuts):
    rng = random.Random(7)
    items = sorted((rng.choice(["a", "a", "b", "c"]), i, f"{'x' * rng.choice([0, 10, 900])}") for i in range(120))
    items.sort(key=lambda r: r[1])
    schema = "category string, item_id long, body string"
    bounds = sorted(rng.sample(range(1, 119), cuts - 1))
    for k, (a, b) in enumerate(zip([0, *bounds], [*bounds, 120], strict=True)):
        spark.createDataFrame(items[a:b], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in/{k:02d}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(f"{tmp_path}/in")
    for _ in range(2):  # started again, it finds nothing new
        doc_index.write_stream(stream, f"{tmp_path}/out", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    back = spark.read.schema(f"{schema}, chunk long").json(f"{tmp_path}/out")
    want = doc_index.chunked(doc_index.sized(spark.createDataFrame(items, schema))).drop("bytes")
    key = F.struct("item_id", "category", "body", "chunk")
    assert sorted(map(str, back.select(key.alias("k")).collect())) == sorted(map(str, want.select(key.alias("k")).collect()))
    assert want.agg(F.max("chunk")).first()[0] > 1
