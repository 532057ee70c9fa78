"""A content-addressed store of token ids.

Each document's id stream (its ids and an end id) is cut where a rolling hash of the last 16 ids
meets a mask, so equal passages give equal chunks wherever they stand. A store is a folder:

- `chunks`: hash (blake2b-128 of the ids), home (the row that holds it first), n, payload (the ids,
  little-endian, 16 bits wide when the vocabulary allows, else 32, in a zstd frame). Each different chunk
  is there once.
- `recipes`: documents in ascending doc_id order: row, doc_id, start (ids of all documents before),
  n_tokens, the list of chunk hashes, and the Merkle root over that list.
- `guests`: (hash, row) of every other row that holds a chunk.
- `manifest`: a digest over the roots of every run of recipes, over the runs of every part, and over all.

Reading sends each chunk to its home and, joined with `guests`, to the other rows that hold it, so that
most payloads are shuffled once. Every payload is checked against its hash and every document against its
root; any difference is an error.

Defined cases: null or empty text is a document of the end id alone; rows that share a doc_id are
documents of their own, in the order read; a very long text has as many chunks as it needs, and only its
own are held together; an empty table gives an empty store; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._ids import byte_bpe, encoder
from tessera.llm._util import drop_path, new_path, ordered, running_total

_STAGED = "kind int, rid long, doc_id long, n_tokens long, recipe array<binary>, root binary, hash binary, n int, payload binary"
_GEAR = np.random.default_rng(5).integers(0, 1 << 32, 1 << 16, dtype=np.uint32)  # of an id, what it adds to the rolling hash
_RUN = 4096  # recipes under one digest of the manifest
_SEEN = 200_000  # chunk hashes a task remembers so as not to stage a payload twice
BROADCAST_ROWS = 1_000_000  # staged repeats are broadcast up to here (under 64 MB), else shuffled


def cut_points(ids: np.ndarray, bits: int = 9, least: int = 64, most: int = 4096) -> list[int]:
    """Ends of the chunks of one id stream: content decides, between `least` and `most` ids each."""
    h = _GEAR[ids if ids.dtype.itemsize == 2 else (ids ^ (ids >> 16) * np.uint32(40503)) & 0xFFFF]
    for step in (1, 2, 4, 8):
        longer = h.copy()
        longer[step:] += h[:-step] << np.uint32(step)
        h = longer
    marks = (np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1).tolist()
    ends, last, n = [], 0, len(ids)
    for m in [*marks, n]:
        while m - last > most:
            last += most
            ends.append(last)
        if m - last >= least or (m == n and m > last):
            ends.append(m)
            last = m
    return ends


def merkle(leaves: list[bytes]) -> bytes:
    """Root over hashes: neighbours are hashed in pairs, an odd last one moves up."""
    level = list(leaves)
    while len(level) > 1:
        pairs = [blake2b(level[i] + level[i + 1], digest_size=16).digest() for i in range(0, len(level) - 1, 2)]
        level = pairs + level[len(pairs) * 2 :]
    return level[0] if level else blake2b(b"", digest_size=16).digest()


def write_store(docs: DataFrame, path: str, end_id: int = 0, tokenizer: tuple | None = None) -> None:
    """Writes the store of docs into the folder `path`."""
    spark = docs.sparkSession
    args = tokenizer or byte_bpe()

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, pack = encoder(*args), set(), zstandard.ZstdCompressor(level=1).compress
        width = "<u2" if max(encode.size, end_id + 1) <= 65536 else "<u4"
        end = np.asarray([end_id], "<u4")
        for batch in batches:
            rows: list[tuple] = []
            copies: dict[str | None, tuple] = {}  # of this batch
            held = 0
            for rid, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if text in copies:
                    rows.append((0, rid, doc, *copies[text], None, None, None))
                    continue
                ids = np.concatenate([encode(text), end]).astype(width)
                hashes, own, at = [], set(), 0
                for stop in cut_points(ids):
                    raw = ids[at:stop].tobytes()
                    key = blake2b(raw, digest_size=16).digest()
                    hashes.append(key)
                    if key not in seen and key not in own:
                        (seen if len(seen) < _SEEN else own).add(key)
                        rows.append((1, rid, None, None, None, None, key, stop - at, pack(raw)))
                        held += len(raw)
                    at = stop
                copies[text] = (len(ids), hashes, merkle(hashes))
                rows.append((0, rid, doc, *copies[text], None, None, None))
                if held > 8_000_000:
                    yield _staged(rows)
                    rows, held = [], 0
            if rows:
                yield _staged(rows)

    work = new_path(spark, "staged")
    source = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    source.mapInArrow(chunk, _STAGED).write.partitionBy("kind").parquet(f"{work}/rows")
    rows = spark.read.schema(_STAGED).parquet(f"{work}/rows")
    chunks, docs_ = rows.where("kind = 1").select("rid", "hash", "n", "payload"), rows.where("kind = 0").select("rid", "doc_id", "n_tokens", "recipe", "root")
    _once(chunks, f"{work}/repeats").write.parquet(f"{path}/chunks")
    placed = ordered(docs_, ["doc_id", "rid"], f"{work}/recipes")
    recipes = running_total(placed, "n_tokens", "start").select("_part", "_idx", F.col("rid").alias("row"), "doc_id", "start", "n_tokens", "recipe", "root")
    recipes.write.parquet(f"{path}/recipes")
    _guests(docs_).write.parquet(f"{path}/guests")
    _digests(spark.read.schema(recipes.schema).parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")
    drop_path(spark, work)


def _once(chunks: DataFrame, path: str) -> DataFrame:
    """(hash, home, n, payload) of the first staged row of each hash; what is compared and sent are the keys of the others."""
    spark = chunks.sparkSession
    first = chunks.groupBy("hash").agg(F.min("rid").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1")
    chunks.select("hash", "rid").join(first, "hash").where("rid > first").select("hash", "rid").write.parquet(path)
    again = spark.read.schema("hash binary, rid long").parquet(path)
    again = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    return chunks.join(again, ["hash", "rid"], "left_anti").select("hash", F.col("rid").alias("home"), "n", "payload")


def _guests(recipes: DataFrame) -> DataFrame:
    """(hash, row): rows that hold a chunk whose home is an earlier one. A chunk's home is the first row that holds it: no row before has staged it."""
    held = recipes.select("rid", F.explode(F.array_distinct("recipe")).alias("hash"))
    first = held.groupBy("hash").agg(F.min("rid").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").select("hash", "first")
    return held.join(first, "hash").where("rid > first").select("hash", F.col("rid").alias("row"))


def _staged(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.int32(), pa.binary())
    names = ["kind", "rid", "doc_id", "n_tokens", "recipe", "root", "hash", "n", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _digests(recipes: DataFrame) -> DataFrame:
    """(part, n_docs, n_tokens, digest) for each part, and for part -1 over all parts."""

    def over(value: str, at: str) -> F.Column:
        return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, value))), lambda x: x[value]), ""), 256)

    rows = recipes.select(F.col("_part").alias("part"), F.floor(F.col("_idx") / _RUN).alias("run"), F.col("_idx").alias("at"), F.hex("root").alias("leaf"), "n_tokens")
    sums = [F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")]
    runs = rows.groupBy("part", "run").agg(over("leaf", "at").alias("digest"), F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    parts = runs.groupBy("part").agg(over("digest", "run").alias("digest"), *sums)
    top = parts.agg(over("digest", "part").alias("digest"), *sums).select(F.lit(-1).alias("part"), "digest", "n_docs", "n_tokens")
    return parts.unionByName(top)


def verify_manifest(spark: SparkSession, path: str) -> None:
    """Fails unless the digests of the recipes are those of the manifest."""
    now = _digests(spark.read.parquet(f"{path}/recipes"))
    then = spark.read.parquet(f"{path}/manifest").select("part", F.col("digest").alias("was"))
    if now.join(then, "part", "full").where("not digest <=> was").take(1):
        raise ValueError("the recipes differ from the manifest")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document put together again from verified chunks; ids are little-endian unsigned 32-bit."""
    verify_manifest(spark, path)
    recipes, chunks, guests = (spark.read.parquet(f"{path}/{t}") for t in ("recipes", "chunks", "guests"))
    few = guests.count() <= BROADCAST_ROWS
    sent = chunks.join(F.broadcast(guests) if few else guests, "hash").select("row", "hash", "n", "payload")
    parts = chunks.select(F.col("home").alias("row"), "hash", "n", "payload").union(sent)
    rows = recipes.select("row", "doc_id", "start", "n_tokens", "root", "recipe").unionByName(parts, allowMissingColumns=True)
    rows = rows.repartition("row").sortWithinPartitions("row", F.desc_nulls_last("start"))  # the recipe before the chunks
    return rows.mapInArrow(_assemble, "doc_id long, start long, n_tokens long, ids binary")


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    recipe, parts, done, held = None, {}, [], 0
    unpack = zstandard.ZstdDecompressor().decompress

    def close() -> None:
        if recipe is None:
            return
        _, doc, start, total, root, hashes = recipe
        missing = next((h for h in hashes if h not in parts), None)
        if missing is not None:
            raise ValueError(f"a chunk of document {doc} is missing or damaged")
        ids = b"".join(parts[h] for h in hashes)
        if merkle(hashes) != root or len(ids) != 4 * total:
            raise ValueError(f"document {doc} can't be rebuilt")
        done.append((doc, start, total, ids))

    for batch in batches:
        for i, (row, start) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            if start is not None:
                close()
                recipe, parts = [batch.column(c)[i].as_py() for c in range(6)], {}
                held += 4 * recipe[3]
                if held > 8_000_000 and done:
                    yield _docs(done)
                    done.clear()
                    held = 0
                continue
            key, n, raw = (batch.column(c)[i].as_py() for c in (6, 7, 8))
            raw = unpack(raw)
            if recipe is None or recipe[0] != row or blake2b(raw, digest_size=16).digest() != key:
                raise ValueError(f"a chunk of row {row} is missing or damaged")
            parts[key] = raw if len(raw) == 4 * n else np.frombuffer(raw, "<u2").astype("<u4").tobytes()
    close()
    if done:
        yield _docs(done)


def _docs(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "n_tokens", "ids"])
