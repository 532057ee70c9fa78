"""Packing by power-of-two decomposition.

Every document is cut into pieces whose lengths are powers of two, the largest first: as many full
pieces of `length` as fit, then the binary digits of the rest. A piece is a sequence of its own, so no
sequence crosses documents and none needs padding. Pieces of equal length form a bucket, and sequence
ids run through the buckets from the longest to the shortest.

Defined cases: null or empty text is a document of the end id alone; repeated rows are documents of
their own; a very long text is cut into as many pieces as it needs; an empty table gives no row; columns
other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm._ids import byte_bpe, encoder
from tessera.llm._util import bounded_batches, stored

PIECE_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, bucket int, part int, place long"
BROADCAST_ROWS = 1_000_000  # first numbers of (bucket, part) are broadcast up to here, else shuffled


def binary_lengths(n: int, longest: int) -> list[int]:
    """Powers of two that sum to n, descending, none over `longest`."""
    out = [longest] * (n // longest)
    rest = n % longest
    return out + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def split_documents(docs: DataFrame, longest: int = 2048, end_id: int = 1, tokenizer: tuple | None = None) -> DataFrame:
    """One row per piece with its ids (binary, little-endian unsigned 32-bit).

    `bucket` is log2 of the length; `place` numbers the pieces of a bucket inside the task `part`.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    bounded_batches(docs.sparkSession)
    args = tokenizer or byte_bpe()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(*args), np.asarray([end_id], "<u4")
        part, places = TaskContext.get().partitionId(), [0] * longest.bit_length()
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            held = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([encode(text.as_py()), end]).astype("<u4")
                raw, at = ids.tobytes(), 0
                for size in binary_lengths(len(ids), longest):
                    bucket = size.bit_length() - 1
                    for col, value in zip(cols, (doc, at, size, raw[4 * at : 4 * (at + size)], len(ids), bucket, part, places[bucket]), strict=True):
                        col.append(value)
                    places[bucket] += 1
                    at += size
                held += len(raw)
                if held > 8_000_000:
                    yield _batch(cols)
                    cols, held = [[] for _ in range(8)], 0
            if cols[0]:
                yield _batch(cols)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECE_SCHEMA)


def _batch(cols: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "bucket", "part", "place"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def bucket_sequences(pieces: DataFrame) -> DataFrame:
    """Adds `sequence_id` (gapless; longest bucket first) and `offset` (0: a piece fills its sequence).

    The pieces are written once and not sorted: a bucket's numbers run through the parts, so only the
    counts of (bucket, part) are added up.
    """
    rows = stored(pieces, "pieces")
    counts = rows.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    longer = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    buckets = counts.groupBy("bucket").agg(F.sum("n").alias("n")).select("bucket", F.coalesce(F.sum("n").over(longer), F.lit(0)).alias("lead"))
    first = counts.select("bucket", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")).join(F.broadcast(buckets), "bucket")
    first = stored(first.select("bucket", "part", (F.col("lead") + F.col("before")).alias("first")), "firsts")
    if first.count() <= BROADCAST_ROWS:
        first = F.broadcast(first)
    out = rows.join(first, ["bucket", "part"]).withColumn("sequence_id", F.col("first") + F.col("place"))
    return out.withColumn("offset", F.lit(0).cast("long")).drop("first", "part", "place")


def pack(docs: DataFrame, longest: int = 2048, end_id: int = 1, tokenizer: tuple | None = None) -> DataFrame:
    """Pieces with ids, numbered."""
    return bucket_sequences(split_documents(docs, longest, end_id, tokenizer))
