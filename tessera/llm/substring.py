"""Exact substring dedup of windows of words by super-k-mer partitioning.

A window is `width` consecutive words of one text. Its minimiser is the least hash among its runs of
`mer` words. Consecutive windows with the same minimiser form a super-k-mer, which travels as one
string of words to the bucket of its minimiser; every window of the corpus is in exactly one
super-k-mer, and equal windows meet in one bucket. There the windows are sorted and counted. A word is
removed if some window that covers it starts at two or more places of the corpus.

Skew: equal super-k-mers of a task are sent once with their places, and runs of words found in many
documents of a bounded sample come last in the order of minimisers, so that a frequent phrase does not
draw every window around it to one bucket. The sample decides nothing but that order.

Places are kept by the digest of the text, since equal texts lose the same words. Windows are compared
by two 64-bit hashes.

Defined cases: null and empty texts have no words and an empty kept text; texts shorter than a window
keep every word; repeated rows count as documents of their own, so both copies lose their windows; of a
very long text every window counts; an empty table gives no row; other columns stay, whatever their
names, but for n_words, n_removed and kept, which are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._util import bounded_batches, free_name, partitions, stored, with_text
from tessera.llm._words import Words, groups, mix64, runs

SAMPLE_ROWS = 2000  # documents looked at for frequent runs of words
FREQUENT = 4096  # runs that the order of minimisers puts last, at most
BROADCAST_BYTES = 64 << 20  # places of removal are broadcast up to here, else shuffled
_BUCKETS = 4  # buckets for each shuffle partition, at least
_BUCKET_BYTES = 32 << 20  # text that a bucket is meant to hold at most
_FLUSH = 4 << 20  # bytes of text a task gathers before it sends its super-k-mers
_SLICE = 500
_BLANKS = bytes.maketrans(b"\t\n\v\f\r", b"     ")
_SECOND = np.uint64(0xD6E8FEB86659FD93)
_LAST = np.uint64(1 << 63)


def _least(x: np.ndarray, span: int) -> np.ndarray:
    """The least of each `span` neighbours."""
    out, have = x, 1
    while have < span:
        step = min(have, span - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def super_kmers(words: Words, width: int, mer: int, frequent: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text: its number, and minimiser, first and last window of its super-k-mers."""
    mers = mix64(runs(words.hash, mer)) >> np.uint64(1)
    if len(frequent):
        mers = np.where(np.isin(mers, frequent), mers | _LAST, mers)
    for t, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
        if b - a < width:
            continue
        least = _least(mers[a : b - mer + 1], width - mer + 1)
        cut = np.flatnonzero(least[1:] != least[:-1]) + 1
        first = np.concatenate([[0], cut])
        yield t, least[first], first, np.concatenate([cut, [len(least)]]) - 1


def frequent_runs(docs: DataFrame, mer: int) -> np.ndarray:
    """Hashes of runs of words that stand in over 1 % of a bounded sample of documents."""
    share = SAMPLE_ROWS / max(1, docs.count())
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(min(1.0, share) * 1_000_000)).select("text")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column(0).to_pylist() if t]
            for a, b in groups(texts):
                w = Words(texts[a:b])
                mers = mix64(runs(w.hash, mer)) >> np.uint64(1)
                for i, j in zip(w.first[:-1], w.first[1:], strict=True):
                    if j - i >= mer:
                        yield pa.RecordBatch.from_arrays([pa.array(np.unique(mers[i : j - mer + 1]).view(np.int64))], names=["h"])

    found = sample.mapInArrow(distinct, "h long").groupBy("h").count().where(F.col("count") >= SAMPLE_ROWS // 100)
    return np.asarray([r.h for r in found.orderBy(F.desc("count"), "h").limit(FREQUENT).collect()], np.int64).view(np.uint64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of which a task holds the texts as bytes."""
    for batch in batches:
        for a in range(0, batch.num_rows, _SLICE):
            yield batch.slice(a, _SLICE)


def repeated_places(docs: DataFrame, width: int = 35, mer: int = 4) -> DataFrame:
    """(text_key, places): for each text with repeated windows, the runs of words [begin, end) that they cover."""
    spark = docs.sparkSession
    whole = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    n_buckets = max(_BUCKETS * partitions(spark), -(-3 * whole // _BUCKET_BYTES))  # super-k-mers overlap, so they are longer than the texts
    frequent = frequent_runs(docs, mer)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        held: dict[int, dict[bytes, list]] = {}
        size = 0
        for part in _slices(batches):
            copies = Counter(part.column(0).to_pylist())
            keys, texts = [], []
            seen: set[bytes] = set()
            for key, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                if key not in seen:
                    seen.add(key)
                    keys.append(key)
                    texts.append(text.as_py().encode().translate(_BLANKS))
            for a, b in groups(texts):
                w = Words(texts[a:b])
                start, stop = w.start.tolist(), w.stop.tolist()
                for t, minimiser, first, last in super_kmers(w, width, mer, frequent):
                    at, key, n = int(w.first[t]), keys[a + t], copies[keys[a + t]]
                    for bucket, i, j in zip((mix64(minimiser) % np.uint64(n_buckets)).tolist(), first.tolist(), last.tolist(), strict=True):
                        body = w.buf[start[at + i] : stop[at + j + width - 1]]
                        entry = held.setdefault(bucket, {}).setdefault(body, [0, [], []])
                        entry[0] += n
                        entry[1].append(key)
                        entry[2].append(i)
                size += len(w.buf)
                if size > _FLUSH:
                    yield _packed(held, packer)
                    held, size = {}, 0
        if held:
            yield _packed(held, packer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now = None
        for batch in batches:
            for r, bucket in enumerate(batch.column(0).to_pylist()):
                if bucket != now and rows:
                    yield from _repeats(rows, width)
                    rows = []
                now = bucket
                rows.append([batch.column(c)[r].as_py() for c in range(1, 6)])
        if rows:
            yield from _repeats(rows, width)

    source = docs.where("text is not null").select(F.unhex(F.md5(F.col("text").cast("string"))).alias("text_key"), F.col("text").cast("string"))
    sent = source.mapInArrow(send, "bucket int, bodies binary, counts binary, spread binary, keys binary, places binary")
    found = sent.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(count, "text_key binary, begin int, end int")
    places = F.array_sort(F.collect_set(F.struct("begin", "end")))
    return found.groupBy("text_key").agg(places.alias("places"))


def _packed(held: dict[int, dict[bytes, list]], packer: zstandard.ZstdCompressor) -> pa.RecordBatch:
    rows = []
    for bucket, entries in held.items():
        values = entries.values()
        ints = [np.asarray(x, np.int32).tobytes() for x in ([v[0] for v in values], [len(v[1]) for v in values], [p for v in values for p in v[2]])]
        rows.append((bucket, packer.compress(b"\n".join(entries)), ints[0], ints[1], b"".join(k for v in values for k in v[1]), ints[2]))
    kinds = (pa.int32(), *(pa.binary() for _ in range(5)))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "bodies", "counts", "spread", "keys", "places"])


def _repeats(rows: list[tuple], width: int) -> Iterator[pa.RecordBatch]:
    """Runs of words under repeated windows of one bucket, for every place of the super-k-mers that hold them."""
    unpack = zstandard.ZstdDecompressor().decompress
    one, two, sizes = [], [], []
    for bodies, *_ in rows:
        texts = unpack(bodies).split(b"\n")
        for a, b in groups(texts):
            w = Words(texts[a:b])
            n = w.counts - width + 1
            at = np.repeat(w.first[:-1], n) + _steps(n)
            one.append(runs(w.hash, width)[at])
            two.append(runs(mix64(w.hash ^ _SECOND), width)[at])
            sizes.append(n)
    first, second, n_windows = np.concatenate(one), np.concatenate(two), np.concatenate(sizes)
    copies = np.repeat(np.concatenate([np.frombuffer(r[1], np.int32) for r in rows]).astype(np.int64), n_windows)
    order = np.argsort(first)
    if ((first[order][1:] == first[order][:-1]) & (second[order][1:] != second[order][:-1])).any():
        order = np.lexsort((second, first))
    new = np.concatenate([[True], (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])])
    total = np.add.reduceat(copies[order], np.flatnonzero(new))
    twice = np.empty(len(order), bool)
    twice[order] = (total >= 2)[np.cumsum(new) - 1]
    if not twice.any():
        return
    ends = np.cumsum(n_windows)
    lead = np.zeros(len(twice), bool)
    lead[ends - n_windows] = True
    before = np.concatenate([[False], twice[:-1]])
    begins = np.flatnonzero(twice & (lead | ~before))
    after = np.concatenate([twice[1:] & ~lead[1:], [False]])
    stops = np.flatnonzero(twice & ~after) + 1
    body = np.searchsorted(ends, begins, side="right")
    base = (ends - n_windows)[body]
    spread = np.concatenate([np.frombuffer(r[2], np.int32) for r in rows]).astype(np.int64)
    keys = np.frombuffer(b"".join(r[3] for r in rows), "V16")
    places = np.concatenate([np.frombuffer(r[4], np.int32) for r in rows])
    n = spread[body]
    which = np.repeat((np.cumsum(spread) - spread)[body], n) + _steps(n)
    begin = places[which] + np.repeat(begins - base, n)
    end = places[which] + np.repeat(stops - base, n) + width - 1
    for a in range(0, len(which), 100_000):
        part = slice(a, a + 100_000)
        key = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(which[part]), [None, pa.py_buffer(np.ascontiguousarray(keys[which[part]]).tobytes())])
        yield pa.RecordBatch.from_arrays([key.cast(pa.binary()), pa.array(begin[part].astype(np.int32)), pa.array(end[part].astype(np.int32))], names=["text_key", "begin", "end"])


def _steps(n: np.ndarray) -> np.ndarray:
    """0..n[0]-1, 0..n[1]-1 and so on."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def remove_repeats(docs: DataFrame, width: int = 35, mer: int = 4) -> DataFrame:
    """docs with `n_words`, `n_removed` and `kept`, the kept words joined by one space; other columns stay."""
    bounded_batches(docs.sparkSession)
    places = stored(repeated_places(docs.select("doc_id", "text"), width, mer), "repeats")
    size = places.agg(F.sum(96 + 32 * F.size("places"))).first()[0] or 0  # in memory
    names = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept")]
    key, spans = (free_name(docs, n) for n in ("text_key", "places"))
    places = places.select(F.col("text_key").alias(key), F.col("places").alias(spans))
    source, text_at = with_text(docs, names)
    text = source.columns[text_at]
    joined = source.join(F.broadcast(places) if size <= BROADCAST_BYTES else places, F.unhex(F.md5(text)) == F.col(key), "left")
    out = joined.select(*source.columns, spans)
    schema = docs.select(*names).schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            counts, removed, kept = [], [], []
            for text, runs_ in zip(batch.column(text_at), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                words = (text.as_py() or "").encode().split()
                n, at, parts = len(words), 0, []
                for run in runs_ or ():
                    parts.extend(words[at : max(at, run["begin"])])
                    at = max(at, run["end"])
                if at:
                    words = parts + words[at:]
                counts.append(n)
                removed.append(n - len(words))
                kept.append(b" ".join(words).decode())
            cols = [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *cols], names=[*names, "n_words", "n_removed", "kept"])

    return out.mapInArrow(rewrite, schema)
