"""Jaccard join of word n-gram sets: size-banded tiles, hashed bitmaps, exact intersection.

1. Every text becomes a sorted array of distinct 64-bit shingle hashes with a 128-bit digest. Equal sets
   are one node, numbered by the row of one of its documents.
2. Sizes fall into bands so wide that linked sets lie in one band or in neighbouring ones. The sets of
   two neighbouring bands can differ in at most D elements, so of D + 1 + r segments of the hash range
   at least r + 1 are equal in both. Empty segments of a set are left out where no more than r are; with
   e of them, linked sets have r + 1 - e equal segments at least among the others.
3. Segments that two or more nodes have meet at their key and learn how many have them. A node that has
   fewer of them than it needs is out; of the others it may leave out its most frequent ones, all but the
   last that it needs, since all nodes leave out by one order. So a passage in many texts makes no tile.
4. What shares a segment still is a candidate group. A small one is a tile. Of a large one, tiles of
   bounded size are tried, and then what represents the parts joined so far, until a round joins
   nothing; at last every node outside its group's largest part visits all blocks of its size bands.
5. In a tile, the bits of hashed bitmaps bound the overlap of two sets from above: each bit that only
   one of them has stands for an element that the other lacks. Pairs that the bound leaves are decided
   by intersecting the sorted arrays. A pair already joined through others isn't tried again.
6. The links found span the components of all links.

All candidates are tried; there is no cap. A tile holds at most BLOCK sets of average size or their
weight in long ones; a key that very many nodes have passes through in pieces.

Defined cases: null texts and texts without words have the empty set and are linked with nothing; a text
with fewer words than a shingle has one, its whole sequence; repeated rows are linked; of a null doc_id
the component is the least non-null one; a very long text is one set like any other and weighs as
several in its tile; an empty table gives no row; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm._util import bounded_batches, partitions, stored
from tessera.llm._words import Words, groups, mix64, runs
from tessera.llm.components import components, stars

BLOCK = 512  # sets in a tile; a set over _HEAVY shingles counts as several
_HEAVY = 2048
BROADCAST_ROWS = 250_000  # candidate documents are broadcast up to here (under 32 MB), else shuffled
_BITS = 1024
_SLICE = 500  # rows whose texts a task holds as bytes
_FLUSH = 1 << 18  # keys a task gathers before it sends them
_BUCKET = 1 << 18  # keys meant for one bucket
_HELD = 1 << 19  # keys of a bucket a task holds before it lets frequent ones pass
_MANY = 1 << 16  # nodes from which a key counts as this frequent
_SEEN = 200_000  # sets a task remembers so as not to send a copy's keys
_WORD = "[^\\x20\\x09-\\x0D]"  # what a text with a word has
_U = np.uint64
_SEG, _D1, _D2 = _U(0xA24BAED4963EE407), _U(0x9FB21C651E98DF25), _U(0xC13FA9A902A6328F)


class Bands:
    """Size bands for a similarity of `percent` and the segments that a pair of neighbours needs."""

    def __init__(self, percent: int):
        if not 0 < percent <= 100:
            raise ValueError("percent must be in 1..100")
        self.percent = percent
        self.low = [1]

    def _upto(self, band: int) -> None:
        while len(self.low) < band + 2:
            self.low.append(self.low[-1] * 100 // self.percent + 1)

    def of(self, n: int) -> int:
        """The band of a set size; sizes n <= m that can link lie in one band or in neighbouring ones."""
        while self.low[-1] <= n:
            self._upto(len(self.low) - 1)
        return int(np.searchsorted(self.low, n, side="right")) - 1

    def segments(self, band: int) -> tuple[int, int]:
        """(D + 1 + r, r) for pairs whose larger set is in `band`."""
        self._upto(band)
        most = 2 * (self.low[band + 1] - 1) * (100 - self.percent) // (100 + self.percent)
        spare = 2 + most // 3
        return most + 1 + spare, spare

    def column(self, n: Column, largest: int) -> Column:
        """The band of a size as a column; no size is over `largest`."""
        self.of(largest + 1)
        at = F.lit(0)
        for low in self.low[1:]:
            at = at + (n >= low).cast("int")
        return at


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; A-Z count as a-z."""
    for a, b in groups(texts):
        w = Words([t.lower() for t in texts[a:b]])
        hashes = runs(w.hash, width)
        for i, j in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if j - i >= width:
                yield np.unique(hashes[i : j - width + 1])
            else:
                yield runs(w.hash[i:j], j - i) if j > i else np.empty(0, _U)


def digest(s: np.ndarray) -> bytes:
    """128 bits of a set."""
    sums = np.asarray([mix64(s ^ _D1).sum(dtype=_U), mix64(s ^ _D2).sum(dtype=_U)])
    return mix64(sums + _U(len(s))).tobytes()


def short(name: bytes) -> int:
    """The half of a digest that stands for the set while candidates are looked for."""
    return int.from_bytes(name[:8], "little", signed=True)


def segment_keys(s: np.ndarray, band: int, bands: Bands) -> tuple[np.ndarray, int]:
    """Keys of the segments of a set in the pairs whose larger set is in `band`, and how many of them a linked set has at least."""
    m, spare = bands.segments(band)
    seg = ((s >> _U(32)) * _U(m)) >> _U(32)
    first = np.concatenate([[0], np.flatnonzero(seg[1:] != seg[:-1]) + 1])
    there = seg[first]
    keys = mix64(np.add.reduceat(mix64(s ^ _SEG), first) + mix64(there + (_U(band) << _U(32))))
    gaps = m - len(first)
    if gaps <= spare:
        return keys, spare + 1 - gaps
    empty = np.setdiff1d(np.arange(m, dtype=_U), there)
    return np.concatenate([keys, mix64(_SEG + mix64(empty + (_U(band) << _U(32))))]), 1  # a linked set may leave its empty ones out


def bitmap(s: np.ndarray) -> np.ndarray:
    """The hashed bitmap of a set: _BITS bits in unsigned 64-bit words."""
    bits = np.zeros(_BITS, np.uint8)
    bits[(mix64(s) % _U(_BITS)).astype(np.int64)] = 1
    return np.packbits(bits).view(_U)


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """A batch in slices, with the texts of its last column; null counts as empty."""
    for a in range(0, batch.num_rows, _SLICE):
        part = batch.slice(a, _SLICE)
        yield part, [t.as_py().encode() if t.is_valid else b"" for t in part.column(part.num_columns - 1)]


def set_digests(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_key, n, name, short): the text's digest, and the size and digest of the document's set (null for the empty one)."""
    kinds = (pa.int64(), pa.binary(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _parts(batch):
                names = [(len(s), digest(s) if len(s) else None) for s in shingle_sets(texts, width)]
                rows = [(n, name, name and short(name)) for n, name in names]
                cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], names=["doc_id", "text_key", "n", "name", "short"])

    return docs.select("doc_id", text_key("text").alias("text_key"), "text").mapInArrow(run, "doc_id long, text_key binary, n long, name binary, short long")


def text_key(text: str) -> Column:
    return F.unhex(F.md5(F.col(text)))


def shared_segments(docs: DataFrame, width: int, percent: int, n_keys: int) -> DataFrame:
    """(short, upper, need, key, seen): the segments of each node that other nodes have, and how many have them.

    `upper` tells the segments for pairs whose larger set is in the next band from those for its own band.
    """
    n_parts = partitions(docs.sparkSession)
    n_buckets = max(4 * n_parts, -(-n_keys // _BUCKET))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, done, held = Bands(percent), set(), _Keys()
        for batch in batches:
            for s in (s for _, texts in _parts(batch) for s in shingle_sets(texts, width)):
                if not len(s):
                    continue
                node = short(digest(s))
                if node in done:
                    continue
                if len(done) < _SEEN:
                    done.add(node)
                band = bands.of(len(s))
                for upper in (0, 1):
                    m, spare = bands.segments(band + upper)
                    if m - spare > 1:
                        held.add(node, upper, *segment_keys(s, band + upper, bands))
                if held.n > _FLUSH:
                    yield held.bucketed(n_buckets)
                    held = _Keys()
        if held.n:
            yield held.bucketed(n_buckets)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bucket = None, _Bucket()
        for batch in batches:
            for i, at in enumerate(batch.column(0).to_pylist()):
                if at != now:
                    yield from bucket.close()
                    now, bucket = at, _Bucket()
                yield from bucket.add(*(np.frombuffer(batch.column(c)[i].as_py(), kind) for c, kind in enumerate(_KINDS, 1)))
        yield from bucket.close()

    sent = docs.mapInArrow(send, "bucket int, keys binary, nodes binary, needs binary")
    return sent.repartition(n_parts, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "short long, upper int, need int, key long, seen int")


_KINDS = ("<u8", "<i8", "<u2")  # of a key: itself, its node, and twice what the node needs, plus 1 for the upper band


class _Keys:
    """Keys that a task gathers."""

    def __init__(self):
        self.rows, self.n = [], 0

    def add(self, node: int, upper: int, keys: np.ndarray, need: int) -> None:
        self.rows.append((keys, node, 2 * min(need, 32767) + upper))
        self.n += len(keys)

    def bucketed(self, n_buckets: int) -> pa.RecordBatch:
        sizes = [len(r[0]) for r in self.rows]
        cols = [np.concatenate([r[0] for r in self.rows]), *(np.repeat(np.asarray([r[k] for r in self.rows], kind), sizes) for k, kind in enumerate(_KINDS[1:], 1))]
        bucket = (cols[0] % _U(n_buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        cut = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]]).tolist()
        packed = []
        for c in cols:
            c = c[order]
            packed.append(pa.array([c[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]]), *packed], names=["bucket", "keys", "nodes", "needs"])


class _Bucket:
    """The keys of one bucket: leaves those of one node, and lets keys of very many nodes pass as they come."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, ...]] = []
        self.n, self.limit = 0, _HELD
        self.many = np.empty(0, _U)

    def add(self, *cols: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(self.many):
            hot = np.isin(cols[0], self.many)
            if hot.any():
                yield _seen([c[hot] for c in cols], np.full(int(hot.sum()), _MANY))
                cols = tuple(c[~hot] for c in cols)
        self.held.append(cols)
        self.n += len(cols[0])
        if self.n > self.limit:
            rows, count = self._counted()
            hot = count >= _MANY
            if hot.any():
                self.many = np.union1d(self.many, rows[0][hot])
                yield _seen([c[hot] for c in rows], np.full(int(hot.sum()), _MANY))
                rows = [c[~hot] for c in rows]
            self.held, self.n = [tuple(rows)], len(rows[0])
            self.limit = 2 * max(self.n, _HELD // 2)

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            rows, count = self._counted()
            shared = count > 1
            if shared.any():
                yield _seen([c[shared] for c in rows], np.minimum(count[shared], _MANY))

    def _counted(self) -> tuple[list[np.ndarray], np.ndarray]:
        """What is held, by key, each (key, node) once, and the number of nodes of each row's key."""
        rows = [np.concatenate(c) for c in zip(*self.held, strict=True)]
        order = np.lexsort((rows[1], rows[0]))
        rows = [c[order] for c in rows]
        new_key = np.concatenate([[True], rows[0][1:] != rows[0][:-1]])
        once = new_key | np.concatenate([[True], rows[1][1:] != rows[1][:-1]])
        rows, new_key = [c[once] for c in rows], new_key[once]
        return rows, np.bincount(np.cumsum(new_key) - 1)[np.cumsum(new_key) - 1]


def _seen(rows: list[np.ndarray], count: np.ndarray) -> pa.RecordBatch:
    key, node, need = rows
    cols = [pa.array(c) for c in (node, (need & 1).astype(np.int32), (need >> 1).astype(np.int32), key.view(np.int64), count.astype(np.int32))]
    return pa.RecordBatch.from_arrays(cols, names=["short", "upper", "need", "key", "seen"])


def candidate_groups(segments: DataFrame) -> DataFrame:
    """(short, root): nodes connected by the segments that each keeps of its shared ones, the rarest first."""
    w = Window.partitionBy("short", "upper")
    ranked = segments.withColumns({"rank": F.row_number().over(w.orderBy("seen", "key")), "of": F.count(F.lit(1)).over(w)})
    kept = ranked.where((F.col("of") >= F.col("need")) & (F.col("rank") <= F.col("of") - F.col("need") + 1)).select("key", "short")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Neighbours of one key, shrunk to stars; rows come sorted by key."""
        keys = nodes = np.empty(0, np.int64)
        held, n, shrunk = [(keys, nodes)], 0, 0
        for batch in batches:
            keys = np.concatenate([keys[-1:], batch.column(0).to_numpy()])
            nodes = np.concatenate([nodes[-1:], batch.column(1).to_numpy()])
            same = keys[1:] == keys[:-1]
            held.append((nodes[1:][same], nodes[:-1][same]))
            n += len(held[-1][0])
            if n > max(1 << 16, 2 * shrunk):
                held = [stars(*map(np.concatenate, zip(*held, strict=True)))]
                n = shrunk = len(held[0][0])
                if shrunk > _HELD:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, held[0])), names=["a", "b"])
                    held, n, shrunk = [(keys[:0], nodes[:0])], 0, 0
        found = stars(*map(np.concatenate, zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays(list(map(pa.array, found)), names=["a", "b"])

    edges = kept.repartition(partitions(segments.sparkSession), "key").sortWithinPartitions("key").mapInArrow(joined, "a long, b long")
    return components(edges).select(F.col("node").alias("short"), "root")


class _Union:
    """Labels of a tile's sets; joined sets have one label."""

    def __init__(self, labels: np.ndarray):
        self.of = labels

    def join(self, i: int, j: int) -> None:
        a, b = self.of[i], self.of[j]
        self.of[self.of == max(a, b)] = min(a, b)


def links_of(sets: list[np.ndarray], labels: np.ndarray, side: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Index pairs of a tile that link and join different labels; sizes ascend. With `side`, only pairs of different sides."""
    sizes, bits = np.asarray([len(s) for s in sets], np.int64), np.stack([bitmap(s) for s in sets])
    out: list[tuple[int, int]] = []
    known = _Union(labels)
    stop = np.searchsorted(sizes, sizes * 100 // percent, side="right")
    for i in range(len(sizes) - 1):
        j = np.arange(i + 1, stop[i])
        open_ = known.of[j] != known.of[i]
        if side is not None:
            open_ &= side[j] != side[i]
        j = j[open_]
        if not len(j):
            continue
        need = -(-(sizes[i] + sizes[j]) * percent // (100 + percent))
        only_i = np.bitwise_count(bits[i] & ~bits[j]).sum(axis=1, dtype=np.int64)
        only_j = np.bitwise_count(bits[j] & ~bits[i]).sum(axis=1, dtype=np.int64)
        bound = np.minimum(sizes[i] - only_i, sizes[j] - only_j)
        for c in j[bound >= need].tolist():
            if known.of[c] != known.of[i]:
                a, b = sets[i], sets[c]
                both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                if 100 * both >= percent * (len(a) + len(b) - both):
                    known.join(i, c)
                    out.append((i, c))
    return out


def candidate_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """wanted (doc_id, text_key, name, ...) with `data`, the set of the document, made again from its text."""
    few = wanted.count() <= BROADCAST_ROWS
    others = [c for c in wanted.columns if c not in ("doc_id", "text_key", "name")]
    wanted = wanted.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (text_key("text") == F.col("_key"))  # ids may repeat or be null
    texts = docs.join(F.broadcast(wanted) if few else wanted, same).select("name", *others, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _parts(batch):
                kept, data = [], []
                for i, (name, s) in enumerate(zip(part.column(0).to_pylist(), shingle_sets(texts, width), strict=True)):
                    if len(s) and digest(s) == name:
                        kept.append(i)
                        data.append(s.tobytes())
                cols = [part.column(c).take(pa.array(kept, pa.int64())) for c in range(1, len(others) + 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(data, pa.binary())], names=[*others, "data"])

    return texts.mapInArrow(run, texts.select(*others).schema.add("data", "binary"))


def tile_links(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) from rows (tile, side, node, label, data): links in every tile between different labels, and sides where they are set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            for i, tile in enumerate(batch.column(0).to_pylist()):
                if tile != now:
                    yield from one(held)
                    now, held = tile, {}
                side, node, label = (batch.column(c)[i].as_py() for c in (1, 2, 3))
                held[node, side] = label, batch.column(4)[i].as_py()  # a repeated row of a document counts once
        yield from one(held)

    def one(held: dict) -> Iterator[pa.RecordBatch]:
        if len(held) < 2:
            return
        rows = sorted(held.items(), key=lambda r: len(r[1][1]))
        side = None if rows[0][0][1] is None else np.asarray([r[0][1] for r in rows])
        _, labels = np.unique(np.asarray([r[1][0] for r in rows], np.int64), return_inverse=True)
        found = links_of([np.frombuffer(r[1][1], _U) for r in rows], labels, side, percent)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([rows[p[k]][0][0] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    rows = rows.select("tile", F.col("side").cast("int").alias("side"), "node", "label", "data")
    return rows.repartition(partitions(rows.sparkSession), "tile").sortWithinPartitions("tile").mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents link when 100 * intersection >= percent * union."""
    per_doc, nodes, linked = _linked(docs, width, percent)
    least = linked.join(nodes, "node").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_node = linked.join(least, "root").select("node", "component_id")
    named = nodes.join(of_node, "node", "left").select("name", F.coalesce("component_id", "doc_id").alias("component_id"))
    return per_doc.join(named, "name", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def first_of_components(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """One row of each component: the least by doc_id (null last), then by text and the other columns.

    Rows with the empty set are linked with nothing; of them only identical rows count as one. doc_id names
    no row here: it may be null or repeat. Only rows that go, or whose rival has the same doc_id, are looked up.
    """
    per_doc, nodes, linked = _linked(docs, width, percent)
    texts = per_doc.where("n > 0").groupBy("doc_id", "text_key", "name").agg(F.count(F.lit(1)).alias("copies"))
    rooted = texts.join(nodes.select("name", "node"), "name").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = stored(rooted.select("root", "doc_id", "text_key", "copies"), "texts")
    id_ = F.struct(F.col("doc_id").isNull(), "doc_id")
    several = rooted.groupBy("root").agg(F.min(id_).alias("least"), F.sum("copies").alias("rows")).where("rows > 1")
    several = rooted.join(several, "root").withColumn("_stays", id_ == F.col("least"))
    rivals = several.where("_stays").groupBy("root").agg(F.sum("copies").alias("rivals"))
    special = several.join(rivals, "root").where("not _stays or rivals > 1")
    special = stored(special.select(F.col("root").alias("_root"), F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "_stays"), "special")
    if special.count() <= BROADCAST_ROWS:
        special = F.broadcast(special)
    has_word = F.coalesce(F.col("text").rlike(_WORD), F.lit(False))
    at = docs.where(has_word).join(special, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (text_key("text") == F.col("_key")), "left")
    row = F.struct("text", *(c for c in docs.columns if c != "text"))
    of_rivals = at.where("_stays").groupBy("_root").agg(F.min(row).alias("row")).select("row.*").select(*docs.columns)
    return at.where("_stays is null").select(*docs.columns).union(of_rivals).union(docs.where(~has_word).distinct())


def _linked(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Digests of the documents, (name, node, doc_id, n) of the sets, and (node, root) of those that link."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    per_doc = stored(set_digests(docs, width).withColumn("row", F.monotonically_increasing_id()), "digests")
    nodes = per_doc.where("n > 0").groupBy("name").agg(F.min("row").alias("node"), F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("short").alias("short"), F.min_by(F.struct("doc_id", "text_key"), "row").alias("first"))
    nodes = stored(nodes, "nodes")
    total, largest = nodes.agg(F.sum("n"), F.max("n")).first()
    segments = shared_segments(docs, width, percent, n_keys=(total or 0) * 6 * (100 - percent) // (100 + percent))
    groups_ = stored(candidate_groups(stored(segments, "segments")), "groups")
    band = Bands(percent).column(F.col("n"), largest or 0)
    weight = F.greatest(F.lit(1.0), F.col("n") / _HEAVY)
    members = stored(groups_.join(nodes, "short").select("root", "node", "name", "first.doc_id", "first.text_key", band.alias("band"), weight.alias("weight")), "members")
    totals = members.groupBy("root").agg(F.sum("weight").alias("total"))
    members = stored(members.join(totals, "root"), "members")
    links = _small(docs, members.where(F.col("total") <= BLOCK), width, percent)
    large = members.where(F.col("total") > BLOCK)
    if not large.isEmpty():
        links = links.union(_large(docs, large, width, percent))
    return per_doc, nodes, components(links)


def _small(docs: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): links of the groups that are one tile each."""
    tiles = members.select("doc_id", "text_key", "name", F.col("root").alias("tile"), F.lit(None).cast("int").alias("side"), "node", F.col("node").alias("label"))
    return stored(tile_links(candidate_sets(docs, tiles, width), percent), "links")


def _large(docs: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): links that join all that can be joined in groups of more than one tile."""
    sets = stored(candidate_sets(docs, members.select("doc_id", "text_key", "name", "node", "root", "band", "weight"), width), "sets")
    data = sets.select("node", "data")
    now = sets.select("node", "root", "band", "weight", F.col("node").alias("label"))
    links, round_, n_heads = None, 0, None
    while True:  # a row stands for what it has been joined with
        heads = now.where("node = label")
        sizes = stored(heads.groupBy("root").agg(F.ceil(F.sum("weight") / BLOCK).alias("k"), F.count(F.lit(1)).alias("heads")).where("heads > 1"), "sizes")
        left = sizes.agg(F.sum("heads")).first()[0] or 0
        if not left or (n_heads is not None and left > 0.9 * n_heads):
            break
        tile = F.xxhash64("root", F.pmod(F.xxhash64("node", F.lit(round_)), "k"))
        tiles = heads.join(sizes, "root").select(tile.alias("tile"), F.lit(None).cast("int").alias("side"), "node", "label")
        found = stored(tile_links(tiles.join(data, "node"), percent), "links")
        links = found if links is None else links.union(found)
        joined = components(links).withColumnRenamed("root", "joined")
        now = stored(now.join(joined, "node", "left").withColumn("label", F.coalesce("joined", "node")).drop("joined"), "labels")
        round_, n_heads = round_ + 1, left
    if links is None:
        return docs.sparkSession.createDataFrame([], "a long, b long")
    if not left:
        return links
    return links.union(stored(tile_links(_visits(now).join(data, "node"), percent), "links"))


def _visits(now: DataFrame) -> DataFrame:
    """(tile, side, node, label): every row outside its group's most frequent label, with each block of rows in its band or a neighbouring one."""
    at = ["root", "band"]

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        k = rows.groupBy(*at).agg(F.ceil(F.sum("weight") / BLOCK).alias("k"))
        return rows.join(k, at).withColumn(name, F.pmod(F.xxhash64("node"), "k")).select(*at, name, "node", "label")

    most = now.groupBy("root", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("root").agg(F.max_by("label", F.struct("n", "label")).alias("most"))
    guests = stored(blocks(now.join(most, "root").where("label != most"), "guest").withColumnRenamed("band", "own"), "guests")
    hosts = stored(blocks(now, "host"), "hosts")
    near = F.explode(F.array(*(F.col("own") + d for d in (-1, 0, 1)))).alias("band")
    pairs = guests.select("root", "own", "guest").distinct().select("*", near).join(hosts.select(*at, "host").distinct(), at)
    pairs = stored(pairs.withColumn("tile", F.xxhash64("root", "own", "guest", "band", "host")), "pairs")
    ends = [(guests, ["root", "own", "guest"], 0), (hosts, [*at, "host"], 1)]
    rows = [df.join(pairs, keys).select("tile", F.lit(side).alias("side"), "node", "label") for df, keys, side in ends]
    return rows[0].union(rows[1])
