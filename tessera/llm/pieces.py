"""SentencePiece encoding and decoding that keeps offsets.

The text is normalised by the longest prefix found in the model's compiled character map, and each
normalised byte records the source byte it came from. The normalised text is cut into stretches that no
piece of the vocabulary crosses (a run of word marks and what follows it, where no piece has a mark after
another character), and each stretch is merged pair by pair, the best score first and the leftmost of
equals; what isn't in the vocabulary falls back to its bytes where the model has byte pieces. Every piece
covers a run of normalised bytes, and through the recorded alignment a span of bytes of the original
text. Ids are decoded by the library, which also is what the tests hold the ids against.

Only BPE models without user-defined symbols are taken; others are an error.

Defined cases: null text is empty text; empty text has no piece; a marker piece that the model puts
before the text has an empty span; a very long text is encoded whole, also one without any blank, whose
merges go through a heap; repeated rows are encoded each; an empty table gives no row; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._util import bounded_batches

PIECES_SCHEMA = "doc_id long, ids array<int>, begins array<int>, ends array<int>, decoded string"
_MARK = "▁".encode()
_NORMAL, _UNKNOWN, _USER, _UNUSED, _BYTE, _BPE = 1, 2, 4, 5, 6, 2
_CACHED, _CACHED_LENGTH = 300_000, 64  # stretches a worker remembers, and the length up to which it does


def _varint(buf: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = buf[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value, at


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0
    while at < len(buf):
        tag, at = _varint(buf, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(buf, at)
        elif kind == 2:
            size, at = _varint(buf, at)
            value, at = buf[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = buf[at : at + size], at + size
        yield tag >> 3, value


class CharMap:
    """The compiled character map: a double-array trie from source bytes to a replacement."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.strings = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest mapped prefix of text[at:] and what replaces it."""
        units, found = self.units, None
        node = self._child(units[0], 0)
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node = self._child(unit, node)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.strings[start : self.strings.index(b"\0", start)]
        return found

    @staticmethod
    def _child(unit: int, node: int) -> int:
        return node ^ ((unit >> 10) << ((unit & 512) >> 6))


class Vocabulary:
    """Pieces with scores, and the merging of a stretch of normalised text."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        if any(kind == _USER for _, _, kind in pieces):
            raise ValueError("models with user-defined symbols are not supported")
        self.scores = {p: score for p, score, kind in pieces if kind in (_NORMAL, _UNUSED)}
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (_NORMAL, _UNUSED)}
        self.unused = {p for p, _, kind in pieces if kind == _UNUSED}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == _BYTE}
        self.unknown = next((i for i, (_, _, kind) in enumerate(pieces) if kind == _UNKNOWN), 0)
        across = any("▁" in p.lstrip("▁") for p in self.scores)
        self.stretch = re.compile(".+" if across else "▁*[^▁]+|▁+", re.DOTALL)
        self.widths = np.asarray([1 if kind == _BYTE else len(p.encode()) for p, _, kind in pieces], np.int32)
        self.known = _Known(self)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a normalised text, and the bytes that each covers."""
        stretches = self.stretch.findall(text)
        ids = np.frombuffer(b"".join(map(self.known.__getitem__, stretches)), np.int32)
        sizes = self.widths[ids]
        lost = ids == self.unknown
        if lost.any():
            sizes[lost] = [len(p.encode()) for s in stretches for p in self.merged(s) if p not in self.ids]
            if (lost[1:] & lost[:-1]).any():  # neighbours that are unknown are one piece
                first = np.flatnonzero(~lost | ~np.concatenate([[False], lost[:-1]]))
                ids, sizes = ids[first], np.add.reduceat(sizes, first)
        return ids, sizes

    def ids_of(self, stretch: str) -> bytes:
        """Ids of a stretch as 32-bit integers."""
        ids: list[int] = []
        for piece in self.merged(stretch):
            at = self.ids.get(piece)
            if at is not None:
                ids.append(at)
            elif self.bytes:
                ids.extend(self.bytes[b] for b in piece.encode())
            else:
                ids.append(self.unknown)
        return np.asarray(ids, np.int32).tobytes()

    def merged(self, s: str) -> list[str]:
        """The pieces of a stretch: neighbours merge while the vocabulary has what they make, the best score first."""
        if len(s) <= _CACHED_LENGTH and not self.unused:
            return self._merged_by_scan(list(s))
        parts: list[str] = list(s)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        made: dict[str, tuple[str, str]] = {}
        queue: list[tuple[float, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts):
                score = self.scores.get(parts[i] + parts[j])
                if score is not None:
                    heapq.heappush(queue, (-score, i, j, len(parts[i]) + len(parts[j])))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, size = heapq.heappop(queue)
            if not parts[i] or not parts[j] or len(parts[i]) + len(parts[j]) != size or after[i] != j:
                continue
            new = parts[i] + parts[j]
            if new in self.unused:
                made[new] = parts[i], parts[j]
            parts[i], parts[j] = new, ""
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        out = [p for p in parts if p]
        while any(p in made for p in out):  # an unused piece is what it was made of
            out = [q for p in out for q in made.get(p, (p,))]
        return out


    def _merged_by_scan(self, parts: list[str]) -> list[str]:
        """The same for a few characters, without a heap."""
        score, none = self.scores.get, -np.inf
        pairs = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs and (best := max(pairs)) != none:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = score(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = score(parts[i] + parts[i + 1], none)
        return parts


class _Known(dict):
    """Ids of the stretches met so far; those of a long one are made anew each time."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, stretch: str) -> bytes:
        out = self.vocabulary.ids_of(stretch)
        if len(stretch) <= _CACHED_LENGTH:
            if len(self) >= _CACHED:
                self.clear()
            self[stretch] = out
        return out


class PieceModel:
    """A model file: the normaliser with its alignment, the vocabulary, and the library for decoding."""

    def __init__(self, file: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=file)
        with open(file, "rb") as f:
            fields = list(_fields(f.read()))
        trainer, spec = (next((dict(_fields(v)) for n, v in fields if n == k), {}) for k in (2, 3))
        if trainer.get(3, 1) != _BPE:
            raise ValueError("not a BPE model")
        rows = [dict(_fields(v)) for n, v in fields if n == 1]
        self.vocabulary = Vocabulary([(r[1].decode(), struct.unpack("<f", r.get(2, bytes(4)))[0], r.get(3, _NORMAL)) for r in rows])
        blob = spec.get(2, b"")
        self.map = CharMap(blob) if blob else None
        self.dummy_prefix, self.squeeze, self.escape = (bool(spec.get(n, 1)) for n in (3, 4, 5))

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them (and for the end) the source byte it came from."""
        if not text:
            return b"", np.zeros(1, np.int64)
        if self.map is None and not self.squeeze and self.escape:
            raw = np.frombuffer(text, np.uint8)
            wide = np.where(raw == 32, 3, 1)
            align = np.repeat(np.arange(len(raw)), wide)
            lead = 3 if self.dummy_prefix else 0
            out = (b" " * self.dummy_prefix + text).replace(b" ", _MARK)
            return out, np.concatenate([np.zeros(lead, np.int64), align, [len(raw)]])
        return self._by_prefix(text)

    def _by_prefix(self, text: bytes) -> tuple[bytes, np.ndarray]:
        parts: list[tuple[int, bytes]] = []
        at = 0
        while at < len(text):
            hit = self.map.longest(text, at) if self.map else None
            if hit is None:
                b = text[at]
                size = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                hit = size, text[at : at + size]
            parts.append((at, hit[1]))
            at += hit[0]
        out, align, space = bytearray(), [], self.squeeze
        end = len(text)
        if self.squeeze:
            while parts and not parts[-1][1].strip(b" "):
                end = parts.pop()[0]
            while parts and not parts[0][1].strip(b" "):
                parts.pop(0)
        mark = _MARK if self.escape else b" "
        if parts and self.dummy_prefix:
            out += mark
            align += [parts[0][0]] * len(mark)
        for src, piece in parts:
            for i in range(len(piece)):
                c = piece[i : i + 1]
                if c == b" ":
                    if space and self.squeeze:
                        continue
                    c = mark
                    space = True
                else:
                    space = False
                out += c
                align += [src] * len(c)
        return bytes(out), np.asarray([*align, end], np.int64)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and the byte span of the original text that each covers."""
        norm, align = self.normalise(text.encode())
        ids, sizes = self.vocabulary.encode(norm.decode())
        stops = np.cumsum(sizes)
        return ids, align[stops - sizes].astype(np.int32), align[stops].astype(np.int32)


@lru_cache(maxsize=1)
def model(file: str) -> PieceModel:
    """One per Python worker."""
    return PieceModel(file)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)))


def encode_documents(docs: DataFrame, file: str | None = None) -> DataFrame:
    """Per document: ids, the byte spans they cover in the original text, and the text decoded from the ids."""
    if file is None:
        import public_tokenizers as P

        file = P.path("piece_bpe_32k.model")

    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(file)
        for batch in batches:
            docs_, got, held = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, begins, ends = m.encode(text.as_py() or "")
                docs_.append(doc)
                got.append((ids, begins, ends, m.lib.decode(ids.tolist())))
                held += len(ids)
                if held > 1_000_000:
                    yield _out(docs_, got)
                    docs_, got, held = [], [], 0
            if docs_:
                yield _out(docs_, got)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES_SCHEMA)


def _out(docs: list, got: list[tuple]) -> pa.RecordBatch:
    cols = [pa.array(docs, pa.int64()), *(_lists([g[k] for g in got]) for k in range(3)), pa.array([g[3] for g in got], pa.string())]
    return pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "begins", "ends", "decoded"])
