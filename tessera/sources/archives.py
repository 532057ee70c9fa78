"""ZIP archives as a data source: a partition is a range of an archive's central directory, and members are read by seeking.

No archive is held: a task reads the directory and the members of its range, so one archive of any size is the work
of many tasks. Paths are files or folders in any store that pyarrow's file systems open; executors open them
themselves.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PART_BYTES, PART_MEMBERS = 32 << 20, 5000  # of one partition, unless a single member is larger
BATCH_BYTES = 4 << 20
_SCHEMA = pa.schema([("archive", pa.string()), ("member", pa.string()), ("size", pa.int64()), ("content", pa.binary())])


@dataclass
class MemberRange(InputPartition):
    """Members first to last - 1 of an archive's directory."""

    archive: str
    first: int
    last: int


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _archives(path: str, suffixes: tuple[str, ...]) -> list[str]:
    store, at = _opened(path)
    if store.get_file_info(at).type == fs.FileType.File:
        return [path]
    head = path[: len(path) - len(at)] if path.endswith(at) else ""
    found = store.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted(head + x.path for x in found if x.is_file and x.path.lower().endswith(suffixes))


def ranges(sizes: list[int], most_bytes: int, most_members: int) -> list[tuple[int, int]]:
    """Ranges of members of at most so many packed bytes and members; a larger member stands alone."""
    out, first, held = [], 0, 0
    for i, size in enumerate(sizes):
        if i > first and (held + size > most_bytes or i - first >= most_members):
            out.append((first, i))
            first, held = i, 0
        held += size
    return [*out, (first, len(sizes))] if sizes else out


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.suffixes = tuple(options.get("suffixes", ".zip,.hbk").lower().split(","))
        self.bytes = int(options.get("partbytes", PART_BYTES))
        self.members = int(options.get("partmembers", PART_MEMBERS))

    def partitions(self) -> list[MemberRange]:
        out = []
        for archive in _archives(self.path, self.suffixes):
            store, at = _opened(archive)
            with store.open_input_file(at) as f, zipfile.ZipFile(f) as z:
                out += [MemberRange(archive, a, b) for a, b in ranges([m.compress_size for m in z.infolist()], self.bytes, self.members)]
        return out or [MemberRange("", 0, 0)]

    def read(self, partition: MemberRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        store, at = _opened(partition.archive)
        rows, held = [], 0
        with store.open_input_file(at) as f, zipfile.ZipFile(f) as z:
            for m in z.infolist()[partition.first : partition.last]:
                if m.is_dir():
                    continue
                content = z.read(m)
                rows.append({"archive": partition.archive, "member": m.filename, "size": m.file_size, "content": content})
                held += len(content)
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)


class ArchiveMembers(DataSource):
    """`spark.read.format("archive_members").load(path)`; options suffixes, partBytes, partMembers."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return "archive string, member string, size long, content binary"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_members(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(archive, member, size, content) of the files in the archives at a path."""
    spark.dataSource.register(ArchiveMembers)
    return spark.read.format("archive_members").options(**options).load(path)


def text_of_bytes(content: Column) -> Column:
    """Bytes as text: UTF-8 without its mark if they are that, else Windows-1251."""
    text = content.cast("string")
    # Spark decodes Latin-1, whose upper half is then read as the other table's
    upper = bytes(range(128, 256))
    other = F.translate(F.decode(content, "iso-8859-1"), upper.decode("latin-1"), upper.decode("cp1251", "replace"))
    return F.when(F.is_valid_utf8(text), F.regexp_replace(text, "^\\x{FEFF}", "")).otherwise(other)


def read_pages(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(archive, path, html): pages of archives of documentation, those without an ending among them."""
    rows = read_members(spark, path, **options)
    name = F.substring_index("member", "/", -1)
    return rows.where(F.regexp_like(F.lower(name), F.lit("[.]html?$")) | ~F.contains(name, F.lit("."))).select("archive", F.col("member").alias("path"), text_of_bytes(F.col("content")).alias("html"))
