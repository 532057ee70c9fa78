"""The index of documentation items: chunks bounded by count and bytes, files of each category, objects and their members.

An item is a row (item_id, category, object, ...); what is written is partitioned by category and chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tessera.functions.names import second_name
from tessera.shared import numbered, stored
from tessera.sources.kinds import mapped

BLOCK = 4096  # items that are dealt to chunks at once

#: Items and bytes of a chunk.
MOST_ITEMS = 50
MOST_BYTES = 50 * 1024
# Groups of objects by name; other objects are under other.
OBJECT_GROUPS = {
    "collections": ("Массив", "Соответствие", "СписокЗначений", "ТаблицаЗначений", "ДеревоЗначений", "ФиксированныйМассив", "ФиксированноеСоответствие"),
    "io": ("ЧтениеТекста", "ЗаписьТекста", "ЧтениеXML", "ЗаписьXML", "ЧтениеJSON", "ЗаписьJSON", "ПотокВПамяти", "ФайловыйПоток"),
    "system": ("СистемнаяИнформация", "ИнформацияОПользователе", "НастройкиКлиента", "РаботаСФайлами", "СредстваКриптографии"),
    "datetime": ("Дата", "СтандартныйПериод", "ОписаниеПериода"),
    "metadata": ("Метаданные", "ОбъектМетаданных", "КонфигурацияМетаданных"),
    "query": ("Запрос", "ПостроительЗапроса", "РезультатЗапроса", "ВыборкаИзРезультатаЗапроса"),
    "forms": ("УправляемаяФорма", "ЭлементыФормы", "ДанныеФормы", "ПолеФормы"),
    "web": ("HTTPСоединение", "HTTPЗапрос", "HTTPОтвет", "WSПрокси", "WSСсылка"),
    "com": ("COMОбъект", "ВнешниеКомпоненты"),
}


def _next_heads(sizes: np.ndarray, most_items: int, most_bytes: int) -> np.ndarray:
    """For each item the place of the one that begins the next chunk, if this one begins a chunk."""
    sums = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(len(sizes))
    full = np.searchsorted(sums, sums[:-1] + most_bytes, side="right") - 1  # items up to here fit
    return np.minimum(at + most_items, np.maximum(at + 1, full))


def _ahead(sizes: np.ndarray, own: int, most_items: int, most_bytes: int) -> tuple[list[int], list[int]]:
    """For each of a block's first items: how far into the next block the first chunk after the block begins, and the chunks begun in the block, if that item begins one."""
    heads = _next_heads(sizes, most_items, most_bytes)[:own].tolist()
    beyond, begun = [0] * own, [1] * own
    for i in range(own - 1, -1, -1):
        to = heads[i]
        if to >= own:
            beyond[i] = to - own
        else:
            beyond[i], begun[i] = beyond[to], begun[to] + 1
    return beyond[:most_items], begun[:most_items]


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the first chunk of each block begins and how many chunks began before it, from the first block of a category to its last."""
    now, entry, before = object(), 0, 0
    for batch in batches:
        rows = batch.to_pydict()
        entries, befores = [], []
        for category, beyond, begun in zip(rows["category"], rows["beyond"], rows["begun"], strict=True):
            if category != now:
                now, entry, before = category, 0, 0
            entries.append(entry)
            befores.append(before)
            if entry < len(beyond):
                entry, before = beyond[entry], before + begun[entry]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(entries, pa.int64()), pa.array(befores, pa.int64())], names=["category", "_block", "_entry", "_before"])


def chunked(items: DataFrame, most_items: int = MOST_ITEMS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """items (category, item_id, bytes, ...) with `chunk`: items of a category in order of id, then size; a chunk is closed by `most_items` items, or by an item that would take it over `most_bytes`.

    Each row counts, repeated ids and a null category too. Rows are numbered over range partitions and cut into
    blocks; of each block it is worked out where the next chunk after it begins, for each of its first items that may
    begin one. Those summaries, a row for a block, are chained along a category, and the blocks filled in.
    """
    size = max(BLOCK, 4 * most_items)
    keys = [F.col("category").asc_nulls_first(), F.col("item_id").asc_nulls_first(), F.col("bytes").asc_nulls_first(), F.rand(5)]
    placed = numbered(items, keys, "_place", "items")
    rows = placed.select("category", F.floor((F.col("_place") - 1) / size).alias("_block"), F.col("_place").alias("place"), F.coalesce(F.col("bytes").cast("long"), F.lit(0)).alias("size"), F.lit(True).alias("own"))
    # a chunk may go on in the next block, so each sees the first items of the one after it
    edge = rows.where(((F.col("place") - 1) % size < most_items) & (F.col("_block") > 0)).withColumns({"_block": F.col("_block") - 1, "own": F.lit(False)})
    seen = stored(rows.unionByName(edge), "blocks")
    category = seen.select("category").schema[0]

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        own = int(pdf["own"].sum())
        if not own:
            return pd.DataFrame({c: [] for c in ("category", "_block", "beyond", "begun")}, dtype=object)
        beyond, begun = _ahead(pdf["size"].to_numpy(), own, most_items, most_bytes)
        return pd.DataFrame({"category": pdf["category"][:1], "_block": pdf["_block"][:1], "beyond": [beyond], "begun": [begun]})

    blocks = StructType([category, *StructType.fromDDL("_block long, beyond array<long>, begun array<long>")])
    found = seen.groupBy("category", "_block").applyInPandas(summary, blocks).repartition("category").sortWithinPartitions("category", "_block")
    entries = found.mapInArrow(_chained, StructType([category, *StructType.fromDDL("_block long, _entry long, _before long")]))
    entries = entries.withColumnsRenamed({"category": "_category", "_block": "_of"})
    joined = seen.join(entries, F.col("category").eqNullSafe(F.col("_category")) & (F.col("_block") == F.col("_of"))).drop("_category", "_of")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        own = int(pdf["own"].sum())
        heads, begins, at = _next_heads(pdf["size"].to_numpy(), most_items, most_bytes), np.zeros(own, np.int64), int(pdf["_entry"].iloc[0])
        while at < own:
            begins[at] = 1
            at = int(heads[at])
        return pd.DataFrame({"_place": pdf["place"].to_numpy()[:own], "chunk": pdf["_before"].iloc[0] + np.cumsum(begins)})

    chunk = joined.groupBy("category", "_block").applyInPandas(fill, "_place long, chunk long")
    return placed.join(chunk, "_place").select(*items.columns, "chunk")


def chunks(items: DataFrame, most_items: int = MOST_ITEMS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(category, item_id, chunk) of each item: see chunked."""
    return chunked(items.select("category", "item_id", "bytes"), most_items, most_bytes).drop("bytes")


def sized(items: DataFrame) -> DataFrame:
    """items with `bytes`, the size of each as JSON."""
    return items.withColumn("bytes", F.octet_length(F.to_json(F.struct(*items.columns))).cast("long"))


def write(items: DataFrame, path: str) -> None:
    """Items as JSON lines in a folder for each category and chunk, and the indexes: `item_index` (where each item is), `categories`, `object_stats`, `object_groups`, `top_objects` and `main_index`.

    items: (category, item_id, ...), of which object and title are used if there.
    """
    placed = stored(chunked(sized(items)), "chunked")
    placed.drop("bytes").repartition("category", "chunk").write.partitionBy("category", "chunk").json(f"{path}/items")
    placed.select("category", "chunk", "item_id", "bytes", *(c for c in ("object", "title") if c in items.columns)).write.json(f"{path}/item_index")
    categories = stored(category_index(placed), "categories")
    categories.coalesce(1).write.json(f"{path}/categories")
    summary = main_index(categories)
    if "object" in items.columns:
        stats = stored(object_stats(placed, title="title" if "title" in items.columns else None), "objects")
        stats.write.json(f"{path}/object_stats")
        grouped_objects(stats).write.json(f"{path}/object_groups")
        top_objects(stats).coalesce(1).write.json(f"{path}/top_objects")
        summary = summary.crossJoin(stats.agg(F.count(F.lit(1)).alias("objects")))  # one row each
    summary.write.json(f"{path}/main_index")


class _Chunks(StatefulProcessor):
    """Deals the items of a category to chunks; the open chunk, its items and bytes are state and go on across batches."""

    def __init__(self, most_items: int, most_bytes: int):
        self.most_items, self.most_bytes = most_items, most_bytes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "chunk long, items long, held long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["item_id", "bytes"], kind="stable", na_position="first")
        chunk, n, held = self.open.get() if self.open.exists() else (1, 0, 0)
        out = []
        for size in pdf["bytes"].fillna(0).astype("int64").tolist():
            if n and (n >= self.most_items or held + size > self.most_bytes):
                chunk, n, held = chunk + 1, 0, 0
            n, held = n + 1, held + size
            out.append(chunk)
        self.open.update((chunk, n, held))
        yield pdf.assign(chunk=out)

    def close(self) -> None:
        pass


def stream_chunks(items: DataFrame, most_items: int = MOST_ITEMS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """A stream of items (category, item_id, bytes, ...) with `chunk`, dealt as they come: a chunk goes on from batch to batch.

    Within a batch the items of a category go by id, then size, so items that come in that order are dealt as `chunked` deals them, however
    they are cut into batches. The items of one category and batch are held at once; the source's limit on a batch bounds them.
    """
    items.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = StructType([*items.schema, *StructType.fromDDL("chunk long")])
    return items.groupBy("category").transformWithStateInPandas(_Chunks(most_items, most_bytes), schema, "Append", "None")


def write_stream(items: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer of a stream of items (category, item_id, ...) to folders of category and chunk; with the checkpoint each item is there once, whatever fails between."""
    dealt = stream_chunks(sized(items)).drop("bytes")
    return dealt.writeStream.format("json").partitionBy("category", "chunk").option("path", path).option("checkpointLocation", checkpoint)


def read(spark: SparkSession, path: str, schema: str, category: str | None = None) -> DataFrame:
    """Items as written; of one category only its folder is read."""
    got = spark.read.schema(f"{schema}, category string, chunk long").json(f"{path}/items")
    return got if category is None else got.where(F.col("category") == category)


def category_index(placed: DataFrame) -> DataFrame:
    """(category, items, files, bytes, items_per_file) over (category, item_id, bytes, chunk)."""
    got = placed.groupBy("category").agg(F.count(F.lit(1)).alias("items"), F.max("chunk").alias("files"), F.sum("bytes").alias("bytes"))
    return got.withColumn("items_per_file", F.col("items") / F.col("files"))


def main_index(categories: DataFrame) -> DataFrame:
    """Totals over category_index: items, files, bytes, and items for each file."""
    sums = categories.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("items", "files", "bytes")))
    return sums.withColumn("items_per_file", F.when(F.col("files") > 0, F.col("items") / F.col("files")).otherwise(0.0))


def object_stats(items: DataFrame, kinds: tuple[str, ...] = ("methods", "properties", "functions", "operators"), title: str | None = None) -> DataFrame:
    """(object, <kind> ..., english_name): how many items of each kind an object has, and the greatest English name among its titles if `title` is given. items: (object, category)."""
    english = [] if title is None else [F.max(second_name(F.col(title))).alias("english_name")]
    return items.groupBy("object").agg(*(F.count_if(F.col("category") == k).alias(k) for k in kinds), *english)


def top_objects(stats: DataFrame, by: str = "methods", first: int = 10) -> DataFrame:
    """The objects with most members of a kind."""
    return stats.orderBy(F.desc(by), "object").limit(first)


def object_group(name: Column) -> Column:
    return F.coalesce(mapped(name, {n: g for g, names in OBJECT_GROUPS.items() for n in names}), F.lit("other"))


def grouped_objects(objects: DataFrame) -> DataFrame:
    """(group, objects): names of each group in order."""
    return objects.select("object").distinct().groupBy(object_group(F.col("object")).alias("group")).agg(F.array_sort(F.collect_list("object")).alias("objects"))


def by_object(items: DataFrame, part: str) -> DataFrame:
    """Items whose object's name holds `part`."""
    return items.where(F.contains("object", F.lit(part)))


def search_methods(methods: DataFrame, query: str) -> DataFrame:
    """Methods whose name or description holds the query, whatever the case."""
    q = F.lit(query.lower())
    return methods.where(F.contains(F.lower("name"), q) | F.coalesce(F.contains(F.lower("description"), q), F.lit(False)))


def look_ahead(lines: DataFrame, found: Column, stop: Column, most: int = 9) -> DataFrame:
    """lines (doc_id, line, body) with `ahead`: the first `found` of the next lines, none past one where `stop` holds.

    A window over each document; `found` is null where a line has nothing.
    """
    after = Window.partitionBy("doc_id").orderBy("line").rowsBetween(1, most)
    seen = F.collect_list(F.struct(found.alias("value"), stop.alias("stop"))).over(after)
    cut = F.array_position(F.transform(seen, lambda x: F.coalesce(x["stop"], F.lit(False))), True)
    open_ = F.when(cut > 0, F.slice(seen, 1, (cut - 1).cast("int"))).otherwise(seen)
    values = F.transform(F.filter(open_, lambda x: x["value"].isNotNull()), lambda x: x["value"])
    return lines.withColumn("ahead", F.get(values, F.lit(0)))
