"""Sharding by a k-d tree.

Every document is a point with a weight (its bytes). A node of the tree that is to give several shards
is split along the dimension whose values in it spread widest, measured against the spread of the whole
table, at the weighted quantile that leaves each side the bytes of its shards: the median where the
sides get equally many. Quantiles are found by histograms: one aggregation counts the bytes in 4096
ranges of every node's interval, the range that holds the quantile becomes the next interval, until it
is one value. Only bounds of nodes, never rows, come to the driver.

Equal points stay together where the sizes allow: a cut falls between two values, and inside one value
only if that value alone weighs more than `slack` of a shard, which is what keeps sizes near equal; then the text's checksum and after it the
row's id decide in the same way.

Law: sizes of shards near equal in bytes. Defined cases: null text has no bytes and the checksum of the
empty text; null metadata is the least value; rows equal in every respect may be split from one another
only by row number, so a group larger than a shard is shared out; an empty table gives no row; a very
long text is a point of its weight; with fewer rows than shards some shards are empty; columns that a dimension names are read, others not.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm._util import stored

FIXED_BYTES = 8
_RANGES = 4096
_SLOT_ROWS = 1_000_000


@dataclass
class _Node:
    """An open node: its shards, weight, and the cut that is being narrowed down."""

    id: int
    first: int
    shards: int
    total: int
    key: int = 0  # which of the keys is being searched
    keys: list[str] = field(default_factory=list)
    fixed: list[tuple[str, int]] = field(default_factory=list)  # keys narrowed to one value
    low: int = 0
    high: int = 0
    before: int = 0  # bytes under `low`
    cut: int | None = None  # the left side has values under it


def shard_points(docs: DataFrame, dims: dict[str, Column]) -> DataFrame:
    """(doc_id, size, text_crc32, row, d_<dim> ...): each document as a point of long coordinates."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit(""))
    coords = [F.coalesce(c.cast("long"), F.lit(-(1 << 40))).alias(f"d_{n}") for n, c in dims.items()]
    size = F.when(F.col("text").isNull(), 0).otherwise(F.octet_length(raw)) + FIXED_BYTES
    return docs.select(F.col("doc_id").cast("long"), size.cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.monotonically_increasing_id().alias("row"), *coords)


def kd_shards(docs: DataFrame, dims: dict[str, Column], shards: int | None = None, target_bytes: int | None = None, slack: float = 0.05) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): leaves of the tree, as many as given or as target_bytes asks for."""
    spark = docs.sparkSession
    points = stored(shard_points(docs, dims), "points")
    names = [f"d_{d}" for d in dims]
    keys = [*names, "text_crc32", "row"]
    stats = points.agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"), *_ends(keys)).first().asDict()
    total, n = stats["w"] or 0, stats["n"]
    if shards is None:
        shards = max(1, -(-total // target_bytes))
    whole = {c: max(1, (stats[f"hi_{c}"] or 0) - (stats[f"lo_{c}"] or 0)) for c in names}
    share = total / shards
    rows = points.withColumn("node", F.lit(0))
    open_, done, next_id = [_node(0, 0, shards, stats, names, whole)] if n else [], {}, 1
    if shards == 1 or not n:
        open_, done = [], {0: 0}
    while open_:
        _search(rows, open_, share * slack)
        splits, children = [], []
        for node in open_:
            left, right = next_id, next_id + 1
            next_id += 2
            splits.append((node, left, right))
            half = node.shards // 2
            children += [(left, node.first, half), (right, node.first + half, node.shards - half)]
        rows = stored(_assign(rows, splits), "tree")
        found = rows.where(F.col("node") >= children[0][0]).groupBy("node").agg(F.sum("size").alias("w"), *_ends(keys))
        by = {r.node: r.asDict() for r in found.collect()}  # a row for each node
        open_ = []
        for id_, first, k in children:
            if k == 1 or id_ not in by:
                done[id_] = first
            else:
                open_.append(_node(id_, first, k, by[id_], names, whole))
    leaves = F.broadcast(spark.createDataFrame(sorted(done.items()), "node int, shard int"))  # a row for each shard
    placed = rows.join(leaves, "node").select("doc_id", "size", "text_crc32", "row", "shard")
    return number_slots(placed, n)


def _ends(keys: list[str]) -> list[Column]:
    return [f(c).alias(f"{p}_{c}") for c in keys for p, f in (("lo", F.min), ("hi", F.max))]


def _node(id_: int, first: int, shards: int, stats: dict, names: list[str], whole: dict[str, int]) -> _Node:
    """An open node that is searched by its widest dimension, then by checksum and row."""
    widest = max(names, key=lambda c: (stats[f"hi_{c}"] - stats[f"lo_{c}"]) / whole[c])
    return _Node(id_, first, shards, stats["w"], keys=[widest, "text_crc32", "row"], low=stats[f"lo_{widest}"], high=stats[f"hi_{widest}"] + 1)


def _search(rows: DataFrame, nodes: list[_Node], slack: float) -> None:
    """Narrows the interval of every node down to its cut; one aggregation a round serves all nodes."""
    spark = rows.sparkSession
    while active := [x for x in nodes if x.cut is None]:
        schema = "node int, key string, low long, high long, step long, c1 string, v1 long, v2 long, before long, want long"
        bounds = []
        for x in active:
            fixed = [*x.fixed, ("", 0), ("", 0)][:2]
            want = x.total * (x.shards // 2) // x.shards
            bounds.append((x.id, x.keys[x.key], x.low, x.high, max(1, -(-(x.high - x.low) // _RANGES)), fixed[0][0], fixed[0][1], fixed[1][1], x.before, want))
        b = F.broadcast(spark.createDataFrame(bounds, schema))  # a row for each node
        value = F.lit(None).cast("long")
        same = F.col("c1") == ""
        for c in sorted({k for x in active for k in x.keys}):
            value = F.when(F.col("key") == c, F.col(c)).otherwise(value)
            same = same | ((F.col("c1") == c) & (F.col(c) == F.col("v1")))
        second = (F.col("key") != "row") | (F.col("text_crc32") == F.col("v2"))
        seen = rows.join(b, "node").withColumn("value", value).where(same & second & (F.col("value") >= F.col("low")) & (F.col("value") < F.col("high")))
        sums = seen.groupBy("node", F.floor((F.col("value") - F.col("low")) / F.col("step")).alias("range"), "before", "want").agg(F.sum("size").alias("w"), F.min("value").alias("first"), F.max("value").alias("last"))
        w = Window.partitionBy("node").orderBy("range")
        run = sums.select("*", (F.col("before") + F.sum("w").over(w)).alias("upto"), F.lead("first").over(w).alias("following"))
        hit = run.where("upto > want or following is null").groupBy("node").agg(F.min_by(F.struct("w", "first", "last", "upto", "following"), "range").alias("hit"))
        found = {r.node: r.hit for r in hit.collect()}  # a row for each node
        for x in active:
            _narrow(x, found[x.id], slack)


def _narrow(x: _Node, hit, slack: float) -> None:
    want = x.total * (x.shards // 2) // x.shards
    x.before = hit["upto"] - hit["w"]
    if hit["w"] <= slack or (hit["first"] == hit["last"] and x.key == len(x.keys) - 1):
        near_end = hit["upto"] - want < want - x.before
        x.cut = hit["last"] + 1 if near_end else hit["first"]
    elif hit["first"] == hit["last"]:
        x.fixed.append((x.keys[x.key], hit["first"]))
        x.key += 1
        x.low, x.high = (0, 1 << 32) if x.keys[x.key] == "text_crc32" else (0, 1 << 62)
    else:
        x.low, x.high = hit["first"], hit["last"] + 1


def _assign(rows: DataFrame, splits: list[tuple[_Node, int, int]]) -> DataFrame:
    """Moves the rows of split nodes to their left or right child, keys compared in turn."""
    spark = rows.sparkSession
    table = []
    for x, left, right in splits:
        values = [v for _, v in x.fixed] + [x.cut]
        table.append((x.id, x.keys[0], len(values), *(values + [0, 0])[:3], left, right))
    s = F.broadcast(spark.createDataFrame(table, "node int, key string, depth int, a long, b long, c long, left long, right long"))  # a row for each node
    value = F.lit(None).cast("long")
    for k in sorted({x.keys[0] for x, _, _ in splits}):
        value = F.when(F.col("key") == k, F.col(k)).otherwise(value)
    one, two, three = (F.col("depth") == d for d in (1, 2, 3))
    under = F.when(one, value < F.col("a"))
    tie = value == F.col("a")
    under = under.when(two, (value < F.col("a")) | (tie & (F.col("text_crc32") < F.col("b"))))
    under = under.when(three, (value < F.col("a")) | (tie & ((F.col("text_crc32") < F.col("b")) | ((F.col("text_crc32") == F.col("b")) & (F.col("row") < F.col("c"))))))
    child = F.when(F.col("left").isNull(), F.col("node")).when(under, F.col("left")).otherwise(F.col("right")).cast("int")
    return rows.join(s, "node", "left").select(*(c for c in rows.columns if c != "node"), child.alias("node"))


def number_slots(placed: DataFrame, n_rows: int) -> DataFrame:
    """Adds `slot`, gapless from 0 in every shard. A shard is numbered in parts of bounded size, by row."""
    parts = max(1, -(-n_rows // _SLOT_ROWS))
    rows = placed.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("k"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "part", F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "row")
    numbered = rows.withColumn("inside", F.row_number().over(inside) - 1)
    return numbered.join(base, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("inside")).cast("long").alias("slot"))
