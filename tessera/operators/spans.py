"""Places in texts: offset to line, overlaps of spans, and what a change touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def line_starts(docs: DataFrame) -> DataFrame:
    """(doc_id, line, start): byte offset of each line, lines from 0."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "body"))
    before = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("body") + 1).over(before), F.lit(0))
    return rows.select("doc_id", "line", start.alias("start"))


def offset_to_line(offsets: DataFrame, starts: DataFrame) -> DataFrame:
    """(doc_id, offset, line, column_no): the last line that starts at or before an offset.

    Offsets and line starts are put in one order in each document and the last start is carried on, so
    no pair of offset and line is made.
    """
    points = starts.select("doc_id", F.col("start").alias("at"), F.lit(0).alias("is_offset"), F.struct("line", "start").alias("mark"))
    asked = offsets.select("doc_id", F.col("offset").alias("at"), F.lit(1).alias("is_offset"), F.lit(None).cast("struct<line:int,start:bigint>").alias("mark"))
    w = Window.partitionBy("doc_id").orderBy("at", "is_offset").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = points.unionByName(asked).withColumn("hit", F.last("mark", ignorenulls=True).over(w)).where("is_offset = 1")
    return found.select("doc_id", F.col("at").alias("offset"), F.col("hit.line").alias("line"), (F.col("at") - F.col("hit.start")).alias("column_no"))


def overlaps(spans: DataFrame, ranges: DataFrame, width: int) -> DataFrame:
    """Pairs of spans (doc_id, span_id, start, end) and ranges (doc_id, range_id, lo, hi) that overlap; an empty range is an insertion point.

    Both sides are cut into cells of `width`; a pair is made in the first cell that both lie in.
    """
    cell = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    s, r = spans.withColumn("cell", cell("start", "end")), ranges.withColumn("cell", cell("lo", "hi"))
    touch = F.when(F.col("lo") == F.col("hi"), (F.col("start") <= F.col("lo")) & (F.col("end") >= F.col("lo"))).otherwise((F.col("start") < F.col("hi")) & (F.col("end") > F.col("lo")))
    first = F.col("cell") == F.greatest(F.floor(F.col("start") / width), F.floor(F.col("lo") / width))
    return s.join(r, ["doc_id", "cell"]).where(touch & first).drop("cell")


def topmost(overlapping: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Nodes (doc_id, node_id) that overlap and have no overlapping ancestor; ancestors: (doc_id, node_id, ancestor)."""
    hit = overlapping.select("doc_id", F.col("node_id").alias("ancestor"))
    covered = ancestors.join(hit, ["doc_id", "ancestor"], "left_semi").select("doc_id", "node_id")
    return overlapping.join(covered, ["doc_id", "node_id"], "left_anti")


def deepest(overlapping: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that overlap and have no overlapping child; nodes: (doc_id, node_id, parent_id)."""
    inner = nodes.join(overlapping.select("doc_id", "node_id"), ["doc_id", "node_id"], "left_semi").select("doc_id", F.col("parent_id").alias("node_id"))
    return overlapping.join(inner, ["doc_id", "node_id"], "left_anti")


def dirty_range(old: Column, new: Column) -> Column:
    """struct<start, old_end, new_end> in bytes: what remains after the common prefix and suffix of two texts.

    Found by bisection on the length of the common prefix and then of the suffix, all in column
    expressions. Lengths are 32-bit, as those of any string column are; 40 halvings are more than they need.
    """
    a, b = old.cast("binary"), new.cast("binary")
    least = F.least(F.length(a), F.length(b))

    def longest(most: Column, same) -> Column:
        start = F.struct(F.lit(0).alias("lo"), most.cast("int").alias("hi"))

        def halve(acc: Column, _: Column) -> Column:
            mid = F.floor((acc["lo"] + acc["hi"] + 1) / 2).cast("int")
            ok = same(mid)
            return F.struct(F.when(ok, mid).otherwise(acc["lo"]).alias("lo"), F.when(ok | (acc["lo"] >= acc["hi"]), acc["hi"]).otherwise(mid - 1).alias("hi"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(40)), start, halve, lambda acc: acc["lo"])

    prefix = longest(least, lambda n: F.substring(a, 1, n) == F.substring(b, 1, n))
    suffix = longest(least - prefix, lambda n: F.substring(a, F.length(a) - n + 1, n) == F.substring(b, F.length(b) - n + 1, n))
    return F.struct(prefix.alias("start"), (F.length(a) - suffix).alias("old_end"), (F.length(b) - suffix).alias("new_end"))
