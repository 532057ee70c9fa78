"""Trees as rows, their digests from the leaves up, and what two versions of a tree share.

A node is a row (doc_id, node_id, parent_id, ordinal, kind, start, len, payload); a root has no parent. A node's digest covers
its kind, span, payload and the digests of its children in order. Levels are found from the roots down and digests
made from the deepest level up, one join a level, so the rounds are as many as the trees are deep.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.shared import stored


def leveled(nodes: DataFrame) -> tuple[DataFrame, int]:
    """nodes with `depth`, and the number of levels. Nodes that no root leads to are left out."""
    rows = stored(nodes, "tree")
    last = stored(rows.where("parent_id is null").withColumn("depth", F.lit(0)), "level")
    parts = []
    while not last.isEmpty():
        parts.append(last)
        up = last.select("doc_id", F.col("node_id").alias("parent_id"))
        last = stored(rows.join(up, ["doc_id", "parent_id"]).select(*rows.columns).withColumn("depth", F.lit(len(parts))), "level")
    return reduce(DataFrame.unionByName, parts) if parts else last, len(parts)


def _short(*parts: str) -> Column:
    """A digest of columns: 128 bits of SHA-256 in 24 characters."""
    return F.base64(F.unhex(F.left(F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256), F.lit(32))))


def digests(nodes: DataFrame, spans: bool = True) -> DataFrame:
    """(doc_id, node_id, parent_id, ordinal, digest, height, size) of each node; without spans, a tree that only moved keeps its digests."""
    # payloads are neither stored nor sent: what a node shows of itself comes first as a digest
    own = _short("kind", *(("start", "len") if spans else ()), "payload")
    placed, levels = leveled(nodes.select("doc_id", "node_id", "parent_id", "ordinal", own.alias("own")))
    below = None
    parts = []
    for depth in range(levels - 1, -1, -1):
        rows = placed.where(F.col("depth") == depth)
        if below is None:
            rows = rows.withColumns({"inner": F.array().cast("array<string>"), "height": F.lit(0), "size": F.lit(1).cast("long")})
        else:
            kids = below.groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("ordinal", "node_id", "digest"))).alias("kids"), (F.max("height") + 1).alias("height"), (F.sum("size") + 1).alias("size"))
            rows = rows.join(kids, ["doc_id", "node_id"], "left").withColumns({"inner": F.coalesce("kids.digest", F.array().cast("array<string>")), "height": F.coalesce("height", F.lit(0)), "size": F.coalesce("size", F.lit(1).cast("long"))})
        below = stored(rows.select("doc_id", "node_id", "parent_id", "ordinal", _short("own", "inner").alias("digest"), "height", "size"), "digests")
        parts.append(below)
    if not parts:
        return placed.select("doc_id", "node_id", "parent_id", "ordinal", F.lit("").alias("digest"), F.lit(0).alias("height"), F.lit(0).cast("long").alias("size"))
    return reduce(DataFrame.unionByName, parts)


def positional_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, nodes, changed, reused, reused_subtrees) of trees of the same size, node by node; both are what digests gives.

    A subtree is reused if its root has the digest that it had and its parent has not; a whole tree is one.
    """
    size = lambda d, n: d.groupBy("doc_id").agg(F.count(F.lit(1)).alias(n))
    alike = size(old, "a").join(size(new, "b"), "doc_id").where("a = b").select("doc_id")
    pairs = stored(old.join(alike, "doc_id", "left_semi").join(new.select("doc_id", "node_id", F.col("digest").alias("now")), ["doc_id", "node_id"]).select("doc_id", "node_id", "parent_id", (F.col("digest") == F.col("now")).alias("same")), "pairs")
    up = pairs.select("doc_id", F.col("node_id").alias("parent_id"), F.col("same").alias("_up"))
    rows = pairs.join(up, ["doc_id", "parent_id"], "left")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(~F.col("same")).alias("changed"), F.count_if("same").alias("reused"), F.count_if(F.col("same") & ~F.coalesce("_up", F.lit(False))).alias("reused_subtrees"))


def matched(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, node_id, was, reused): every new node; `was` is the old root of the same digest for the top node of a reused subtree, and all nodes of it are `reused`.

    The highest subtrees are matched first; of several with one digest the first by node_id goes with the first. What lies in a matched
    subtree, old or new, isn't matched again, so each is used once. Trees need not be of one size.
    """
    top = max([r.h for r in (d.agg(F.max("height").alias("h")).first() for d in (old, new)) if r.h is not None], default=-1)
    olds, news = (d.select("doc_id", "node_id", "parent_id", "digest", "height") for d in (old, new))
    nth = F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy("node_id"))
    # a node is settled once its parent, which is higher, is: taken says that it lies in a matched subtree
    done: dict[str, list[DataFrame]] = {"old": [], "new": []}

    def open_rows(rows: DataFrame, side: str, height: int) -> DataFrame:
        level = rows.where(F.col("height") == height)
        if not done[side]:
            return level.withColumn("taken", F.lit(False))
        up = reduce(DataFrame.unionByName, done[side]).select("doc_id", F.col("node_id").alias("parent_id"), "taken")
        return level.join(up, ["doc_id", "parent_id"], "left").withColumn("taken", F.coalesce("taken", F.lit(False)))

    for height in range(top, -1, -1):
        a, b = stored(open_rows(olds, "old", height), "open"), stored(open_rows(news, "new", height), "open")
        left = a.where("not taken").withColumn("nth", nth).select("doc_id", "digest", "nth", F.col("node_id").alias("was"))
        pairs = stored(b.where("not taken").withColumn("nth", nth).join(left, ["doc_id", "digest", "nth"]).select("doc_id", "node_id", "was"), "pairs")
        ours = b.join(pairs, ["doc_id", "node_id"], "left")
        theirs = a.join(pairs.select("doc_id", F.col("was").alias("node_id"), F.lit(True).alias("_hit")), ["doc_id", "node_id"], "left")
        done["new"].append(stored(ours.select("doc_id", "node_id", "was", (F.col("taken") | F.col("was").isNotNull()).alias("taken")), "done"))
        done["old"].append(stored(theirs.select("doc_id", "node_id", (F.col("taken") | F.col("_hit").isNotNull()).alias("taken")), "done"))
    if not done["new"]:
        return news.select("doc_id", "node_id", F.col("node_id").alias("was"), F.lit(False).alias("reused"))
    return reduce(DataFrame.unionByName, done["new"]).select("doc_id", "node_id", "was", F.col("taken").alias("reused"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, nodes, changed, reused, reused_subtrees) over matched."""
    return matched(old, new).groupBy("doc_id").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(~F.col("reused")).alias("changed"), F.count_if("reused").alias("reused"), F.count_if(F.col("was").isNotNull()).alias("reused_subtrees"))
