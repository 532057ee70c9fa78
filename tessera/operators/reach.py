"""Whether one node reaches another along edges (child, parent), by an index in proportion to the graph.

Nodes of one cycle are one node. Of several parents the least is the tree's; a walk around the trees numbers
the nodes that have children, so that ancestors in the tree are intervals that hold a number; a node without
children stands at its parent's number. Edges outside the trees are kept with, for each node, the nearest of its
tree ancestors that has one: a question that the intervals don't answer goes on over those edges, and is asked
again where they lead. Edges that the tree shows to be needless are taken out first, if they are many, so that
questions don't go along a chain link by link. The walk's numbers are sums of sizes along the way to the root, by
pointer jumping, so its rounds grow with the logarithm of the depth. No pair that isn't asked for is made.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.cycles import chain_ends, on_cycles
from tessera.shared import stored, summed_before


@dataclass
class ReachIndex:
    """nodes: (node, component, on_cycle); labels: (component, enter, leave, up, gate) with up the tree's parent and gate the nearest of itself and its tree ancestors with an edge outside the tree; others: (component, parent) those edges."""

    nodes: DataFrame
    labels: DataFrame
    others: DataFrame


def _walk(tree: DataFrame) -> DataFrame:
    """(component, enter, leave): places in a walk around the trees of (component, up).

    Those of a node's descendants lie from enter to leave. A node without children has its parent's place and an
    empty interval; without a parent too, it has none.
    """
    inner = tree.join(tree.where("up is not null").select(F.col("up").alias("component")).distinct(), "component", "left_semi")
    got = stored(inner.select("component", "up", F.col("up").alias("to"), F.lit(1).cast("long").alias("size")), "sizes")
    while not got.where("to is not null").isEmpty():
        # `size` counts what lies less than 2^i below, `to` is 2^i above
        more = got.where("to is not null").groupBy(F.col("to").alias("component")).agg(F.sum("size").alias("_size"))
        ahead = got.select(F.col("component").alias("to"), F.col("to").alias("_to"))
        joined = got.join(ahead, "to", "left").join(more, "component", "left")
        got = stored(joined.select("component", "up", F.col("_to").alias("to"), (F.col("size") + F.coalesce("_size", F.lit(0))).alias("size")), "sizes")
    before = stored(summed_before(got.select("component", "up", "size"), [F.col("up").asc_nulls_first(), F.col("component").asc()], "size", "before", "siblings"), "before")
    first = before.where("up is not null").groupBy("up").agg(F.min("before").alias("_first"))
    way = before.join(first, "up", "left").select("component", "up", "size", F.col("up").alias("to"), (F.col("before") - F.coalesce("_first", F.lit(0)) + 1).alias("enter"))
    way = stored(way, "ways")
    while not way.where("to is not null").isEmpty():
        ahead = way.select(F.col("component").alias("to"), F.col("to").alias("_to"), F.col("enter").alias("_enter"))
        way = stored(way.join(ahead, "to", "left").select("component", "up", "size", F.col("_to").alias("to"), (F.col("enter") + F.coalesce("_enter", F.lit(0))).alias("enter")), "ways")
    own = way.select("component", "enter", (F.col("enter") + F.col("size") - 1).alias("leave"))
    leaves = tree.join(way.select("component"), "component", "left_anti").join(way.select(F.col("component").alias("up"), "enter"), "up", "left")
    return own.unionByName(leaves.select("component", "enter", (F.col("enter") - 1).alias("leave")))


def _needed(whole: DataFrame, places: DataFrame) -> DataFrame:
    """Edges (component, parent) but those to a tree ancestor of another parent: the way over that one leads there too."""
    rows = whole.join(places.select(F.col("component").alias("parent"), "enter", "leave"), "parent", "left")
    # of nested intervals the outer begins first, so what lies in one comes right after its start
    after = F.lead("enter").over(Window.partitionBy("component").orderBy(F.col("enter").asc_nulls_last(), F.col("leave").desc()))
    return rows.withColumn("_after", after).where(~F.coalesce(F.col("_after") <= F.col("leave"), F.lit(False))).select("component", "parent")


def build(edges: DataFrame) -> ReachIndex:
    """The index of edges (child, parent); edges with a null end count for nothing."""
    edges = edges.select("child", "parent").where("child is not null and parent is not null").distinct()
    cycles = on_cycles(edges.select(F.col("child").alias("src"), F.col("parent").alias("dst")))
    ids = edges.select(F.col("child").alias("node")).union(edges.select("parent")).distinct()
    nodes = stored(ids.join(cycles, "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.col("component").isNotNull().alias("on_cycle")), "nodes")
    a, b = (nodes.select(F.col("node").alias(c), F.col("component").alias(f"_{c}")) for c in ("child", "parent"))
    whole = stored(edges.join(a, "child").join(b, "parent").where("_child != _parent").select(F.col("_child").alias("component"), F.col("_parent").alias("parent")).distinct(), "edges")
    components = stored(nodes.select("component").distinct(), "components")
    while True:
        up = stored(whole.groupBy("component").agg(F.min("parent").alias("up"), (F.count(F.lit(1)) > 1).alias("branches")), "ups")
        tree = stored(components.join(up.select("component", "up"), "component", "left"), "tree")
        places = stored(_walk(tree), "places")
        n, outside = whole.count(), whole.count() - up.count()
        if not outside:
            break
        slim = stored(_needed(whole, places), "edges")
        if 2 * (n - slim.count()) < outside:
            break
        whole = slim
    labels = places.join(tree, "component", "left")
    others = stored(whole.join(up.select("component", "up"), "component").where("parent != up").select("component", "parent"), "others")
    if not outside:
        return ReachIndex(nodes, stored(labels.select("component", "enter", "leave", "up", F.lit(None).cast(tree.schema["up"].dataType).alias("gate")), "labels"), others)
    gates = up.where("branches").select("component")
    onward = chain_ends(up.where("not branches").select(F.col("component").alias("node"), F.col("up").alias("to")))
    gate = gates.select("component", F.col("component").alias("gate")).unionByName(onward.select(F.col("node").alias("component"), F.col("to").alias("gate")).join(gates.withColumnRenamed("component", "gate"), "gate", "left_semi").select("component", "gate"))
    return ReachIndex(nodes, stored(labels.join(gate, "component", "left").select("component", "enter", "leave", "up", "gate"), "labels"), others)


def reachable(pairs: DataFrame, index: ReachIndex) -> DataFrame:
    """Distinct pairs (from_id, to_id) of `pairs` where from_id reaches to_id over one edge or more."""
    asked = pairs.select("from_id", "to_id").where("from_id is not null and to_id is not null").distinct()
    a, b = (index.nodes.select(F.col("node").alias(f"{c}_id"), F.col("component").alias(c), F.col("on_cycle").alias(f"_{c}")) for c in ("from", "to"))
    rows = stored(asked.join(a, "from_id").join(b, "to_id"), "asked")
    together = rows.where("`from` = `to` and (from_id != to_id or _from)").select("from_id", "to_id")
    target = index.labels.select(F.col("component").alias("to"), F.col("enter").alias("_enter"), F.col("leave").alias("_leave"))
    at = index.labels.select(F.col("component").alias("at"), "enter", "gate")
    gates = index.labels.select(F.col("component").alias("gate"), F.col("up").alias("_up"))
    over = index.others.select(F.col("component").alias("gate"), "parent").unionByName(gates.where("_up is not null").select("gate", F.col("_up").alias("parent")))
    last = rows.where("`from` != `to`").select("from", "to", F.col("from").alias("at")).distinct()
    found: list[DataFrame] = []
    known: list[DataFrame] = []
    while True:
        inside = (F.col("at") == F.col("to")) | F.coalesce((F.col("enter") >= F.col("_enter")) & (F.col("enter") <= F.col("_leave")), F.lit(False))
        tried = stored(last.join(at, "at", "left").join(target, "to", "left").select("from", "to", "at", "gate", inside.alias("_in")), "tried")
        if tried.isEmpty():
            break
        known.append(tried.select("from", "to", "at"))
        found.append(tried.where("_in").select("from", "to"))
        if tried.where("gate is not null").isEmpty():
            break
        answered = reduce(DataFrame.unionByName, found).distinct()
        step = tried.where("gate is not null").join(answered, ["from", "to"], "left_anti").join(over, "gate").select("from", "to", F.col("parent").alias("at")).distinct()
        last = step.join(reduce(DataFrame.unionByName, known), ["from", "to", "at"], "left_anti")
    if not found:
        return together
    hits = reduce(DataFrame.unionByName, found).distinct()
    return together.unionByName(rows.join(hits, ["from", "to"], "left_semi").select("from_id", "to_id")).distinct()
