"""Strongly connected components of large graphs: which nodes lie on cycles, and on which.

Nodes that can't lie on a cycle are trimmed, chains of them at once, and paths through nodes with one edge in and one out are cut
short to one edge by pointer jumping, so that chains and trees of any depth go in a few rounds. What is left is
coloured: each node takes the least node that reaches it; nodes of a colour that reach the node it is named for
are one component. Found components leave the graph, and the rest begins anew. No pair of nodes is made that
isn't an edge; every round is written to the shared folder. As soon as no more than FEW_EDGES edges are left,
which are counted, one task finishes them by a depth-first search, with the same result in one job instead of many.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from tessera.shared import stored

FEW_EDGES = 100_000


def components_of_few(edges: list[tuple]) -> dict:
    """The component of each node of more than itself, by its least node: a depth-first search with a stack of its own."""
    onward: dict = {}
    for a, b in edges:
        onward.setdefault(a, []).append(b)
    order: dict = {}
    low: dict = {}
    open_nodes: list = []
    inside, out = set(), {}
    for start in onward:
        if start in order:
            continue
        order[start] = low[start] = len(order)
        open_nodes.append(start)
        inside.add(start)
        path = [(start, iter(onward[start]))]
        while path:
            node, rest = path[-1]
            for to in rest:
                if to not in order:
                    order[to] = low[to] = len(order)
                    open_nodes.append(to)
                    inside.add(to)
                    path.append((to, iter(onward.get(to, ()))))
                    break
                if to in inside:
                    low[node] = min(low[node], order[to])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[node])
                if low[node] == order[node]:
                    at = open_nodes.index(node) if open_nodes[-1] != node else len(open_nodes) - 1
                    group = open_nodes[at:]
                    del open_nodes[at:]
                    inside.difference_update(group)
                    if len(group) > 1:
                        out |= dict.fromkeys(group, min(group))
    return out


def _finished(edges: DataFrame) -> DataFrame:
    """(node, component) of at most FEW_EDGES edges, in one task."""
    schema = StructType([StructField(c, edges.schema["src"].dataType) for c in ("node", "component")])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = components_of_few([e for b in batches for e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)])
        yield pa.RecordBatch.from_pylist([{"node": n, "component": c} for n, c in found.items()], kinds)

    return stored(edges.select("src", "dst").repartition(1).mapInArrow(run, schema), "components")


def _both_ways(edges: DataFrame) -> DataFrame:
    """Edges whose start has an edge in and whose end has an edge out."""
    into, out = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
    return edges.join(into, "src", "left_semi").join(out, "dst", "left_semi")


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges without those from a node that no cycle leads to, and those to a node that leads to none, as far as sole edges tell.

    A node with one edge in lies on a cycle only if the node before it does. So a whole chain of such nodes goes
    at once if it begins where no edge comes in, whatever else its nodes point at; the same from the other end.
    """
    for a, b in (("src", "dst"), ("dst", "src")):
        into = stored(edges.groupBy(F.col(b).alias("node")).agg(F.min(a).alias("to"), F.count(F.lit(1)).alias("n")), "into")
        dead = chain_ends(into.where("n = 1").select("node", "to")).where("ends").join(into.select(F.col("node").alias("to")), "to", "left_anti")
        edges = edges.join(into.select(F.col("node").alias(a)), a, "left_semi").join(dead.select(F.col("node").alias(a)), a, "left_anti")
        edges = stored(edges, "edges")
    return edges


def chain_ends(links: DataFrame) -> DataFrame:
    """(node, to, least, ends): where chains of links (node, to) end; rows that go round have `ends` false and in `least` the least node of their round."""
    got = stored(links.select("node", "to", F.least("node", "to").alias("least"), F.lit(False).alias("ends"), F.lit(True).alias("moved")), "jumps")
    while not got.where("moved").isEmpty():
        ahead = got.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("least").alias("_least"), F.col("ends").alias("_ends"))
        joined = got.join(ahead, "to", "left")
        # a node without a link of its own ends the chain
        least = F.least("least", F.coalesce("_least", "least"))
        ends = F.col("ends") | F.col("_to").isNull() | F.coalesce("_ends", F.lit(False))
        moved = (ends != F.col("ends")) | ~ends & (least != F.col("least"))
        got = stored(joined.select("node", F.coalesce("_to", "to").alias("to"), least.alias("least"), ends.alias("ends"), moved.alias("moved")), "jumps")
    return got.drop("moved")


def _shortened(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges with paths cut short, the nodes taken out (node, src, dst: what their path joins), and (node, component) of rounds without a branch."""
    counts = edges.select(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    middle = stored(counts.groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).where("out = 1 and into = 1").select("node"), "middle")
    onward = chain_ends(edges.join(middle.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("src").alias("node"), F.col("dst").alias("to")))
    back = chain_ends(edges.join(middle.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("dst").alias("node"), F.col("src").alias("to")))
    rounds = onward.where("not ends").select("node", F.col("least").alias("component"))
    taken = onward.where("ends").select("node", F.col("to").alias("dst")).join(back.select("node", F.col("to").alias("src")), "node")
    kept = edges.join(middle.withColumnRenamed("node", "src"), "src", "left_anti")
    over = onward.where("ends").select(F.col("node").alias("dst"), F.col("to").alias("_to"))
    whole = kept.join(over, "dst", "left").select("src", F.coalesce("_to", "dst").alias("dst")).distinct()
    return stored(whole, "edges"), stored(taken.select("node", "src", "dst"), "taken"), stored(rounds, "rounds")


def _coloured(edges: DataFrame) -> DataFrame:
    """(node, colour): the least node that reaches each, itself among them."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    got = stored(nodes.select("node", F.col("node").alias("colour"), F.lit(True).alias("fresh")), "colours")
    while not got.where("fresh").isEmpty():
        sent = edges.join(got.where("fresh").select(F.col("node").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("_colour"))
        least = F.least("colour", F.coalesce("_colour", "colour"))
        got = stored(got.join(sent, "node", "left").select("node", least.alias("colour"), (least != F.col("colour")).alias("fresh")), "colours")
    return got.drop("fresh")


def _reaching(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """(node, component): nodes that reach, within their colour, the node it is named for."""
    a, b = (colours.select(F.col("node").alias(c), F.col("colour").alias(f"_{c}")) for c in ("src", "dst"))
    inside = stored(edges.join(a, "src").join(b, "dst").where("_src = _dst").select("src", "dst"), "inside")
    last = stored(colours.where("node = colour").select("node", F.col("colour").alias("component")), "reaching")
    found = [last]
    while not last.isEmpty():
        step = inside.join(last.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "component").distinct()
        known = reduce(DataFrame.unionByName, found).select("node")
        last = stored(step.join(known, "node", "left_anti"), "reaching")
        found.append(last)
    return reduce(DataFrame.unionByName, found)


def on_cycles(edges: DataFrame) -> DataFrame:
    """(node, component): every node that lies on a cycle of edges (src, dst), a loop among them, with the least node of its strongly connected component.

    Edges with a null end count for nothing, repeated ones once.
    """
    edges = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    loops = stored(edges.where("src = dst").select(F.col("src").alias("node")), "loops")
    edges = stored(edges.where("src != dst"), "edges")
    found: list[DataFrame] = []
    levels = []
    while not edges.isEmpty():
        count = edges.count()
        if count <= FEW_EDGES:
            found.append(_finished(edges))
            break
        edges = stored(_both_ways(edges), "edges")
        if edges.count() > FEW_EDGES:
            edges = _trimmed(edges)
        if edges.count() <= FEW_EDGES:
            continue
        whole, taken, rounds = _shortened(edges)
        found.append(rounds)
        levels.append((taken, stored(whole.where("src = dst").select(F.col("src").alias("node")), "loops")))
        edges = stored(whole.where("src != dst"), "edges")
        if 0 < edges.count() == count:
            parts = stored(_reaching(edges, _coloured(edges)), "components")
            big = parts.join(parts.groupBy("component").count().where("count > 1"), "component", "left_semi").select("node", "component")
            found.append(stored(big, "components"))
            gone = parts.select("node")
            edges = stored(edges.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"), "edges")
    done = reduce(DataFrame.unionByName, found) if found else loops.select("node", F.col("node").alias("component")).limit(0)
    for taken, round_ in reversed(levels):
        # a path that came back to its start makes that a component, unless it is part of a larger one
        done = done.unionByName(round_.join(done, "node", "left_anti").select("node", F.col("node").alias("component")))
        a, b = (done.select(F.col("node").alias(c), F.col("component").alias(f"_{c}")) for c in ("src", "dst"))
        more = taken.join(a, "src").join(b, "dst").where("_src = _dst").select("node", F.col("_src").alias("component"))
        done = stored(done.unionByName(more), "components")
    done = done.unionByName(loops.join(done, "node", "left_anti").select("node", F.col("node").alias("component")))
    least = done.groupBy("component").agg(F.min("node").alias("least"))
    return done.join(least, "component").select("node", F.col("least").alias("component"))
