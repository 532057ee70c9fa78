"""Connected components of an edge table: forests of each task's edges, then parents replaced by their own parents.

What is left of a table of up to SMALL edges is finished in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._util import stored

BROADCAST_ROWS = 1_000_000  # least parents are broadcast up to here (16 bytes each), else shuffled
SMALL = 1 << 19  # edges that one task finishes: 8 MB
_HELD = 1 << 20  # edges a task holds before it shrinks them to a forest


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge, root being the least node of its component.

    Edges point from a node u to a lesser one v. A round replaces each v by the least that v points to,
    then deals the edges by u and shrinks those of a task to stars around the least node of each part. It
    ends when every u has one v and no v is a u, or few edges are left. A round is two shuffles, of one edge for each node and
    task at most, and its result is written to the shared folder.
    """
    e = stored(edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u != v"), "edges")
    if e.count() > SMALL:
        e = stored(_shrunk(e.repartition("u")), "edges")
    while e.count() > SMALL:
        low = stored(e.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most")), "parents")
        n, split = low.agg(F.count(F.lit(1)), F.max(F.col("m") != F.col("most"))).first()
        up = low.select(F.col("u").alias("v"), "m")
        if n <= BROADCAST_ROWS:
            up = F.broadcast(up)
        if not split and e.join(up, "v", "left_semi").isEmpty():
            roots = low.select(F.col("m").alias("node"), F.col("m").alias("root")).distinct()
            return low.select(F.col("u").alias("node"), F.col("m").alias("root")).union(roots)
        moved = e.join(up, "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        e = stored(_shrunk(moved.repartition("u")), "edges")
    return e.coalesce(1).mapInArrow(_finished, "node long, root long")


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges, which SMALL bounds."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        u, v = stars(*map(np.concatenate, zip(*held, strict=True)))
        root = np.unique(v)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([u, root])), pa.array(np.concatenate([v, root]))], names=["node", "root"])


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the given edges that isn't the least of its part, with that least node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        for side in (i, j):
            np.minimum.at(new, label[side], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def _shrunk(edges: DataFrame) -> DataFrame:
    """(u, v): the edges of each task as stars, in pieces of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n > _HELD:
                held = [stars(*map(np.concatenate, zip(*held, strict=True)))]
                n = len(held[0][0])
                if n > _HELD // 2:
                    yield _edges(*held[0])
                    held, n = [], 0
        if n:
            yield _edges(*stars(*map(np.concatenate, zip(*held, strict=True))))

    return edges.mapInArrow(run, "u long, v long")


def _edges(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
