"""Exact top-k by inner product through a pivot table.

Vectors are lifted to a sphere: a candidate gets one more component sqrt(M^2 - |x|^2), M being the
greatest norm, and a query gets 0. Then distance falls as the inner product rises, and for every pivot p
the distance of query and candidate is at least |d(query, p) - d(candidate, p)|. The table holds each
candidate's distances to all pivots; the maximum over the pivots bounds the score from above.

Queries and candidates are dealt into blocks, neighbours of one pivot together. A pair of blocks is
dropped where the ranges of their distances to some pivot lie so far apart that no score of it can reach
what the block's queries have found in a sample. In each other pair, queries are taken a few at a time:
candidates are evaluated in the order of their bound, in steps that grow, until no bound of the rest
reaches the k-th score of its query. The best k of each pair of blocks are merged by a window.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part, nor do
rows without vec_id; a shorter vector counts as padded with zeros; rows that share the query's vec_id are
its own and aren't its candidates; a query id that repeats is asked once, with its least vector; ties go
to the smaller vec_id; with fewer than k candidates all are returned; components so large that a score
may exceed 64 bits are an error, all others are exact; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm._util import stored

PIVOTS = 64
SAMPLE_ROWS = 2048  # candidates among which pivots are chosen and the first bound of a query is found
QUERY_BLOCK, CANDIDATE_BLOCK = 512, 8192
_STEP = 256  # candidates evaluated first; each further step is twice as long
_TILE = 16  # queries taken at once
_EXACT = ((float(1 << 24), np.float32), (float(1 << 53), np.float64), (float(1 << 62), np.int64))  # squared norms under which a type holds all scores
_LOW = -1e38


def quantized(rows: DataFrame, column: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, x as double; only rows that take part."""
    x = F.col(column)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    v = F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")))
    return rows.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _matrix(vectors: list, dim: int, kind: type = np.float64) -> np.ndarray:
    out = np.zeros((len(vectors), dim), kind)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _lift(x: np.ndarray, top: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(0.0, top - (x * x).sum(axis=1)))])


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Rows of the sample, each as far as can be from those before."""
    if not len(sample):
        return sample
    picked = [int(np.argmax((sample * sample).sum(axis=1)))]
    far = np.linalg.norm(sample - sample[picked[0]], axis=1)
    while len(picked) < min(n, len(sample)) and far.max() > 0:
        picked.append(int(np.argmax(far)))
        far = np.minimum(far, np.linalg.norm(sample - sample[picked[-1]], axis=1))
    return sample[picked]


def _bounds(q_far: np.ndarray, c_far: np.ndarray) -> np.ndarray:
    """The greatest |d(query, p) - d(candidate, p)| over the pivots; the distances come pivot by pivot."""
    out = np.zeros((q_far.shape[1], c_far.shape[1]), np.float32)
    for qp, cp in zip(q_far, c_far, strict=True):
        d = qp[:, None] - cp[None, :]
        np.maximum(out, np.abs(d, out=d), out=out)
    return out


def best_of_blocks(q_ids: np.ndarray, q: np.ndarray, q_far: np.ndarray, q_least: np.ndarray, c_ids: np.ndarray, c: np.ndarray, c_far: np.ndarray, top: float, k: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score): what of this block may be among the k best."""
    out: list[tuple[int, int, int]] = []
    q_rows, c_rows = np.ascontiguousarray(q_far.T.astype(np.float32)), np.ascontiguousarray(c_far.T.astype(np.float32))
    norm = (q.astype(np.float64) ** 2).sum(axis=1)
    for a in range(0, len(q), _TILE):
        tile = slice(a, a + _TILE)
        lower = _bounds(q_rows[:, tile], c_rows)
        reach = (norm[tile, None] + top).astype(np.float32)
        most = (reach - lower * lower) / 2 + reach * np.float32(1e-5) + np.float32(1e-3)  # with the rounding of distances
        most[q_ids[tile, None] == c_ids[None, :]] = -np.inf
        least = q_least[tile].copy()
        best = [(np.empty(0, q.dtype), np.empty(0, np.int64)) for _ in least]
        rest, step = np.arange(len(c)), _STEP
        while True:
            over = (most[:, rest] - np.maximum(least, _LOW)[:, None].astype(np.float32)).max(axis=0)  # the bound over what a query has, where it is most
            rest = rest[np.argsort(-over, kind="stable")][: int((over >= 0).sum())]
            if not len(rest):
                break
            now, rest, step = rest[:step], rest[step:], 2 * step
            scores = q[tile] @ c[now].T
            for i in range(len(least)):
                can = np.flatnonzero((scores[i] >= least[i]) & (c_ids[now] != q_ids[a + i]))
                s, ids = np.concatenate([best[i][0], scores[i, can]]), np.concatenate([best[i][1], c_ids[now[can]]])
                if len(s) > k:
                    least[i] = max(least[i], float(np.partition(s, -k)[-k]))
                    keep = np.lexsort((ids, -s))[:k]
                    s, ids = s[keep], ids[keep]
                best[i] = s, ids
        for i, (s, ids) in enumerate(best):
            out.extend(zip([int(q_ids[a + i])] * len(s), ids.tolist(), map(int, s.tolist()), strict=True))
    return out


def dealt(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """rows (vec_id, near, ...) with a block of about `size` rows; blocks run through the pivots, so that neighbours of one share blocks."""
    counts = rows.groupBy("near").agg(F.count(F.lit(1)).alias("k")).orderBy("near").collect()  # a row for each pivot
    at, places = 0, {}
    for r in counts:
        places[r.near] = (at, r.k)
        at += r.k
    n_blocks = max(1, -(-at // size))
    spans = F.broadcast(rows.sparkSession.createDataFrame([(p, b, k) for p, (b, k) in places.items()] or [(0, 0, 1)], "near int, _first long, _k long"))
    block = F.floor((F.col("_first") + F.pmod(F.xxhash64("vec_id"), F.col("_k"))) * F.lit(n_blocks) / F.lit(max(1, at))).cast("int")
    return rows.join(spans, "near").withColumn(name, block).drop("_first", "_k"), n_blocks


def _reach(rows: DataFrame, block: str, prefix: str) -> DataFrame:
    """Of each block the least and greatest distance to every pivot, the greatest norm, and the least first bound."""
    spread = [f("d") for f in (F.min, F.max)]
    by_pivot = rows.select(block, F.posexplode("far").alias("p", "d")).groupBy(block, "p").agg(spread[0].alias("low"), spread[1].alias("high"))
    far = F.array_sort(F.collect_list(F.struct("p", "low", "high"))).alias(f"{prefix}_far")
    sizes = rows.groupBy(block).agg(F.max("norm").alias(f"{prefix}_norm"), F.min("least").alias(f"{prefix}_least"))
    return by_pivot.groupBy(block).agg(far).join(sizes, block)


def top_k(rows: DataFrame, is_query: Column, k: int = 20, scale: int = 64, column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k greatest inner products of each query with all other rows."""
    spark = rows.sparkSession
    base = stored(quantized(rows, column, scale), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
    n, dim, top = base.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(square)).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    kind = next((t for most, t in _EXACT if top < most), None)
    if kind is None:
        raise ValueError("components are so large that scores may exceed 64 bits")
    sample = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).collect()
    s_ids, s = np.asarray([r.vec_id for r in sample]), _matrix([r.v for r in sample], dim)
    pivots = choose_pivots(_lift(s, top), PIVOTS)
    shared = spark.sparkContext.broadcast((s_ids, s.astype(kind), pivots))  # SAMPLE_ROWS vectors

    def far(x: np.ndarray) -> np.ndarray:
        p = shared.value[2]
        return np.sqrt(np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * x @ p.T))

    def table(as_query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s_ids, s, _ = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1).to_pylist(), dim, kind)
                wide = x.astype(np.float64)
                least = np.full(len(ids), -np.inf)
                d = far(np.column_stack([wide, np.zeros(len(x))]) if as_query else _lift(wide, top))
                if as_query:
                    for i in range(len(ids)):
                        got = (s @ x[i])[s_ids != ids[i]]
                        if len(got) >= k:
                            least[i] = np.partition(got, -k)[-k]
                fars = pa.ListArray.from_arrays(pa.array(np.arange(0, d.size + 1, d.shape[1], dtype=np.int32)), pa.array(d.astype(np.float32).ravel()))
                cols = [batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), fars, pa.array(least), pa.array((wide * wide).sum(axis=1)), pa.array(d.argmin(axis=1).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "v", "far", "least", "norm", "near"])

        return run

    out = "vec_id long, v binary, far array<float>, least double, norm double, near int"
    asked = base.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries, _ = dealt(stored(asked.mapInArrow(table(True), out), "queries"), QUERY_BLOCK, "qb")
    stock, c_blocks = dealt(stored(base.mapInArrow(table(False), out), "stock"), CANDIDATE_BLOCK, "cb")
    pairs = _reach(queries, "qb", "q").select("*", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("cb")).join(_reach(stock, "cb", "c"), "cb")
    gaps = F.zip_with("q_far", "c_far", lambda x, y: F.greatest(x["low"] - y["high"], y["low"] - x["high"], F.lit(0.0)))
    gap = F.array_max(gaps).cast("double") * (1 - 1e-5)
    pairs = stored(pairs.where((F.col("q_norm") + top - gap * gap) / 2 * (1 + 1e-5) + 1e-3 >= F.col("q_least")).select("qb", "cb"), "pairs")

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list = []
        if left.num_rows and right.num_rows:
            part = lambda t: np.frombuffer(b"".join(t.column("v").to_pylist()), kind).reshape(t.num_rows, -1)
            fars = lambda t: t.column("far").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            ids = [t.column("vec_id").to_numpy() for t in (left, right)]
            found = best_of_blocks(ids[0], part(left), fars(left), left.column("least").to_numpy(), ids[1], part(right), fars(right), top, k)
        return pa.table([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])

    used = ["vec_id", "v", "far", "least", "qb", "cb"]
    sides = [df.join(pairs, on).select(*used).groupBy("qb", "cb") for df, on in ((queries, "qb"), (stock, "cb"))]
    found = sides[0].cogroup(sides[1]).applyInArrow(pair, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
