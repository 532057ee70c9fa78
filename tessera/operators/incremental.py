"""Incremental maintenance: snapshots, impact, upserts and deletes, digests of trees, rebuild plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.shared import reached

#: The share of routines and their number beyond which a partial rebuild isn't worth it.
MOST_SHARE = 0.5
MOST_ROUTINES = 25
#: Impacts from the least on.
IMPACTS = ("minor", "module", "metadata", "full")


def snapshot_diff(old: DataFrame, new: DataFrame, *by: str) -> DataFrame:
    """(*by, path, change): added, removed or changed between two snapshots (*by, path, hash), or two for each `by`."""
    keys = [*by, "path"]
    joined = old.select(*keys, F.col("hash").alias("was")).join(new.select(*keys, F.col("hash").alias("now")), keys, "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return joined.select(*keys, change.alias("change")).where("change is not null")


def impact(path: Column) -> Column:
    """Rank of what a changed file may affect, into IMPACTS."""
    return F.when(F.endswith(path, F.lit("Configuration.xml")), 3).when(F.endswith(path, F.lit(".xml")), 2).when(F.endswith(path, F.lit(".bsl")), 1).otherwise(0)


def overall_impact(changes: DataFrame, rank: Column) -> DataFrame:
    """The gravest impact of a set of changes, its name and how many changes there are."""
    got = changes.agg(F.max(rank).alias("rank"), F.count(F.lit(1)).alias("changes"))
    return got.select(F.element_at(F.array(*map(F.lit, IMPACTS)), F.col("rank") + 1).alias("impact"), "changes")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """base with changes applied: of each key the row that is last by `order`; of equals a change goes before base, then the greater row. Columns of both are the same."""
    rows = base.withColumn("_new", F.lit(False)).unionByName(changes.withColumn("_new", F.lit(True)))
    w = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("_new"), *(F.desc(c) for c in base.columns if c not in (*keys, order)))
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "_new")


def delete(base: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(gone.select(*keys), keys, "left_anti")


def merkle_level(children: DataFrame, parent: str, digest: str) -> DataFrame:
    """(parent, digest): SHA-256 over the sorted digests of a node's children."""
    return children.groupBy(parent).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(digest)), ""), 256).alias("digest"))


def changed_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, node_id): nodes whose fingerprints differ; trees of unlike size aren't compared node by node."""
    sizes = lambda d, n: d.groupBy("doc_id").agg(F.count(F.lit(1)).alias(n))
    alike = sizes(old, "a").join(sizes(new, "b"), "doc_id").where("a = b").select("doc_id")
    pairs = old.join(alike, "doc_id", "left_semi").select("doc_id", "node_id", F.col("fingerprint").alias("was")).join(new, ["doc_id", "node_id"])
    return pairs.where("was != fingerprint").select("doc_id", "node_id")


def expand_callers(touched: DataFrame, calls: DataFrame) -> DataFrame:
    """(routine, depth): touched routines and all that reach them by calls (caller, callee); cycles end."""
    return reached(touched.select("routine"), lambda level: level.join(calls, F.col("routine") == F.col("callee")).select(F.col("caller").alias("routine")), 0)


def rebuild_plan(counts: DataFrame) -> DataFrame:
    """counts (doc_id, touched, total) with `plan`: partial, or why all is rebuilt."""
    plan = F.when(F.col("total") == 0, "module").when(F.col("touched") > MOST_SHARE * F.col("total"), "fraction").when(F.col("touched") > MOST_ROUTINES, "absolute").otherwise("partial")
    return counts.withColumn("plan", plan)


def expired(cache: DataFrame, now: Column, most_age_s: int) -> DataFrame:
    """Cache rows (key, used_at) unused for too long."""
    return cache.where(F.unix_timestamp(now) - F.unix_timestamp("used_at") > most_age_s)


def invalidated(cache: DataFrame, changed: DataFrame, depends: DataFrame) -> DataFrame:
    """Keys to drop: changed ones and those that depend on them directly. depends: (key, on_key)."""
    direct = depends.join(changed.select(F.col("key").alias("on_key")), "on_key", "left_semi").select("key")
    return cache.join(changed.select("key").union(direct).distinct(), "key", "left_semi")


def file_hashes(files: DataFrame) -> DataFrame:
    """(path, hash) of a snapshot: a hash of path, time and length, not of the content. files: (path, modificationTime, length)."""
    return files.select("path", F.xxhash64("path", "modificationTime", "length").cast("string").alias("hash"))


def relinked(edges: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """edges (child, parent) where those of changed children (id) are replaced by what fresh (child, parent) has of them."""
    ids = changed.select(F.col("id").alias("child")).distinct()
    return edges.join(ids, "child", "left_anti").unionByName(fresh.join(ids, "child", "left_semi")).distinct()


def imported_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges (child, parent) both ends of which are entities (id)."""
    ids = entities.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "child"), "child", "left_semi").join(ids.withColumnRenamed("id", "parent"), "parent", "left_semi")


def fresh(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """manifest (project, created_at) with `fresh`: its Configuration.xml is there and no newer. files: (project, path, modificationTime); others aren't looked at."""
    last = files.where(F.endswith("path", F.lit("Configuration.xml"))).groupBy("project").agg(F.max("modificationTime").alias("_at"))
    return manifest.join(last, "project", "left").withColumn("fresh", F.coalesce(F.col("_at") <= F.col("created_at"), F.lit(False))).drop("_at")


def stale(cache: DataFrame, depends: DataFrame, files: DataFrame, now: Column, within_s: int = 3600) -> DataFrame:
    """Cache rows (key) that depend (key, path) on a file (path, modificationTime) changed within a time before now."""
    young = files.where(F.unix_timestamp(now) - F.unix_timestamp("modificationTime") < within_s).select("path")
    return cache.join(depends.join(young, "path", "left_semi").select("key").distinct(), "key", "left_semi")


def rebuilt(old: DataFrame, planned: DataFrame, new: DataFrame) -> DataFrame:
    """Routines (doc_id, kind, name, body) after a partial rebuild: planned ones (doc_id, kind, name) as in new where it has them, all others as in old."""
    keys = ["doc_id", "kind", "name"]
    fresh_ = new.join(planned.select(*keys).distinct(), keys, "left_semi").select(*keys, F.col("body").alias("_new"))
    return old.join(fresh_, keys, "left").select(*keys, F.coalesce("_new", "body").alias("body"), F.col("_new").isNotNull().alias("rebuilt"))


def reuse(rows: DataFrame) -> DataFrame:
    """(routines, rebuilt, reused, ratio) over what `rebuilt` returns."""
    got = rows.agg(F.count(F.lit(1)).alias("routines"), F.count_if("rebuilt").alias("rebuilt"))
    return got.select("*", (F.col("routines") - F.col("rebuilt")).alias("reused"), F.try_divide(F.col("routines") - F.col("rebuilt"), F.col("routines")).alias("ratio"))
