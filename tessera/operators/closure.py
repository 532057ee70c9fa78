"""Inheritance: edges, ancestors, assignability and members taken from ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.reach import ReachIndex, reachable
from tessera.shared import reached


def link(children: DataFrame, parents: DataFrame) -> DataFrame:
    """(child, parent) from (child, parent_name): the parent whose qualified name fits, else whose display name does."""
    by_q = parents.select(F.col("qualified_name").alias("parent_name"), F.col("id").alias("by_qualified"))
    by_d = parents.groupBy(F.col("display_name").alias("parent_name")).agg(F.max_by("id", F.struct("load_ord", "id")).alias("by_display"))
    rows = children.join(by_q, "parent_name", "left").join(by_d, "parent_name", "left")
    return rows.select("child", F.coalesce("by_qualified", "by_display").alias("parent")).where("parent is not null").distinct()


def closure(edges: DataFrame) -> DataFrame:
    """(descendant, ancestor, depth): every ancestor with its least depth, however far; cycles end."""
    steps = edges.select(F.col("child").alias("mid"), F.col("parent").alias("next"))
    first = edges.select(F.col("child").alias("descendant"), F.col("parent").alias("ancestor"))
    return reached(first, lambda level: level.join(steps, F.col("ancestor") == F.col("mid")).select("descendant", F.col("next").alias("ancestor")), 1)


def assignable(pairs: DataFrame, edges: DataFrame, index: ReachIndex) -> DataFrame:
    """pairs (from_id, to_id) with `reason`: exact, inheritance (direct), compatible (through others) or null. edges: (child, parent); index: reach.build of them."""
    direct = edges.select(F.col("child").alias("from_id"), F.col("parent").alias("to_id"), F.lit(True).alias("_direct")).distinct()
    far = reachable(pairs.where("from_id != to_id"), index).withColumn("_far", F.lit(True))
    joined = pairs.join(direct, ["from_id", "to_id"], "left").join(far, ["from_id", "to_id"], "left")
    reason = F.when(F.col("from_id") == F.col("to_id"), "exact").when(F.col("_direct"), "inheritance").when(F.col("_far"), "compatible")
    return joined.select("from_id", "to_id", reason.alias("reason"))


def effective_members(own: DataFrame, reach: DataFrame) -> DataFrame:
    """(id, member, owner, depth): own members and those of ancestors; of one name the nearest counts. own: (id, member)."""
    inherited = reach.join(own.withColumnRenamed("id", "ancestor"), "ancestor").select(F.col("descendant").alias("id"), "member", F.col("ancestor").alias("owner"), "depth")
    rows = own.select("id", "member", F.col("id").alias("owner"), F.lit(0).alias("depth")).unionByName(inherited)
    w = Window.partitionBy("id", "member").orderBy("depth", "owner")
    return rows.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def with_template(entities: DataFrame, templates: DataFrame) -> DataFrame:
    """entities (id, kind, member) with the members of the template of their kind that they lack. templates: (kind, member)."""
    kinds = entities.select("id", "kind").distinct()
    lent = kinds.join(templates, "kind").select("id", "member").join(entities.select("id", "member"), ["id", "member"], "left_anti")
    return entities.select("id", "member", F.lit(False).alias("inherited")).unionByName(lent.select("id", "member", F.lit(True).alias("inherited")))


def missing_parents(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Rows (child, parent) whose parent isn't an id of parents."""
    return children.join(parents.select(F.col("id").alias("parent")), "parent", "left_anti")
