"""Verification of member calls: existence, similar names, arity and argument types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.reach import ReachIndex, reachable

NEAR = 3
FIRST = 3
SHOWN = 10


def existing(calls: DataFrame, members: DataFrame) -> DataFrame:
    """Calls (type, member) that the effective members (type, member) hold."""
    return calls.join(members, ["type", "member"], "left_semi")


def missing(calls: DataFrame, members: DataFrame) -> DataFrame:
    return calls.join(members, ["type", "member"], "left_anti")


def similar(wanted: DataFrame, members: DataFrame, near: int = NEAR, first: int = FIRST) -> DataFrame:
    """(type, wanted, rank, member, distance): members of the type within an edit distance, nearest first.

    Only members of the same type whose length differs by at most `near` are tried: the length is part
    of the join key.
    """
    lengths = F.sequence(F.greatest(F.lit(0), F.length("wanted") - near), F.length("wanted") + near)
    w = wanted.select("type", "wanted", F.explode(lengths).alias("size"))
    m = members.select("type", "member", F.length("member").alias("size")).distinct()
    found = w.join(m, ["type", "size"]).withColumn("distance", F.levenshtein("wanted", "member", near)).where("distance >= 0")
    order = Window.partitionBy("type", "wanted").orderBy("distance", "member")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first).select("type", "wanted", "rank", "member", "distance")


def alike(wanted: DataFrame, members: DataFrame, first: int = FIRST, near: int = 2) -> DataFrame:
    """(type, wanted, rank, member): the first members by name that contain the wanted name, lie in it, or are within `near` edits, whatever the case."""
    a, b = F.lower("wanted"), F.lower("member")
    hit = F.contains(a, b) | F.contains(b, a) | (F.levenshtein(a, b, near) >= 0)
    found = wanted.select("type", "wanted").distinct().join(members.select("type", "member").distinct(), "type").where(hit)
    order = Window.partitionBy("type", "wanted").orderBy("member")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)


def suggestion_text(similar_names, all_names):
    """Similar names if there are any, else all if few, else the first and how many more."""
    rest = F.concat(F.array_join(F.slice(all_names, 1, SHOWN), ", "), F.lit(" and "), (F.size(all_names) - SHOWN).cast("string"), F.lit(" more"))
    return F.when(F.size(similar_names) > 0, F.array_join(similar_names, ", ")).when(F.size(all_names) <= SHOWN, F.array_join(all_names, ", ")).otherwise(rest)


def arity(calls: DataFrame, signatures: DataFrame) -> DataFrame:
    """calls (call_id, name, n_args) with `problem`: unknown, too_few, too_many or null. signatures: (name, least, most)."""
    joined = calls.join(signatures, "name", "left")
    problem = F.when(F.col("most").isNull(), "unknown").when(F.col("n_args") < F.col("least"), "too_few").when(F.col("n_args") > F.col("most"), "too_many")
    return joined.select("call_id", "name", "n_args", problem.alias("problem"))


def first_mismatch(arguments: DataFrame, parameters: DataFrame, index: ReachIndex) -> DataFrame:
    """(call_id, pos): the first argument (call_id, name, pos, type) that can't be assigned to the parameter (name, pos, type). index: operators.reach.build of the inheritance edges."""
    p = parameters.select("name", "pos", F.col("type").alias("to_id"))
    a = arguments.withColumnRenamed("type", "from_id").join(p, ["name", "pos"]).where("from_id != to_id")
    return a.join(reachable(a, index), ["from_id", "to_id"], "left_anti").groupBy("call_id").agg(F.min("pos").alias("pos"))
