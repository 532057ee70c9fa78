"""Data flow over ordered events of variables: reads before writes, unused and repeated declarations, type changes.

An event is a row (scope, name, pos, action, type), action being declare, write or read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _first(action: str):
    return F.min(F.when(F.col("action") == action, F.col("pos")))


def read_before_write(events: DataFrame) -> DataFrame:
    """(scope, name, first_read, first_write): names read before they are written, or never written."""
    firsts = events.groupBy("scope", "name").agg(_first("read").alias("first_read"), _first("write").alias("first_write"))
    return firsts.where(F.col("first_read").isNotNull() & (F.col("first_write").isNull() | (F.col("first_read") < F.col("first_write"))))


def unused(events: DataFrame) -> DataFrame:
    """(scope, name): declared names that no event of the scope reads."""
    reads = events.where("action = 'read'").select("scope", "name")
    return events.where("action = 'declare'").select("scope", "name").distinct().join(reads, ["scope", "name"], "left_anti")


def undeclared(events: DataFrame) -> DataFrame:
    """(scope, name): names read or written in a scope that declares them nowhere."""
    known = events.where("action = 'declare'").select("scope", "name")
    return events.where("action != 'declare'").select("scope", "name").distinct().join(known, ["scope", "name"], "left_anti")


def repeated(rows: DataFrame, scope: str, name: str, order: str) -> DataFrame:
    """Rows whose name was declared before in the scope."""
    w = Window.partitionBy(scope, name).orderBy(order)
    return rows.withColumn("nth", F.row_number().over(w)).where("nth > 1")


def type_changes(events: DataFrame) -> DataFrame:
    """Writes that give a name another type than its write before: (scope, name, pos, was, type)."""
    w = Window.partitionBy("scope", "name").orderBy("pos")
    writes = events.where("action = 'write' and type is not null").withColumn("was", F.lag("type").over(w))
    return writes.where("was != type").select("scope", "name", "pos", "was", "type")


def assigned_on_all_branches(writes: DataFrame, branches: DataFrame) -> DataFrame:
    """(block, name): names that every branch of a block writes. writes: (block, branch, name), branches: (block, n)."""
    seen = writes.select("block", "branch", "name").distinct().groupBy("block", "name").agg(F.count(F.lit(1)).alias("k"))
    return seen.join(branches, "block").where("k = n").select("block", "name")
