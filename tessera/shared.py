"""Where intermediate tables live, and joins repeated until they add nothing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees. A temporary one is used in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            found = tempfile.mkdtemp(prefix="tessera-")
        else:
            found = spark.conf.get("spark.sql.warehouse.dir") + "/_tessera"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reached(first: DataFrame, step: Callable[[DataFrame], DataFrame], start: int) -> DataFrame:
    """Distinct rows of `first` and what `step` makes of the rows found last, until a round finds no new one.

    `depth` is the round that found a row, from `start` on. `step` returns the columns of `first`. Each round is
    written to the shared folder; a cycle ends when it comes back to known rows.
    """
    spark = first.sparkSession
    base, keys, depth, paths = new_path(spark, "rounds"), first.columns, start, []
    level = first
    while True:
        level = level.distinct().withColumn("depth", F.lit(depth))
        path = f"{base}/{depth}"
        level.write.parquet(path)
        last = spark.read.schema(level.schema).parquet(path)
        if last.isEmpty():
            return spark.read.schema(level.schema).parquet(*(paths or [path]))
        paths.append(path)
        known = spark.read.schema(level.schema).parquet(*paths).select(*(F.col(c).alias(f"_{c}") for c in keys))
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
        level = step(last.select(*keys)).join(known, same, "left_anti")
        depth += 1


def numbered(df: DataFrame, keys: list[Column | str], column: str, name: str) -> DataFrame:
    """df with `column`, the place (from 1) of each row in the order of keys, by range partitions: no task sorts all rows.

    The sorted rows are written to the shared folder; what is added up is a row for each partition.
    """
    at = F.col("_at")
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    rows = stored(rows, name).withColumns({"_part": F.shiftright(at, 33), "_idx": at.bitwiseAND((1 << 33) - 1)})
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", before.alias("_before"))
    return rows.join(F.broadcast(parts), "_part").withColumn(column, F.col("_before") + F.col("_idx") + 1).drop("_at", "_part", "_idx", "_before")


def summed_before(df: DataFrame, keys: list[Column | str], value: str, column: str, name: str) -> DataFrame:
    """df with `column`, the sum of `value` over all rows before each in the order of keys, by range partitions as `numbered`."""
    at = F.col("_at")
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    rows = stored(rows, name).withColumn("_part", F.shiftright(at, 33))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = rows.groupBy("_part").agg(F.sum(value).alias("_n")).select("_part", before.alias("_before"))
    within = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_within", within).join(F.broadcast(parts), "_part").withColumn(column, F.col("_before") + F.col("_within")).drop("_at", "_part", "_before", "_within")
