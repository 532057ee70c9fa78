"""Shared helpers: removing intermediate tables, and numbering rows without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.shared import new_path, shared_dir, stored  # noqa: F401

BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20
_ROWS_CONF, _BYTES_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
_INDEX_BITS = 33  # monotonically_increasing_id keeps the row's place in its partition in the low 33 bits


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes an intermediate table that this library wrote."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows and BATCH_BYTES bytes at most from now on in this session; lower settings stay.

    A batch is held by the JVM and by the worker at once, with texts of any length.
    """
    if not 0 < int(spark.conf.get(_ROWS_CONF)) <= BATCH_ROWS:
        spark.conf.set(_ROWS_CONF, BATCH_ROWS)
    held = spark.conf.get(_BYTES_CONF).strip().lower()
    if not (held.rstrip("b").isdigit() and 0 < int(held.rstrip("b")) <= BATCH_BYTES):
        spark.conf.set(_BYTES_CONF, f"{BATCH_BYTES}b")


def with_text(docs: DataFrame, names: list[str]) -> tuple[DataFrame, int]:
    """The named columns with the text as a string, and its place: the column itself where it is one."""
    if "text" in names and dict(docs.dtypes).get("text") == "string":
        return docs.select(*names), names.index("text")
    return docs.select(*names, F.col("text").cast("string").alias(free_name(docs, "text_"))), len(names)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ordered(df: DataFrame, keys: list[str | Column], path: str) -> DataFrame:
    """df sorted by keys over range partitions and written to `path`, with `_part` and `_idx` (place in the part).

    A range shuffle reads its input twice, for the bounds and for the rows; store a costly df first.
    """
    row = F.col("_row")
    out = df.repartitionByRange(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    out = out.withColumn("_row", F.monotonically_increasing_id())
    out = out.withColumns({"_part": F.shiftright(row, _INDEX_BITS).cast("int"), "_idx": row.bitwiseAND((1 << _INDEX_BITS) - 1)})
    out = out.drop("_row")
    out.write.parquet(path)
    return df.sparkSession.read.schema(out.schema).parquet(path)


def _before(parts: DataFrame, size: str) -> DataFrame:
    """(_part, _base): the sum of `size` over earlier parts."""
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("_part", F.coalesce(F.sum(size).over(w), F.lit(0)).alias("_base"))


def running_total(sorted_rows: DataFrame, size: str, out: str) -> DataFrame:
    """Adds `out`, the sum of `size` over all earlier rows of what `ordered` returned."""
    w = Window.partitionBy("_part").orderBy("_idx").rowsBetween(Window.unboundedPreceding, -1)
    sums = sorted_rows.groupBy("_part").agg(F.sum(size).alias("_n"))
    local = sorted_rows.withColumn("_local", F.coalesce(F.sum(size).over(w), F.lit(0)))
    return local.join(F.broadcast(_before(sums, "_n")), "_part").withColumn(out, F.col("_base") + F.col("_local")).drop("_base", "_local")
