"""A stream of changed rows kept as the latest state of each key, and per-document change state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tessera.operators.incremental import upsert

BUCKETS = 64
FILES = "path string, modificationTime timestamp, length long, content binary"


def watch_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """New and changed files of a folder as a stream: path, modificationTime, length, content."""
    return spark.readStream.schema(FILES).format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def keep_latest(changes: DataFrame, path: str, keys: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Applies each batch of changes to a Parquet state in `path`, read by `latest`.

    The state is dealt into BUCKETS by its keys. A batch writes only the buckets that it changes, under its
    own number, and a table of which batch holds each bucket now; a batch that runs again replaces what it
    wrote. Data that no table of the last batches names may be removed by the caller.
    """
    spark = changes.sparkSession
    schema = changes.schema
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")

    def apply(batch: DataFrame, n: int) -> None:
        now = _versions(spark, path, n - 1)
        changed = [r.bucket for r in batch.select(bucket.alias("bucket")).distinct().collect()]  # BUCKETS at most
        upsert(_read(spark, path, schema, {b: v for b, v in now.items() if b in changed}), batch, keys, order).withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/v{n}")
        held = sorted((now | dict.fromkeys(changed, n)).items())
        spark.createDataFrame(held, "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/v{n}")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, path: str, n: int) -> dict[int, int]:
    """The batch that holds each bucket after batch n."""
    return {r.bucket: r.version for r in spark.read.parquet(f"{path}/versions/v{n}").collect()} if n >= 0 else {}


def _read(spark: SparkSession, path: str, schema: StructType, versions: dict[int, int]) -> DataFrame:
    paths = [f"{path}/data/v{v}/bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def latest(spark: SparkSession, path: str, schema: StructType, n: int) -> DataFrame:
    """The state after batch n."""
    return _read(spark, path, schema, _versions(spark, path, n))


def document_changes(versions: DataFrame) -> DataFrame:
    """(doc_id, version, changed) for each arriving version (doc_id, version, text): whether its text differs from the last one seen.

    Versions of one micro-batch are taken in order; what is kept of a text is a digest.
    """
    rows = versions.select("doc_id", "version", F.sha2("text", 256).alias("digest"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        got = [(v, t) for pdf in batches for v, t in zip(pdf["version"], pdf["digest"], strict=True)]
        out = []
        for v, t in sorted(got):
            out.append((key[0], v, t != last))
            last = t
        state.update((last,))
        yield pd.DataFrame(out, columns=["doc_id", "version", "changed"])

    return rows.groupBy("doc_id").applyInPandasWithState(step, "doc_id long, version long, changed boolean", "digest string", "append", GroupStateTimeout.NoTimeout)
