"""Bounded samples of labelled texts for fitting models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.shared import stored

_SALTS = 16  # parts that each kind is drawn in


def sample_texts(rows: DataFrame, kind: str, per_kind: int) -> DataFrame:
    """(kind, text, h): up to per_kind different texts of each kind, those with the least hashes; equal texts of one kind count once.

    The draw ranks hashes, so texts aren't sorted or shuffled but for those drawn. The table of drawn hashes, which is
    broadcast, has per_kind rows a kind at most; the caller bounds the kinds or lowers per_kind with their number.
    """
    rows = rows.where(F.col("text").isNotNull() & F.col(kind).isNotNull()).select(kind, "text", F.xxhash64("text").alias("h"))
    drawn = rows.select(kind, "h").distinct().withColumn("_salt", F.pmod(F.col("h"), F.lit(_SALTS)))
    for keys in ((kind, "_salt"), (kind,)):  # the parts of a large kind first, then what is left of all of them
        drawn = drawn.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).where(F.col("_rank") <= per_kind)
    drawn = drawn.select(kind, "h")
    return rows.join(F.broadcast(drawn), [kind, "h"]).groupBy(kind, "h").agg(F.first("text").alias("text"))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, per_class: int, allowed: Column | None = None) -> DataFrame:
    """(label, text, h): up to per_class different texts labelled 0 and as many labelled 1.

    Ids are drawn first, per_class of each class among those that docs has; their rows, of which an id may have many,
    are drawn from again by text. A null doc_id has no label; labels of one id that disagree count each.
    """
    wanted = labels.where(f"doc_id is not null and {label} in (0, 1)").where(F.lit(True) if allowed is None else allowed).select("doc_id", label).distinct()
    known = wanted.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("_h", F.xxhash64("doc_id"))
    ids = [known.where(F.col(label) == k).orderBy("_h", "doc_id").limit(per_class).select("doc_id", label) for k in (0, 1)]
    rows = docs.where("text is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    found = stored(rows.join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id").select(label, "text"), "labelled")
    return sample_texts(found, label, per_class)
