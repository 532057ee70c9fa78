"""Which texts hold which passages, word for word."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 4
BROADCAST_ROWS = 10_000  # passages without a key, at most: they are tried on every text
_RUN = f"(?:\\S+\\s){{{WORDS - 1}}}\\S+"


def holding(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id, item_id): texts that contain a passage, from docs (doc_id, text) and passages (item_id, passage).

    The passage's words from the second on are whole words in the text too, so a run of WORDS of them is
    the join key and contains() decides. Passages too short for a key are tried on every text; a table with
    very many of them is an error.
    """
    keyed = passages.where("passage is not null").withColumn("key", F.regexp_extract("passage", f"\\s({_RUN})\\s", 1))
    long, short = keyed.where("key != ''"), keyed.where("key = ''")
    if short.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        raise ValueError(f"over {BROADCAST_ROWS} passages are shorter than {WORDS + 2} words")
    runs = F.regexp_extract_all("text", F.lit(f"(?<!\\S)(?=({_RUN}))"), F.lit(1))
    hashed = docs.select("doc_id", F.explode(F.array_distinct(F.transform(runs, lambda r: F.xxhash64(r)))).alias("h"))
    found = hashed.join(long.select("item_id", F.xxhash64("key").alias("h")), "h").select("doc_id", "item_id").distinct()
    sure = found.join(docs, "doc_id").join(long, "item_id").where(F.contains("text", F.col("passage"))).select("doc_id", "item_id")
    tried = docs.join(F.broadcast(short), F.contains("text", F.col("passage"))).select("doc_id", "item_id")
    return sure.union(tried).distinct()
