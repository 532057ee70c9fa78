"""A corpus pipeline of five stages, each a call of one operator on what the stage before kept.

Language ID drops documents without a recognisable language; the n-gram Jaccard join (five words, 80 %)
keeps one document of each group; substring dedup takes out windows of 35 words that repeat; the secret
scan masks secrets; packing returns the pieces of what is left. All but the last return the columns of
`documents`, with n_chars following the text; other columns are dropped, whatever their names.

Defined cases, stage by stage. Null texts and texts without a letter have no language and go in the
first stage. A null or repeated doc_id names no row: every row is judged by its text, and of a group of
near copies the row that is least by doc_id (null last), then by text and the other columns stays, so that
of equal rows one does. Very long texts pass every stage whole. A text that loses all its words to substring
dedup stays as an empty one. Masking changes only the stretches found. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard, langid, packing, secret_scan, substring
from tessera.llm._util import new_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of documents; with a new text, n_chars is its length."""
    if text is None:
        return df.select(*COLUMNS)
    return df.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language the model accepts."""
    model = langid.train(docs, F.coalesce(langid.fold() != 2, F.lit(True)))
    return _documents(langid.predict(docs, model).where(~F.col("rejected")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first row of each group of near copies; texts without words stay unless the whole row repeats."""
    return _documents(jaccard.first_of_components(docs.select(*COLUMNS), width=5, percent=80))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out of the texts; texts without any stay as they are."""
    got = substring.remove_repeats(docs)
    return _documents(got, F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts."""
    got = secret_scan.redact(secret_scan.find_secrets(docs))
    return _documents(got, F.col("text"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their ids."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("secrets", secrets),
    ("packed", packed),
]

#: The stages train a model and pack token ids, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each is written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
