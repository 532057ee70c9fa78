"""Source modules as rows (path, text)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources import tokens


def strip_bom(text: Column) -> Column:
    return F.regexp_replace(text, "^\\x{FEFF}+", "")


def read_modules(spark: SparkSession, path: str, glob: str = "*.bsl") -> DataFrame:
    """Every module under a folder, whole, without byte-order mark."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return rows.select(F.col("_metadata.file_path").alias("path"), strip_bom(F.col("value")).alias("text"))


def module_type(path: Column) -> Column:
    """What a module belongs to, by its file name."""
    name = F.substring_index(path, "/", -1)
    return F.when(name == "ObjectModule.bsl", "object").when(name == "ManagerModule.bsl", "manager").when(F.contains(path, F.lit("/Forms/")), "form").when(F.contains(path, F.lit("CommonModules")), "common").otherwise("other")


def routines(modules: DataFrame) -> DataFrame:
    """(path, pos, kind, name, parameters, by_value, is_export): routine headers of each module, a row each; by_value tells of each parameter whether it is one."""
    header = "(?m)^[\\x20\\t]*(Процедура|Функция|Procedure|Function)\\s+([\\w\\u0400-\\u04FF]+)\\s*\\(([^)]*)\\)[\\x20\\t]*(Экспорт|Export)?"
    h = F.lit(header)
    parts = F.arrays_zip(*(F.regexp_extract_all("text", h, F.lit(i)).alias(n) for i, n in ((1, "kind"), (2, "name"), (3, "args"), (4, "export"))))
    rows = modules.select("path", F.posexplode(parts).alias("pos", "r"))
    taken = F.transform(F.split("r.args", ","), lambda a: F.struct(F.regexp_extract(a, "(?:Знач\\s+|Val\\s+)?([\\w\\u0400-\\u04FF]+)", 1).alias("name"), F.regexp_like(a, F.lit("^\\s*(?:Знач|Val)\\s")).alias("by_value")))
    taken = F.filter(taken, lambda a: a["name"] != "")
    kind = F.when(F.col("r.kind").isin("Функция", "Function"), "function").otherwise("procedure")
    return rows.select("path", "pos", kind.alias("kind"), F.col("r.name").alias("name"), taken["name"].alias("parameters"), taken["by_value"].alias("by_value"), (F.col("r.export") != "").alias("is_export"))


def calls(modules: DataFrame) -> DataFrame:
    """Calls of each module with their own arguments: see `sources.tokens.calls`."""
    return tokens.calls(modules)


def variable_events(modules: DataFrame) -> DataFrame:
    """(scope, name, pos, action, type): declarations and assignments of each line as events of `operators.flow`.

    `Перем a, b;` declares, `a = value` writes a and reads every other name of the line, any other line
    reads its names. The scope is the routine that the line is in.
    """
    word = "[\\w\\u0400-\\u04FF]+"
    rows = modules.select("path", F.posexplode(F.split("text", "\\r?\\n")).alias("line", "body")).withColumn("body", F.regexp_replace("body", '//.*$|"[^"]*"', ""))
    head = F.nullif(F.regexp_extract("body", f"^\\s*(?:Процедура|Функция|Procedure|Function)\\s+({word})", 1), F.lit(""))
    upto = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("head", head).withColumn("scope", F.concat_ws("#", "path", F.last("head", ignorenulls=True).over(upto))).where("head is null")
    declared = F.regexp_extract("body", f"^\\s*(?:Перем|Var)\\s+({word}(?:\\s*,\\s*{word})*)", 1)
    target = F.regexp_extract("body", f"^\\s*({word})\\s*=(?!=)", 1)
    rest = F.when(target != "", F.regexp_replace("body", f"^\\s*{word}\\s*=", "")).otherwise(F.col("body"))
    struct = lambda n, a: F.struct(n.alias("name"), F.lit(a).alias("action"))
    events = F.when(declared != "", F.transform(F.split(declared, "\\s*,\\s*"), lambda n: struct(n, "declare"))).otherwise(
        F.concat(F.transform(F.regexp_extract_all(rest, F.lit(f"({word})"), F.lit(1)), lambda n: struct(n, "read")), F.when(target != "", F.array(struct(target, "write"))).otherwise(F.array().cast("array<struct<name:string,action:string>>")))
    )
    out = rows.select("scope", "line", F.posexplode(events).alias("k", "e"))
    return out.select("scope", F.col("e.name").alias("name"), (F.col("line") * 10_000 + F.col("k")).cast("long").alias("pos"), F.col("e.action").alias("action"), F.lit(None).cast("string").alias("type"))


def looks_like_module(text: Column) -> Column:
    """Whether a text has a routine at all."""
    return F.contains(text, F.lit("Процедура")) | F.contains(text, F.lit("Функция"))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, encoding) of report files: UTF-16 if they say so, else UTF-8 if they are, else Windows-1251."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                if raw.startswith(b"\xff\xfe"):
                    rows.append((name, raw[2:].decode("utf-16-le", "replace"), "UTF-16LE"))
                    continue
                try:
                    rows.append((name, raw.decode("utf-8-sig"), "UTF-8"))
                except UnicodeDecodeError:
                    rows.append((name, raw.decode("cp1251", "replace"), "CP1251"))
            yield pd.DataFrame(rows, columns=["path", "text", "encoding"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(decode, "path string, text string, encoding string")
