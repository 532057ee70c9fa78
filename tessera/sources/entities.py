"""Entities as JSON lines, and as rows of members for queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.schemas import ENTITY, METHOD, PROPERTY


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One entity a line; blank lines are skipped, a line that is no entity fails the read."""
    return spark.read.schema(ENTITY).option("mode", "FAILFAST").json(path)


def write_jsonl(entities: DataFrame, path: str, project: str | None = None, version: str | None = None) -> None:
    """JSON lines, in folders of project and version where given."""
    out, by = entities, []
    for name, value in (("project", project), ("version", version)):
        if value is not None:
            out, by = out.withColumn(name, F.lit(value)), [*by, name]
    out.write.mode("overwrite").partitionBy(*by).json(path) if by else out.write.mode("overwrite").json(path)


def method_rows(entities: DataFrame) -> DataFrame:
    """(id, member, method): methods of each entity."""
    return entities.select("id", F.explode("interface.methods").alias("member", "method"))


def property_rows(entities: DataFrame) -> DataFrame:
    return entities.select("id", F.explode("interface.properties").alias("member", "property"))


def parent_rows(entities: DataFrame) -> DataFrame:
    """(child, parent_name): names of parent types, to be linked by `operators.closure.link`."""
    return entities.select(F.col("id").alias("child"), F.explode("constraints.parent_types").alias("parent_name"))


def methods_of_json(rows: DataFrame) -> DataFrame:
    """(id, method) from (id, json): a method's JSON text as the record of schemas.METHOD; a text that is none gives nulls."""
    return rows.select("id", F.from_json("json", METHOD).alias("method"))


def properties_of_json(rows: DataFrame) -> DataFrame:
    """(id, property) from (id, json); a missing type is Unknown."""
    p = F.from_json("json", PROPERTY)
    return rows.select("id", p.withField("type_name", F.coalesce(p["type_name"], F.lit("Unknown"))).alias("property"))


def owns(entities: DataFrame, member: str) -> DataFrame:
    """Entities with a method or property of their own of that name."""
    return entities.where(F.map_contains_key("interface.methods", member) | F.map_contains_key("interface.properties", member))


def properties_inverted(entities: DataFrame) -> DataFrame:
    """(member, id): every holder of every property."""
    return property_rows(entities).select("member", "id").distinct()
