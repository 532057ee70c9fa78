"""A project saved and loaded whole: its entities, the names they are found by, the edges of inheritance and a manifest.

Only entities of the configuration are saved with a project; those of the platform are shared by all projects of a
version and come from there when it is loaded. Edges are kept by id between all of them, and come back only where both
ends are known. A project is a folder under project=/version=; saved again, it replaces itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import closure, incremental, index
from tessera.shared import stored
from tessera.sources import entities as entity_rows

PLATFORM = "Platform"
MANIFEST = "project string, config_path string, version string, created_at timestamp, entities long, platform_entities long, config_entities long"


@dataclass
class Project:
    """entities (schemas.ENTITY); names (name, tier, id); edges (child, parent), ids; manifest, one row."""

    entities: DataFrame
    names: DataFrame
    edges: DataFrame
    manifest: DataFrame


def _numbered(entities: DataFrame) -> DataFrame:
    """entities with `load_ord`: platform first, then by id, so that of one name a configuration's entity is found."""
    return entities.select("id", "qualified_name", "display_name", "entity_type").withColumn("load_ord", F.when(F.col("entity_type") == PLATFORM, 0).otherwise(1).cast("long"))


def edges_of(entities: DataFrame) -> DataFrame:
    """(child, parent) by id, from the names of parent types."""
    return closure.link(entity_rows.parent_rows(entities), _numbered(entities))


def build(entities: DataFrame, project: str, config_path: str, version: str) -> Project:
    """A project of entities: all tables come from that of the entities."""
    of_config = F.col("entity_type") != PLATFORM
    manifest = entities.agg(F.count(F.lit(1)).alias("entities"), F.count_if(~of_config).alias("platform_entities"), F.count_if(of_config).alias("config_entities"))
    manifest = manifest.select(F.lit(project).alias("project"), F.lit(config_path).alias("config_path"), F.lit(version).alias("version"), F.current_timestamp().alias("created_at"), "entities", "platform_entities", "config_entities")
    return Project(entities, index.name_index(_numbered(entities)), edges_of(entities), manifest)


def save(found: Project, path: str) -> None:
    """Writes a project under a path; the manifest last, so that a folder without one is not a project."""
    row = found.manifest.first()
    base = f"{path}/project={row.project}/version={row.version}"
    own = found.entities.where(F.col("entity_type") != PLATFORM)
    entity_rows.write_jsonl(own, f"{base}/entities")
    found.names.join(own.select("id"), "id", "left_semi").write.mode("overwrite").json(f"{base}/names")
    found.edges.write.mode("overwrite").json(f"{base}/edges")
    found.manifest.coalesce(1).write.mode("overwrite").json(f"{base}/manifest")


def load(spark: SparkSession, path: str, project: str, version: str, platform: DataFrame | None = None) -> Project:
    """A saved project with the platform's entities, if they are given; edges to entities that aren't there are left out."""
    base = f"{path}/project={project}/version={version}"
    manifest = spark.read.schema(MANIFEST).json(f"{base}/manifest")
    own = entity_rows.read_jsonl(spark, f"{base}/entities")
    names = spark.read.schema("id string, name string, tier int").json(f"{base}/names").select("name", "tier", "id")
    edges = spark.read.schema("child string, parent string").json(f"{base}/edges")
    whole = own
    if platform is not None:
        whole = stored(own.unionByName(platform), "entities")
        others = index.name_index(_numbered(platform)).join(names.select("name", "tier"), ["name", "tier"], "left_anti")
        names = names.unionByName(others.select("name", "tier", "id"))
    return Project(whole, names, incremental.imported_edges(edges, whole).select("child", "parent"), manifest)
