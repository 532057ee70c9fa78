"""The driver's tables seen as the engine's own: entities, inheritance edges, diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """Regions, nations, suppliers, customers and parts as entities; a part's display name is bilingual: "name (brand)"."""
    spec = (
        ("region", "r_regionkey", F.col("r_name"), "Platform", F.lit("Region")),
        ("nation", "n_nationkey", F.col("n_name"), "Platform", F.lit("Nation")),
        ("supplier", "s_suppkey", F.col("s_name"), "Configuration", F.lit("Supplier")),
        ("customer", "c_custkey", F.col("c_name"), "Configuration", F.col("c_mktsegment")),
        ("part", "p_partkey", F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")), "Configuration", F.col("p_type")),
    )
    out = None
    for order, (table, key, display, kind, sub) in enumerate(spec):
        id_ = F.concat(F.lit(f"{table}."), F.col(key).cast("string"))
        rows = read(spark, sf, table).select(id_.alias("id"), id_.alias("qualified_name"), display.alias("display_name"), F.lit(kind).alias("entity_type"), sub.alias("entity_kind"), (F.col(key).cast("long") + order * 1_000_000_000).alias("load_ord"))
        out = rows if out is None else out.unionByName(rows)
    return out


ENTITIES_SQL = """entities AS (
  SELECT 'region.' || r_regionkey AS id, r_name AS display_name, 'Platform' AS entity_type, 'Region' AS entity_kind, r_regionkey::BIGINT AS load_ord FROM region
  UNION ALL SELECT 'nation.' || n_nationkey, n_name, 'Platform', 'Nation', n_nationkey + 1000000000 FROM nation
  UNION ALL SELECT 'supplier.' || s_suppkey, s_name, 'Configuration', 'Supplier', s_suppkey + 2000000000 FROM supplier
  UNION ALL SELECT 'customer.' || c_custkey, c_name, 'Configuration', c_mktsegment, c_custkey + 3000000000 FROM customer
  UNION ALL SELECT 'part.' || p_partkey, p_name || ' (' || p_brand || ')', 'Configuration', p_type, p_partkey + 4000000000 FROM part)"""

NAMES_SQL = """names AS (SELECT name, tier, arg_max(id, load_ord) AS id FROM (
  SELECT id AS name, 1 AS tier, id, load_ord FROM entities UNION ALL SELECT display_name, 2, id, load_ord FROM entities
  UNION ALL SELECT regexp_extract(display_name, '^(.*?) \\((.*)\\)', 1), 4, id, load_ord FROM entities
  UNION ALL SELECT regexp_extract(display_name, '^(.*?) \\((.*)\\)', 2), 4, id, load_ord FROM entities) WHERE name <> '' GROUP BY name, tier)"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """(child, parent): nation in region, supplier and customer in nation."""
    spec = (("nation", "n_nationkey", "region", "n_regionkey"), ("supplier", "s_suppkey", "nation", "s_nationkey"), ("customer", "c_custkey", "nation", "c_nationkey"))
    out = None
    for table, key, up, ref in spec:
        rows = read(spark, sf, table).select(F.concat(F.lit(f"{table}."), F.col(key).cast("string")).alias("child"), F.concat(F.lit(f"{up}."), F.col(ref).cast("string")).alias("parent"))
        out = rows if out is None else out.unionByName(rows)
    return out


EDGES_SQL = """edges AS (SELECT 'nation.' || n_nationkey AS child, 'region.' || n_regionkey AS parent FROM nation
  UNION ALL SELECT 'supplier.' || s_suppkey, 'nation.' || s_nationkey FROM supplier
  UNION ALL SELECT 'customer.' || c_custkey, 'nation.' || c_nationkey FROM customer)"""

#: All ancestors, however far; needs WITH RECURSIVE.
CLOSURE_SQL = """steps AS (SELECT child AS descendant, parent AS ancestor, 1 AS depth FROM edges UNION SELECT s.descendant, e.parent, s.depth + 1 FROM steps s JOIN edges e ON s.ancestor = e.child),
  reach AS (SELECT descendant, ancestor, min(depth) AS depth FROM steps GROUP BY descendant, ancestor)"""


def diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """Events as diagnostics: the type is the code, the user the file, the id the line."""
    e = read(spark, sf, "events")
    level = F.when(F.col("event_type") == "error", "error").when(F.col("value") > 50, "warning").otherwise("info")
    return e.select(
        "event_id",
        F.col("event_type").alias("code"),
        level.alias("level"),
        F.concat(F.lit("value "), F.col("value").cast("string")).alias("message"),
        F.concat(F.lit("/src/user"), F.col("user_id").cast("string")).alias("file_path"),
        F.col("event_id").alias("line"),
        F.get_json_object("props", "$.k").cast("long").alias("column_no"),
    )


DIAGNOSTICS_SQL = """diagnostics AS (SELECT event_id, event_type AS code, CASE WHEN event_type = 'error' THEN 'error' WHEN value > 50 THEN 'warning' ELSE 'info' END AS level,
  'value ' || value::VARCHAR AS message, '/src/user' || user_id AS file_path, event_id AS line, (props::JSON ->> '$.k')::BIGINT AS column_no FROM events)"""

#: A configuration that meets every case: a rule that is off, a new level, a new message, a threshold, a rule without diagnostics.
RULES_TOML = """
active_profile = "lenient"
[profiles.default]
default_severity = "warning"
[profiles.lenient]
extends = "default"
excludes = ["view"]
default_severity = "info"
[rules.view]
severity = "hint"
[rules.click]
message = "clicked"
[rules.error]
severity = "error"
min_confidence = 0.9
[rules.purchase]
enabled = false
[rules.never]
severity = "error"
"""
RULES_SQL = """rules(rule_id, enabled, severity, message) AS (VALUES ('click', true, 'info', 'clicked'), ('error', true, 'error', NULL), ('never', true, 'error', NULL), ('purchase', false, 'info', NULL), ('view', false, 'hint', NULL))"""
