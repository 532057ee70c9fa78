"""Rule and result queries over `events` seen as diagnostics, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import passages as ps
from tessera.operators import results as rs
from tessera.operators import rules as ru
from tessera.plans._tables import DIAGNOSTICS_SQL, RULES_SQL, RULES_TOML, diagnostics, read

CUSTOM = [
    ("CUSTOM1", "rights", "contains", "All rights reserved", "warning", "{rule_id}: {rule_name}", "messages", True, 1.0),
    ("CUSTOM2", "numbers", "regex", "[0-9]{3,}", "error", "has a number ({rule_name})", "messages", True, 1.0),
    ("CUSTOM3", "off", "contains", "a", "error", "never", "messages", False, 1.0),
    ("CUSTOM4", "paths", "contains", "a", "error", "never", "file_paths", True, 1.0),
    ("CUSTOM5", "tree", "ast", "a", "error", "never", "all", True, 1.0),
]


def _rules(spark):
    return ru.RulesConfig.from_toml(RULES_TOML).table(spark)


def rules_apply(spark, sf):
    return ru.apply_rules(diagnostics(spark, sf), _rules(spark)).select("event_id", "code", "level", "message")


def rules_custom_match(spark, sf):
    return ru.custom_matches(read(spark, sf, "documents"), spark.createDataFrame(CUSTOM, ru.CUSTOM_SCHEMA), "doc_id", "text", "messages")


def rules_summary(spark, sf):
    return ru.stats(diagnostics(spark, sf), _rules(spark))


def rules_unused(spark, sf):
    return ru.unused(diagnostics(spark, sf), _rules(spark))


def results_unique_files(spark, sf):
    return rs.unique_files(diagnostics(spark, sf))


def results_by_level(spark, sf):
    return rs.level_counts(diagnostics(spark, sf))


def report_group_by_file(spark, sf):
    got = rs.grouped_by_file(diagnostics(spark, sf))
    return got.select("event_id", "file_path", "in_file", F.col("place").cast("long").alias("place"))


def sarif_fingerprints(spark, sf):
    return rs.fingerprints(diagnostics(spark, sf))


def sarif_results(spark, sf):
    got = rs.sarif_results(diagnostics(spark, sf))
    get = lambda p: F.get_json_object("result", p)
    return got.select(get("$.ruleId").alias("rule"), get("$.level").alias("level"), get("$.message.text").alias("message"), get("$.locations[0].physicalLocation.artifactLocation.uri").alias("uri"))


def contains_passage(spark, sf):
    b = read(spark, sf, "benchmark").select("item_id", F.col("text").alias("passage"))
    return ps.holding(read(spark, sf, "documents").select("doc_id", "text"), b).select("doc_id", "item_id")


def _custom_sql() -> str:
    parts = []
    for id_, name, kind, pattern, severity, template, target, on, _ in CUSTOM:
        if on and target in ("messages", "all") and kind != "ast":
            test = f"contains(text, '{pattern}')" if kind == "contains" else f"regexp_matches(text, '{pattern}')"
            parts.append(f"SELECT doc_id, '{id_}' AS rule_id, '{severity}' AS severity, '{template.replace('{rule_id}', id_).replace('{rule_name}', name)}' AS message FROM documents WHERE {test}")
    return " UNION ALL ".join(parts)


QUERIES = {f.__name__: f for f in (rules_apply, rules_custom_match, rules_summary, rules_unused, results_unique_files, results_by_level, report_group_by_file, sarif_fingerprints, sarif_results, contains_passage)}

_D = f"WITH {DIAGNOSTICS_SQL}"
ORACLE_SQL = {
    "rules_apply": f"{_D}, {RULES_SQL} SELECT event_id, code, coalesce(r.severity, d.level) AS level, coalesce(r.message, d.message) AS message FROM diagnostics d LEFT JOIN rules r ON code = rule_id WHERE coalesce(r.enabled, true)",
    "rules_custom_match": _custom_sql(),
    "rules_summary": f"{_D}, {RULES_SQL} SELECT code AS rule_id, count(*) AS applications, count(*) FILTER (NOT enabled) AS violations, count(*) FILTER (NOT enabled) / count(*) AS rate FROM diagnostics JOIN rules ON code = rule_id GROUP BY code",
    "rules_unused": f"{_D}, {RULES_SQL} SELECT rule_id FROM rules WHERE rule_id NOT IN (SELECT code FROM diagnostics)",
    "results_unique_files": f"{_D} SELECT count(DISTINCT file_path) AS files, count(*) AS issues FROM diagnostics",
    "results_by_level": f"{_D} SELECT level, count(*) AS n, count(DISTINCT file_path) AS files FROM diagnostics GROUP BY level",
    "report_group_by_file": f"""{_D}, c AS (SELECT file_path, count(*) AS in_file FROM diagnostics GROUP BY file_path), p AS (SELECT *, row_number() OVER (ORDER BY in_file DESC, file_path) AS place FROM c)
      SELECT event_id, d.file_path, in_file, place FROM diagnostics d JOIN p ON d.file_path = p.file_path""",
    "sarif_fingerprints": f"{_D} SELECT concat_ws(':', code, file_path, line::VARCHAR) AS fingerprint, count(*) AS n FROM diagnostics GROUP BY 1",
    "sarif_results": f"{_D} SELECT code AS rule, CASE level WHEN 'info' THEN 'note' ELSE level END AS level, message, 'file://' || file_path AS uri FROM diagnostics",
    "contains_passage": "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
}
