"""Rules over diagnostics: enabling by profile, new levels and messages, custom patterns, statistics.

Rules, profiles and patterns are small tables given by a configuration; they are broadcast.
"""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULE_SCHEMA = "rule_id string, enabled boolean, severity string, message string, min_confidence double, tags array<string>"
CUSTOM_SCHEMA = "rule_id string, name string, pattern_type string, pattern string, severity string, template string, applies_to string, enabled boolean, confidence double"
#: Severities from the gravest on, and the level that each gives a diagnostic.
SEVERITIES = ("error", "warning", "info", "hint")


# The rules that come with the engine: severity, whether on, least confidence, tags, message.
CATALOGUE = {
    "BSL001": ("warning", True, 0.9, ("unused", "cleanup"), "Unused variable '{name}'. Consider removing it or prefixing with '_'"),
    "BSL002": ("error", True, 0.95, ("undefined", "error"), "Undefined variable '{name}'. Declare it with 'Перем' statement"),
    "BSL003": ("warning", True, 0.8, ("types", "safety"), "Type mismatch: cannot assign {source_type} to {target_type}"),
    "BSL004": ("warning", True, 0.85, ("methods", "documentation"), "Unknown method '{method}'. Check spelling or documentation"),
    "BSL005": ("error", True, 1.0, ("dependencies", "architecture"), "Circular dependency: {module_a} -> {module_b} -> {module_a}"),
    "BSL006": ("info", True, 0.9, ("dead-code", "cleanup"), "Dead code detected: this code will never be executed"),
    "BSL007": ("hint", True, 0.8, ("complexity", "refactoring"), "Function '{name}' is complex (complexity: {complexity}). Consider refactoring"),
    "BSL008": ("hint", False, 0.7, ("documentation", "public-api"), "Public {type} '{name}' should have documentation comment"),
    "BSL009": ("info", True, 0.75, ("performance", "optimization"), "Performance warning: {issue}. Consider {suggestion}"),
    "BSL010": ("warning", True, 0.9, ("security", "safety"), "Security warning: {issue}. {recommendation}"),
}
# What to do about a rule's diagnostics; any other rule has the last.
ADVICE = {
    "BSL001": ("Remove the unused variable", "Prefix variable name with '_' if it's intentionally unused", "Use the variable in your code logic"),
    "BSL002": ("Add 'Перем VariableName;' declaration", "Check for typos in variable name", "Verify variable scope and accessibility"),
    "BSL003": ("Use explicit type conversion functions", "Check data types compatibility", "Review assignment logic"),
    "BSL004": ("Check method name spelling", "Verify method is available in current context", "Consult 1C:Enterprise documentation", "Check if method is from external component"),
    "BSL005": ("Refactor modules to remove circular dependency", "Extract common functionality to separate module", "Review module architecture"),
}
OTHER_ADVICE = ("Follow BSL best practices",)
# What the ids of custom rules begin with.
CUSTOM_PREFIXES = ("CUSTOM", "USER")


@dataclass
class Profile:
    name: str
    extends: str | None = None
    includes: list[str] = field(default_factory=list)
    excludes: list[str] = field(default_factory=list)
    default_severity: str = "warning"


@dataclass
class RulesConfig:
    """Rules by id, profiles by name, and the profile in force."""

    rules: dict[str, dict]
    profiles: dict[str, Profile]
    active: str = "default"

    @classmethod
    def from_toml(cls, text: str) -> RulesConfig:
        raw = tomllib.loads(text)
        profiles = {k: Profile(k, v.get("extends"), v.get("includes", []), v.get("excludes", []), str(v.get("default_severity", "warning")).lower()) for k, v in raw.get("profiles", {}).items()}
        return cls(raw.get("rules", {}), profiles or {"default": Profile("default")}, raw.get("active_profile", "default"))

    def effective(self) -> Profile:
        """The active profile with what it extends; its own lists are added to the inherited ones."""
        seen, chain, name = set(), [], self.active
        while name is not None:
            if name in seen or name not in self.profiles:
                raise ValueError(f"profile {name!r} is unknown or extends itself")
            seen.add(name)
            chain.append(self.profiles[name])
            name = self.profiles[name].extends
        out = Profile(self.active, None, [], [], chain[0].default_severity)
        for p in reversed(chain):
            out.includes += p.includes
            out.excludes += p.excludes
        return out

    def problems(self) -> list[str]:
        """What is wrong with the configuration."""
        out = [] if self.active in self.profiles else [f"active profile {self.active} is missing"]
        for p in self.profiles.values():
            out += [f"profile {p.name} extends {p.extends}, which is missing"] if p.extends and p.extends not in self.profiles else []
            out += [f"profile {p.name} names unknown rule {r}" for r in (*p.includes, *p.excludes) if r not in self.rules]
        out += [f"rule {k} has confidence {v['min_confidence']}" for k, v in self.rules.items() if not 0 <= v.get("min_confidence", 0.8) <= 1]
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """A row for each rule; `enabled` takes the profile into account, a missing severity is the profile's."""
        p = self.effective()
        rows = []
        for k, v in sorted(self.rules.items()):
            on = v.get("enabled", True) and k not in p.excludes and (not p.includes or k in p.includes)
            rows.append((k, on, str(v.get("severity") or p.default_severity).lower(), v.get("message"), float(v.get("min_confidence", 0.8)), list(v.get("tags", []))))
        return spark.createDataFrame(rows, RULE_SCHEMA)


def strict(config: RulesConfig) -> RulesConfig:
    """Every rule on, and info and hint raised to warning."""
    rules = {k: v | {"enabled": True, "severity": "warning" if str(v.get("severity", "")).lower() in ("info", "hint") else v.get("severity")} for k, v in config.rules.items()}
    profiles = config.profiles | {"strict": Profile("strict", None, sorted(rules), [], "warning")}
    return RulesConfig(rules, profiles, "strict")


def catalogue(spark: SparkSession) -> DataFrame:
    """The rules that come with the engine, as a table of rules."""
    return spark.createDataFrame([(k, on, severity, message, least, list(tags)) for k, (severity, on, least, tags, message) in CATALOGUE.items()], RULE_SCHEMA)


def advice(diagnostics: DataFrame) -> DataFrame:
    """diagnostics with `advice`, what to do about each by its code."""
    table = F.create_map(*(x for k, v in ADVICE.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return diagnostics.withColumn("advice", F.coalesce(table[F.col("code")], F.array(*map(F.lit, OTHER_ADVICE))))


BAD_PATTERN = "the pattern is no regular expression"


def custom_problems(rule: dict) -> list[str]:
    """What is wrong with a custom rule."""
    id_, pattern, least = rule.get("id", ""), rule.get("pattern", ""), rule.get("confidence", 1.0)
    found = {
        "the id is missing": not id_,
        f"the id begins with none of {', '.join(CUSTOM_PREFIXES)}": not id_.startswith(CUSTOM_PREFIXES),
        "there is no pattern to look for": not pattern,
        f"{BAD_PATTERN}: {_compile_error(pattern)}": rule.get("pattern_type") == "regex" and bool(_compile_error(pattern)),
        f"a confidence of {least} is not within 0 and 1": not 0 <= least <= 1,
        "there is no message": not rule.get("message_template"),
    }
    return [problem for problem, holds in found.items() if holds]


def _compile_error(pattern: str) -> str:
    try:
        re.compile(pattern)
    except re.error as e:
        return str(e)
    return ""


def custom_rules(spark: SparkSession, text: str) -> DataFrame:
    """The table of custom rules in a TOML text, by id; a regular expression that can't be compiled is an error."""
    rows = []
    for id_, r in sorted(tomllib.loads(text).items()):
        r = r | {"id": id_, "pattern_type": str(r.get("pattern_type", "contains")).lower()}
        wrong = [p for p in custom_problems(r) if p.startswith(BAD_PATTERN)]
        if wrong:
            raise ValueError(f"rule {id_}: {wrong[0]}")
        rows.append((id_, r.get("name", id_), r["pattern_type"], r.get("pattern", ""), str(r.get("severity", "warning")).lower(), r.get("message_template", ""), str(r.get("applies_to", "all")).lower(), bool(r.get("enabled", True)), float(r.get("confidence", 1.0))))
    return spark.createDataFrame(rows, CUSTOM_SCHEMA)


def write_stats(counts: DataFrame, path: str) -> None:
    """What `stats` returns, as JSON lines."""
    counts.write.json(path)


def at_least(diagnostics: DataFrame, severity: str) -> DataFrame:
    """Diagnostics of a level as grave as `severity` or graver."""
    return diagnostics.where(F.col("level").isin(*SEVERITIES[: SEVERITIES.index(severity) + 1]))


def summary(counts: DataFrame) -> DataFrame:
    """Totals over what `stats` returns: rules met, applications, violations, rate."""
    got = counts.agg(F.count(F.lit(1)).alias("rules"), F.coalesce(F.sum("applications"), F.lit(0)).alias("applications"), F.coalesce(F.sum("violations"), F.lit(0)).alias("violations"))
    return got.withColumn("rate", F.try_divide(F.col("violations"), F.col("applications")))


def apply_rules(diagnostics: DataFrame, rules: DataFrame) -> DataFrame:
    """Drops diagnostics of rules that are off, and gives the rest the level and message of their rule; unknown codes pass.

    diagnostics: code, level, message and more. A rule that asks for a confidence over the diagnostic's own
    (column `confidence`, 1 if absent) drops it too.
    """
    r = F.broadcast(rules.select(F.col("rule_id").alias("code"), F.col("enabled").alias("_on"), F.col("severity").alias("_level"), F.col("message").alias("_message"), F.col("min_confidence").alias("_least")))
    own = F.col("confidence") if "confidence" in diagnostics.columns else F.lit(1.0)
    keep = F.coalesce(F.col("_on"), F.lit(True)) & (own >= F.coalesce(F.col("_least"), F.lit(0.0)))
    out = diagnostics.join(r, "code", "left").where(keep)
    return out.withColumns({"level": F.coalesce("_level", "level"), "message": F.coalesce("_message", "message")}).drop("_on", "_level", "_message", "_least")


def custom_matches(rows: DataFrame, rules: DataFrame, key: str, text: str, target: str) -> DataFrame:
    """(key, rule_id, severity, message): custom rules of a target whose pattern the text meets. rules is a small table.

    One pass over the rows tries all rules of a kind; no pair that doesn't match is made.
    """
    out = None
    for r in rules.where(F.col("enabled") & F.col("applies_to").isin(target, "all")).collect():  # a configuration's rules
        col, pattern = F.col(text), F.lit(r.pattern)
        hit = {"contains": F.contains(col, pattern), "regex": F.regexp_like(col, pattern), "exact": col == pattern}.get(r.pattern_type, F.lit(False))
        message = F.lit(r.template)
        for name, value in (("{original_message}", col), ("{rule_name}", F.lit(r.name)), ("{rule_id}", F.lit(r.rule_id))):
            message = F.replace(message, F.lit(name), value)
        item = F.when(hit, F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), message.alias("message")))
        out = [item] if out is None else [*out, item]
    if not out:
        return rows.select(key).where(F.lit(False)).selectExpr(key, "cast(null as string) rule_id", "cast(null as string) severity", "cast(null as string) message")
    return rows.select(key, F.inline(F.array_compact(F.array(*out))))


def stats(diagnostics: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_id, applications, violations, rate): how often each known rule met a diagnostic, and how many it dropped."""
    r = F.broadcast(rules.select(F.col("rule_id").alias("code"), "enabled"))
    rows = diagnostics.join(r, "code").groupBy(F.col("code").alias("rule_id")).agg(F.count(F.lit(1)).alias("applications"), F.count_if(~F.col("enabled")).alias("violations"))
    return rows.withColumn("rate", F.try_divide(F.col("violations"), F.col("applications")))


def unused(diagnostics: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules that no diagnostic has the code of."""
    return rules.select("rule_id").join(diagnostics.select(F.col("code").alias("rule_id")), "rule_id", "left_anti")
