"""Analysis results: filters, groups, order, counts, and the reports made from them.

A result row has list (error or warning), code, message, file_path, line, column_no, level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.names import html_escape, to_uri
from tessera.shared import numbered

#: The SARIF level of each level.
SARIF_LEVEL = {"error": "error", "warning": "warning", "info": "note", "hint": "note"}
SARIF_VERSION = "2.1.0"


def of_file(results: DataFrame, path: str) -> DataFrame:
    return results.where(F.col("file_path") == path)


def by_location(results: DataFrame) -> DataFrame:
    return results.orderBy("file_path", "line", "column_no", "code")


def unique_files(results: DataFrame) -> DataFrame:
    return results.agg(F.count_distinct("file_path").alias("files"), F.count(F.lit(1)).alias("issues"))


def level_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file_path").alias("files"))


def grouped_by_file(results: DataFrame) -> DataFrame:
    """Rows with the number of issues in their file and the place of the file: most issues first, then by path."""
    counts = results.groupBy("file_path").agg(F.count(F.lit(1)).alias("in_file"))
    places = numbered(counts, [F.desc("in_file"), F.asc("file_path")], "place", "files")
    return results.join(places, "file_path")


def fingerprints(results: DataFrame) -> DataFrame:
    """(fingerprint, n): results that are the same to a tracker: code, file and line."""
    key = F.concat_ws(":", "code", "file_path", F.col("line").cast("string"))
    return results.groupBy(key.alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"))


def sarif_results(results: DataFrame) -> DataFrame:
    """One SARIF result object a row, as JSON."""
    level = F.create_map(*(F.lit(x) for kv in SARIF_LEVEL.items() for x in kv))
    region = F.struct(F.col("line").alias("startLine"), F.col("column_no").alias("startColumn"))
    place = F.struct(F.struct(F.struct(to_uri(F.col("file_path")).alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    body = F.struct(F.col("code").alias("ruleId"), F.coalesce(level[F.col("level")], F.lit("none")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))
    return results.select(F.to_json(body).alias("result"))


def sarif_rules(results: DataFrame) -> DataFrame:
    """The rules that results refer to, as JSON, one a row."""
    return results.groupBy("code").agg(F.min("level").alias("level")).select(F.to_json(F.struct(F.col("code").alias("id"), F.struct(F.col("level")).alias("defaultConfiguration"))).alias("rule"))


def write_sarif(results: DataFrame, path: str, tool: str) -> None:
    """A folder with results, rules and artifacts as JSON lines, and the run's head: parts of a log too large for one file."""
    sarif_results(results).write.text(f"{path}/results")
    sarif_rules(results).write.text(f"{path}/rules")
    results.select(to_uri(F.col("file_path")).alias("uri")).distinct().select(F.to_json(F.struct(F.struct("uri").alias("location"))).alias("value")).write.text(f"{path}/artifacts")
    head = results.sparkSession.createDataFrame([(SARIF_VERSION, tool)], "version string, tool string")
    head.write.json(f"{path}/run")


def text_lines(results: DataFrame) -> DataFrame:
    """One line of a text report for each result, in order of files and places."""
    line = F.format_string("%s:%d:%d: %s %s: %s", "file_path", "line", "column_no", "level", F.coalesce("code", F.lit("-")), "message")
    return by_location(results).select(line.alias("value"))


def summary_lines(results: DataFrame) -> DataFrame:
    """The head of a report as lines: issues, files, and issues of each level from the gravest on."""
    got = results.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file_path").alias("files"), *(F.count_if(F.col("level") == x).alias(x) for x in SARIF_LEVEL))
    lines = [F.format_string("Issues: %d", "n"), F.format_string("Files: %d", "files"), *(F.format_string(f"{x}: %d", x) for x in SARIF_LEVEL)]
    return got.select(F.explode(F.array(*lines)).alias("value"))


def html_rows(results: DataFrame) -> DataFrame:
    """One table row of an HTML report for each result."""
    cells = [html_escape(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("level", "code", "file_path", "line", "message")]
    return by_location(results).select(F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *cells), F.lit("</td></tr>")).alias("value"))


def write_all(results: DataFrame, path: str, tool: str) -> None:
    """Every format under one folder."""
    write_sarif(results, f"{path}/sarif", tool)
    results.write.json(f"{path}/json")
    results.write.csv(f"{path}/csv", header=True)
    summary_lines(results).write.text(f"{path}/summary")
    text_lines(results).write.text(f"{path}/text")
    html_rows(results).write.text(f"{path}/html")


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
