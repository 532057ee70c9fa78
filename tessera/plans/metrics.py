"""Metric queries over `documents`, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.lexicon import PROSE as LEX
from tessera.operators import metrics as m
from tessera.plans._sql import LINES, count_of, has_any, quoted


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")


def _r(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def metrics_loc(spark, sf):
    return m.token_counts(_docs(spark, sf), LEX).select("doc_id", "loc", "n_lines")


def metrics_tokens(spark, sf):
    return m.token_counts(_docs(spark, sf), LEX).select("doc_id", "routines", "conditions", "loops", "operators", "operands")


def metrics_complexity(spark, sf):
    return m.with_complexity(m.token_counts(_docs(spark, sf), LEX)).select("doc_id", "cyclomatic", "cognitive")


def metrics_halstead(spark, sf):
    return _r(m.with_maintainability(m.token_counts(_docs(spark, sf), LEX)).select("doc_id", "operators", "operands", "volume"), "volume")


def metrics_maintainability(spark, sf):
    return _r(m.with_maintainability(m.token_counts(_docs(spark, sf), LEX)).select("doc_id", "maintainability"), "maintainability")


def metrics_duplication(spark, sf):
    return _r(m.duplication(_docs(spark, sf), LEX), "dup_pct")


def metrics_debt_items(spark, sf):
    return m.debt_items(_docs(spark, sf), LEX)


def metrics_debt_by_type(spark, sf):
    items = m.debt_items(_docs(spark, sf), LEX)
    return items.groupBy("type", "severity").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("minutes")).alias("minutes"))


def metrics_quality(spark, sf):
    got = m.quality(_docs(spark, sf), LEX)
    return _r(got.select("doc_id", "cyclomatic", "maintainability", "n_items", "minutes", "dup_pct", "score"), "maintainability", "dup_pct", "score")


def metrics_recommendations(spark, sf):
    return m.quality(_docs(spark, sf), LEX).select("doc_id", "advice")


def metrics_rollup(spark, sf):
    docs = _docs(spark, sf)
    got = m.rollup(docs, m.with_maintainability(m.token_counts(docs, LEX)))
    return _r(got.withColumn("level", F.col("level").cast("long")), "avg_maintainability")


def project_stats(spark, sf):
    return m.project_stats(_docs(spark, sf))


_BASE = f"""t AS (SELECT doc_id, text, lang, source, {LINES} AS ls FROM documents),
c AS (SELECT doc_id, lang, source, len(list_filter(ls, lambda x: trim(regexp_replace(x, '\\s', '', 'g')) <> '')) AS loc, len(ls) AS n_lines, ({count_of("text", LEX.routine)}) AS routines,
  ({count_of("text", LEX.condition)}) AS conditions, ({count_of("text", LEX.loop)}) AS loops, ({count_of("text", LEX.operator)}) AS operators,
  len(regexp_extract_all(text, '\\S+')) AS operands FROM t),
k AS (SELECT *, CASE WHEN routines > 0 THEN conditions + loops + 1 ELSE 1 END::DOUBLE AS cyclomatic, CASE WHEN routines > 0 THEN conditions + 2 * loops + 1 ELSE 1 END::DOUBLE AS cognitive,
  CASE WHEN operators + operands > 0 THEN (operators + operands) * log2(operators + operands) END AS volume FROM c),
v AS (SELECT *, CASE WHEN volume IS NULL THEN NULL WHEN volume <= 0 OR loc = 0 THEN 100.0
  ELSE greatest(0.0, least(100.0, 171.0::DOUBLE - 5.2::DOUBLE * ln(volume) - 0.23::DOUBLE * (conditions + loops + 1) - 16.2::DOUBLE * ln(loc))) END::DOUBLE AS maintainability FROM k)"""

_ROWS = """l AS (SELECT doc_id, len(ls) AS n_lines, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM t)"""
_DUP = """b AS (SELECT doc_id, pos, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS block FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
h AS (SELECT doc_id, pos, max(pos) OVER (PARTITION BY doc_id, block) AS last FROM b WHERE block IS NOT NULL),
d AS (SELECT t.doc_id, CASE WHEN len(t.ls) < 3 OR n IS NULL THEN 0.0::DOUBLE ELSE least(100.0, n * 3 / len(t.ls)::DOUBLE * 100.0) END AS dup_pct
  FROM t LEFT JOIN (SELECT doc_id, count(*) AS n FROM h WHERE last >= pos + 3 GROUP BY doc_id) x ON t.doc_id = x.doc_id)"""
_LONG = f"""r AS (SELECT doc_id, n_lines, pos, {has_any("line", LEX.routine)} AS starts,
  min(CASE WHEN {has_any("line", LEX.routine_end)} THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM l),
g AS (SELECT doc_id, count(*) AS n FROM r WHERE starts AND coalesce(stop, n_lines) - pos > 50 GROUP BY doc_id)"""
_ITEMS = f"""i AS (SELECT doc_id, 'long_routine' AS item, 'CodeQuality' AS type, 'Medium' AS severity, 30 AS minutes, n FROM g
  UNION ALL SELECT doc_id, 'numbers', 'CodeQuality', 'Low', 15, 1 FROM t WHERE len(regexp_extract_all(text, '\\pN')) > 5
  UNION ALL SELECT doc_id, 'loops', 'Performance', 'Medium', 45, 1 FROM t WHERE {count_of("text", LEX.loop_keyword)} > 2
  UNION ALL SELECT doc_id, 'concat_in_loop', 'Performance', 'High', 60, 1 FROM t WHERE contains(text, {quoted(LEX.loop_head)}) AND contains(text, {quoted(LEX.concat)})
  UNION ALL SELECT doc_id, 'undocumented', 'Documentation', 'Medium', 20, 1 FROM t WHERE {count_of("text", LEX.routine)} > 0 AND NOT contains(text, {quoted(LEX.comment)}))"""
_ALL = f"""WITH {_BASE}, {_ROWS}, {_DUP}, {_LONG}, {_ITEMS},
s AS (SELECT doc_id, sum(n)::BIGINT AS n_items, sum(n * minutes)::BIGINT AS minutes, sum(CASE WHEN severity = 'High' THEN n * minutes ELSE 0 END)::BIGINT AS high_minutes FROM i GROUP BY doc_id),
q AS (SELECT v.*, d.dup_pct, coalesce(s.n_items, 0) AS n_items, coalesce(s.minutes, 0) AS minutes, coalesce(s.high_minutes, 0) AS high_minutes
  FROM v JOIN d ON v.doc_id = d.doc_id LEFT JOIN s ON v.doc_id = s.doc_id),
z AS (SELECT *, (CASE WHEN cyclomatic <= 2 THEN 100 WHEN cyclomatic <= 5 THEN 80 WHEN cyclomatic <= 10 THEN 60 ELSE 30 END) * 0.3::DOUBLE + maintainability * 0.3::DOUBLE
  + (CASE WHEN n_items <= 0 THEN 100 WHEN n_items <= 3 THEN 85 WHEN n_items <= 7 THEN 70 WHEN n_items <= 15 THEN 50 ELSE 25 END) * 0.25::DOUBLE
  + (CASE WHEN dup_pct < 5 THEN 100 WHEN dup_pct < 10 THEN 80 WHEN dup_pct < 20 THEN 60 ELSE 30 END) * 0.15::DOUBLE AS raw FROM q)"""
_ADVICE = ", ".join(f"CASE WHEN {p} THEN {quoted(a)} END" for p, a in m.ADVICE)
_NONE = ", ".join(map(quoted, m.NO_ADVICE))

QUERIES = {
    f.__name__: f
    for f in (metrics_loc, metrics_tokens, metrics_complexity, metrics_halstead, metrics_maintainability, metrics_duplication, metrics_debt_items, metrics_debt_by_type, metrics_quality, metrics_recommendations, metrics_rollup, project_stats)
}

ORACLE_SQL = {
    "metrics_loc": f"WITH {_BASE} SELECT doc_id, loc, n_lines FROM c",
    "metrics_tokens": f"WITH {_BASE} SELECT doc_id, routines, conditions, loops, operators, operands FROM c",
    "metrics_complexity": f"WITH {_BASE} SELECT doc_id, cyclomatic, cognitive FROM k",
    "metrics_halstead": f"WITH {_BASE} SELECT doc_id, operators, operands, round(volume, 6) AS volume FROM k",
    "metrics_maintainability": f"WITH {_BASE} SELECT doc_id, round(maintainability, 6) AS maintainability FROM v",
    "metrics_duplication": f"WITH {_BASE}, {_ROWS}, {_DUP} SELECT doc_id, round(dup_pct, 6) AS dup_pct FROM d",
    "metrics_debt_items": f"WITH {_BASE}, {_ROWS}, {_LONG}, {_ITEMS} SELECT doc_id, item, type, severity, minutes::BIGINT AS minutes, n::BIGINT AS n FROM i",
    "metrics_debt_by_type": f"WITH {_BASE}, {_ROWS}, {_LONG}, {_ITEMS} SELECT type, severity, sum(n)::BIGINT AS n, sum(n * minutes)::BIGINT AS minutes FROM i GROUP BY type, severity",
    "metrics_quality": f"{_ALL} SELECT doc_id, cyclomatic, round(maintainability, 6) AS maintainability, n_items, minutes, round(dup_pct, 6) AS dup_pct, round(CASE WHEN raw IS NOT NULL THEN greatest(0.0, least(100.0, raw)) END, 6) AS score FROM z",
    "metrics_recommendations": f"""{_ALL}, a AS (SELECT doc_id, list_filter([{_ADVICE}], lambda x: x IS NOT NULL) AS found FROM z)
      SELECT doc_id, array_to_string(CASE WHEN len(found) = 0 THEN [{_NONE}] WHEN len(found) > 5 THEN list_append(found[1:5], {quoted(m.MORE_ADVICE)}) ELSE found END, '|') AS advice FROM a""",
    "metrics_rollup": f"WITH {_BASE} SELECT lang, source, count(*) AS n_docs, sum(loc)::BIGINT AS loc, round(avg(maintainability), 6) AS avg_maintainability, grouping(lang, source)::BIGINT AS level FROM v GROUP BY ROLLUP (lang, source)",
    "project_stats": f"WITH {_BASE} SELECT count(*) AS files, sum(n_lines)::BIGINT AS n_lines, count(*) FILTER (loc > 0) AS with_code, (sum(n_lines) // count(*))::BIGINT AS avg_lines FROM c",
}
