"""Queries on calls and types that are read from texts, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import call_check as cc
from tessera.operators import trees
from tessera.plans._tables import read
from tessera.sources import reports, tokens


def _modules(spark, sf) -> DataFrame:
    """Documents as code: a sentence is a call of its first word in a statement, and `the word` a call within it."""
    text = F.regexp_replace("text", "(^| )the ([a-z]+)", "$1the($2)")
    return read(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.regexp_replace(text, "([A-Z][a-z]+) ([^.]*)\\.", "$1($2);").alias("text"))


def _calls(modules: DataFrame) -> DataFrame:
    got = tokens.with_arguments(modules, tokens.calls(modules))
    return got.select("path", "pos", "object", "member", "kind", F.col("n_args").cast("long").alias("n_args"), F.array_join("arguments", "|").alias("arguments"))


def module_calls(spark, sf):
    return _calls(_modules(spark, sf))


def page_calls(spark, sf):
    """Calls in the pages' scripts and whatever else has brackets, outside strings."""
    return _calls(read(spark, sf, "pages").select(F.col("page_id").alias("path"), F.col("html").alias("text")))


def call_shapes(spark, sf):
    """How many calls of each kind have how many arguments."""
    return tokens.calls(_modules(spark, sf)).groupBy("kind", F.col("n_args").cast("long").alias("n_args")).agg(F.count(F.lit(1)).alias("calls"))


def _words(spark, sf) -> DataFrame:
    return read(spark, sf, "part").select(F.element_at(F.split("p_name", " "), 1).alias("a"), F.element_at(F.split("p_name", " "), 2).alias("b"))


def _assignments(spark, sf) -> DataFrame:
    """Sentences of documents as assignments: the last word names the variable, the first decides what it gets."""
    s = read(spark, sf, "documents").select(F.col("doc_id").alias("scope"), F.posexplode(F.split("text", "\\.")).alias("pos", "s"))
    w = F.regexp_extract_all("s", F.lit("[A-Za-z]+"), F.lit(0))
    s = s.withColumn("w", w).where(F.size("w") >= 3)
    short = lambda i, n: F.lower(F.left(F.element_at("w", i), F.lit(n)))
    kind = F.length(F.element_at("w", 1)) % 5
    value = F.when(kind == 0, "7").when(kind == 1, F.concat(F.lit("New "), F.upper(short(2, 1)))).when(kind == 3, F.concat(short(2, 2), F.lit("."), short(3, 1), F.lit("()"))).otherwise(short(2, 2))
    return s.select("scope", short(-1, 2).alias("name"), F.col("pos").cast("long").alias("pos"), value.alias("value"))


def variable_types(spark, sf):
    members = _words(spark, sf).select(F.upper(F.left("a", F.lit(1))).alias("type"), F.left("b", F.lit(1)).alias("member"), F.upper(F.substring("b", 2, 1)).alias("returns"))
    names = _words(spark, sf).groupBy(F.left("b", F.lit(2)).alias("name")).agg(F.max(F.upper(F.left("a", F.lit(1)))).alias("id")).withColumn("tier", F.lit(0))
    return cc.assigned_types(_assignments(spark, sf), names, members)


def _text_tree(docs: DataFrame) -> DataFrame:
    """(doc_id, lines: structs of i and line) as trees of lines and their sentences."""
    line = docs.select("doc_id", F.inline("lines")).withColumn("up", (F.col("i") + 1) * 100_000)
    root = docs.select("doc_id", F.lit(0).cast("long").alias("node_id"), F.lit(None).cast("long").alias("parent_id"), F.lit(0).cast("long").alias("ordinal"), F.lit("doc").alias("kind"), F.lit(None).cast("string").alias("payload"))
    rows = line.select("doc_id", "up", F.lit(0).cast("long"), "i", F.lit("line"), F.lit(None).cast("string"))
    leaves = line.select("doc_id", "up", F.posexplode(F.split("line", "[.]")).alias("j", "s")).select("doc_id", F.col("up") + F.col("j") + 1, "up", F.col("j").cast("long"), F.lit("sentence"), "s")
    return root.union(rows).union(leaves).withColumns({"start": F.lit(0), "len": F.lit(0)})


def tree_diff(spark, sf):
    """Documents as trees before and after an edit of words, which also takes lines out."""
    docs = read(spark, sf, "documents").where("text is not null").select("doc_id", F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.cast("long").alias("i"), x.alias("line"))).alias("lines"))
    edited = F.transform(F.filter("lines", lambda x: F.length(x["line"]) % 5 != 0), lambda x: F.struct(x["i"].alias("i"), F.replace(x["line"], F.lit("that"), F.lit("this")).alias("line")))
    old, new = (trees.digests(_text_tree(d), spans=False) for d in (docs, docs.withColumn("lines", edited)))
    return trees.diff(old, new)


def _part(x, n):
    return F.split_part(x, F.lit(" "), F.lit(n))


def _report_text(x, i):
    """A line of a document as a line of a report, by its place."""
    folder = F.concat(F.lit("- Справочники."), _part(x, 1))
    return (
        F.when(i % 6 == 0, folder)
        .when(i % 6 == 1, F.concat(folder, F.lit(".Реквизиты."), _part(x, 2)))
        .when(i % 6 == 2, F.concat(_part(x, 1), F.lit(': "'), _part(x, 2), F.lit('"')))
        .when(i % 6 == 3, F.concat(F.lit("Тип: "), _part(x, 3)))
        .when(i % 6 == 4, F.concat(F.lit("- "), _part(x, 1), F.lit("."), _part(x, 2)))
        .otherwise(x)
    )


def report_objects(spark, sf):
    """Documents as configuration reports: their objects with attributes and properties."""
    text = F.array_join(F.transform(F.split("text", "\n"), _report_text), "\n")
    got = reports.objects(read(spark, sf, "documents").select(F.col("doc_id").alias("path"), text.alias("text")))
    attributes = F.array_join(F.transform("attributes", lambda a: F.concat_ws("/", a["line"].cast("string"), a["name"], a["type"])), "|")
    keys = F.array_sort(F.map_keys("properties"))
    properties = F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit("="), F.try_element_at("properties", k))), "|")
    return got.select("path", F.col("line").cast("long").alias("line"), "name", "type", attributes.alias("attributes"), properties.alias("properties"))


def routine_bodies(spark, sf):
    """Lines of documents as headers, bodies and ends of routines."""
    plain = F.translate("text", "\"'", "  ")
    line = lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("Процедура p"), F.regexp_extract(x, "[A-Za-z]+", 0), F.lit("(a)"), F.when(F.length(x) % 2 == 0, " Экспорт").otherwise(""))).when(i % 3 == 1, x).otherwise(F.lit("КонецПроцедуры"))
    text = F.array_join(F.transform(F.split(plain, "\n"), line), "\n")
    got = tokens.bodies(read(spark, sf, "documents").select(F.col("doc_id").alias("path"), text.alias("text")))
    return got.select("path", "pos", "kind", "name", "is_export", "is_closed", F.sha2("body", 256).alias("body_sha256"))


QUERIES = {f.__name__: f for f in (module_calls, page_calls, call_shapes, variable_types, tree_diff, report_objects, routine_bodies)}

_NAME = "[\\w\\x{0400}-\\x{04FF}]+"
_PATH = f"\\.?{_NAME}(?:[ \\t]*\\.[ \\t]*{_NAME})*"
_TOKEN = f"\"[^\"]*(?:\"\"[^\"]*)*\"?|//[^\\n]*|''[^''\\n]*''?|{_PATH}|\\s+|[^\\s]"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
# The words are written out, so that a wrong list in the operator shows.
_HEADERS = "'процедура', 'функция', 'procedure', 'function'"
_NEVER = """'если', 'иначеесли', 'пока', 'для', 'каждого', 'из', 'по', 'возврат', 'и', 'или', 'не', 'тогда', 'цикл', 'перем', 'новый',
  'if', 'elsif', 'while', 'for', 'each', 'in', 'to', 'return', 'and', 'or', 'not', 'then', 'do', 'var', 'new'"""


def _calls_sql(modules: str) -> str:
    """Each bracket is matched with the first closing one that brings the depth back; commas between them at their depth part the arguments."""
    return f"""WITH m AS ({modules}), t AS (SELECT path, code, unnest(regexp_extract_all(code, '{_TOKEN}')) AS tok, unnest(range(len(regexp_extract_all(code, '{_TOKEN}')))) AS k FROM m),
      o AS (SELECT path, code, tok, k, coalesce(sum(length(tok)) OVER (PARTITION BY path ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at FROM t),
      s AS (SELECT *, lag(tok) OVER w AS head, lag(tok, 2) OVER w AS word, lead(tok) OVER w AS first, count(*) FILTER (tok = ';') OVER w - (tok = ';')::INT AS stm FROM o
        WHERE trim(tok, {_BLANK}) <> '' AND NOT starts_with(tok, '//') WINDOW w AS (PARTITION BY path ORDER BY k)),
      d AS (SELECT *, count(*) FILTER (tok = '(') OVER p - count(*) FILTER (tok = ')') OVER p AS dep FROM s WINDOW p AS (PARTITION BY path, stm ORDER BY k)),
      c AS (SELECT a.path, a.code, a.stm, a.dep, a.k, a.at AS pos, a.word, a.first, regexp_replace(a.head, '[ \\t]', '', 'g') AS name, min(b.k) AS ck, min(b.at) AS close
        FROM d a JOIN d b ON a.path = b.path AND a.stm = b.stm AND a.tok = '(' AND b.tok = ')' AND b.k > a.k AND b.dep = a.dep - 1 WHERE regexp_full_match(a.head, '{_PATH}') AND NOT regexp_matches(a.head, '^\\.?[0-9]') GROUP BY ALL),
      f AS (SELECT *, CASE WHEN lower(word) IN ('новый', 'new') THEN 'new' WHEN contains(name, '.') THEN 'method' ELSE 'function' END AS kind FROM c WHERE lower(coalesce(word, '')) NOT IN ({_HEADERS}) AND lower(name) NOT IN ({_NEVER})),
      p AS (SELECT path, k, close AS upto FROM f WHERE first <> ')' UNION ALL SELECT f.path, f.k, d.at FROM f JOIN d ON d.path = f.path AND d.stm = f.stm AND d.tok = ',' AND d.dep = f.dep AND d.k > f.k AND d.k < f.ck),
      q AS (SELECT p.path, p.k, upto, coalesce(lag(upto) OVER (PARTITION BY p.path, p.k ORDER BY upto), f.pos) AS since, f.code FROM p JOIN f ON p.path = f.path AND p.k = f.k),
      g AS (SELECT path, k, count(*) AS n, string_agg(trim(substr(code, since + 2, upto - since - 1), ' ' || chr(9) || chr(10) || chr(13)), '|' ORDER BY upto) AS arguments FROM q GROUP BY path, k)
      SELECT f.path, pos, CASE WHEN kind = 'method' THEN nullif(regexp_replace(name, '\\.?[^.]*$', ''), '') END AS object, CASE WHEN kind = 'new' THEN name ELSE regexp_extract(name, '[^.]*$') END AS member, kind,
        coalesce(n, 0) AS n_args, coalesce(arguments, '') AS arguments FROM f LEFT JOIN g ON f.path = g.path AND f.k = g.k"""


_MODULES = """SELECT doc_id AS path, regexp_replace(regexp_replace(text, '(^| )the ([a-z]+)', '\\1the(\\2)', 'g'), '([A-Z][a-z]+) ([^.]*)\\.', '\\1(\\2);', 'g') AS code FROM documents"""
ORACLE_SQL = {
    "report_objects": """WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), a AS (SELECT doc_id, unnest(ls) AS x, unnest(range(len(ls))) AS i FROM s),
      b AS (SELECT doc_id, i, trim(CASE i % 6 WHEN 0 THEN '- Справочники.' || split_part(x, ' ', 1) WHEN 1 THEN '- Справочники.' || split_part(x, ' ', 1) || '.Реквизиты.' || split_part(x, ' ', 2)
        WHEN 2 THEN split_part(x, ' ', 1) || ': "' || split_part(x, ' ', 2) || '"' WHEN 3 THEN 'Тип: ' || split_part(x, ' ', 3) WHEN 4 THEN '- ' || split_part(x, ' ', 1) || '.' || split_part(x, ' ', 2) ELSE x END, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS body FROM a),
      c AS (SELECT *, CASE WHEN starts_with(body, '-') AND contains(body, '.') THEN trim(ltrim(body, '-'), ' ') END AS name FROM b),
      d AS (SELECT *, name IS NOT NULL AND NOT contains(name, '.Реквизиты.') AND NOT contains(name, '.ТабличныеЧасти.') AND contains(name, 'Справочники.') AS opens, contains(name, '.Реквизиты.') AND len(string_split(name, '.')) >= 4 AS attribute FROM c),
      e AS (SELECT *, max(CASE WHEN opens THEN i END) OVER (PARTITION BY doc_id ORDER BY i) AS own, min(CASE WHEN starts_with(body, 'Тип:') THEN i END) OVER n AS tip, min(CASE WHEN starts_with(body, '-') THEN i END) OVER n AS dash
        FROM d WINDOW n AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 9 FOLLOWING)),
      t AS (SELECT e.doc_id, own, e.i, split_part(e.name, '.', 4) AS name, CASE WHEN tip IS NOT NULL AND (dash IS NULL OR tip < dash) THEN trim(substr(k.body, 5), ' ') ELSE 'Неизвестный' END AS type FROM e LEFT JOIN b k ON k.doc_id = e.doc_id AND k.i = tip WHERE attribute AND own IS NOT NULL),
      g AS (SELECT doc_id, own, string_agg((i + 1) || '/' || name || '/' || type, '|' ORDER BY i) AS attributes FROM t GROUP BY ALL),
      p AS (SELECT doc_id, own, i, trim(split_part(body, ':', 1), ' ') AS k, trim(trim(substr(body, instr(body, ':') + 1), ' '), '"') AS v FROM e WHERE own IS NOT NULL AND NOT starts_with(body, '-') AND contains(body, ':')),
      q AS (SELECT doc_id, own, k, arg_max(v, i) AS v FROM p WHERE v <> '' AND k <> 'Тип' GROUP BY ALL), r AS (SELECT doc_id, own, string_agg(k || '=' || v, '|' ORDER BY k) AS properties FROM q GROUP BY ALL)
      SELECT e.doc_id AS path, e.i + 1 AS line, name, 'Справочник' AS type, coalesce(attributes, '') AS attributes, coalesce(properties, '') AS properties FROM e LEFT JOIN g ON g.doc_id = e.doc_id AND g.own = e.i LEFT JOIN r ON r.doc_id = e.doc_id AND r.own = e.i WHERE opens""",
    "routine_bodies": """WITH s AS (SELECT doc_id, string_split(translate(text, chr(34) || chr(39), '  '), chr(10)) AS ls FROM documents), a AS (SELECT doc_id, unnest(ls) AS x, unnest(range(len(ls))) AS i FROM s),
      h AS (SELECT *, 'p' || regexp_extract(x, '[A-Za-z]+') AS name, length(x) % 2 = 0 AS is_export FROM a),
      l AS (SELECT *, CASE i % 3 WHEN 0 THEN length('Процедура ' || name || '(a)') + CASE WHEN is_export THEN 8 ELSE 0 END WHEN 1 THEN length(x) ELSE length('КонецПроцедуры') END AS n FROM h),
      o AS (SELECT *, coalesce(sum(n + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at, lead(x) OVER (PARTITION BY doc_id ORDER BY i) AS body, max(i) OVER (PARTITION BY doc_id) AS last FROM l)
      SELECT doc_id AS path, o.at + 10 AS pos, 'procedure' AS kind, name, is_export, last >= i + 2 AS is_closed, sha256(trim(coalesce(body, ''), ' ' || chr(9) || chr(10) || chr(13))) AS body_sha256 FROM o WHERE i % 3 = 0""",
    "tree_diff": """WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM a),
      k AS (SELECT doc_id, i, replace(line, 'that', 'this') AS line FROM l WHERE length(line) % 5 <> 0), o AS (SELECT doc_id, list(line ORDER BY i) AS was FROM l GROUP BY doc_id), n AS (SELECT doc_id, list(line ORDER BY i) AS now FROM k GROUP BY doc_id),
      d AS (SELECT a.doc_id, coalesce(was = now, false) AS whole FROM a JOIN o ON a.doc_id = o.doc_id LEFT JOIN n ON a.doc_id = n.doc_id),
      x AS (SELECT l.*, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS nth FROM l), y AS (SELECT k.*, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS nth FROM k),
      h AS (SELECT y.doc_id, y.i AS i, x.i AS was, len(string_split(y.line, '.')) AS inner_n FROM y JOIN x ON x.doc_id = y.doc_id AND x.line = y.line AND x.nth = y.nth JOIN d ON d.doc_id = y.doc_id AND NOT whole),
      u AS (SELECT doc_id, i, unnest(string_split(line, '.')) AS s, unnest(range(len(string_split(line, '.')))) AS j FROM l WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = l.doc_id AND h.was = l.i)),
      v AS (SELECT doc_id, i, unnest(string_split(line, '.')) AS s, unnest(range(len(string_split(line, '.')))) AS j FROM k WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = k.doc_id AND h.i = k.i)),
      c AS (SELECT doc_id, s, count(*) AS n FROM u GROUP BY ALL), e AS (SELECT doc_id, s, count(*) AS n FROM v GROUP BY ALL), f AS (SELECT c.doc_id, sum(least(c.n, e.n))::BIGINT AS n FROM c JOIN e ON c.doc_id = e.doc_id AND c.s = e.s GROUP BY c.doc_id),
      g AS (SELECT doc_id, count(*) AS n, sum(1 + inner_n)::BIGINT AS w FROM h GROUP BY doc_id), t AS (SELECT doc_id, sum(1 + len(string_split(line, '.')))::BIGINT AS n FROM k GROUP BY doc_id)
      SELECT d.doc_id, 1 + coalesce(t.n, 0) AS nodes, CASE WHEN whole THEN 0 ELSE 1 + coalesce(t.n, 0) - coalesce(g.w, 0) - coalesce(f.n, 0) END AS changed, CASE WHEN whole THEN 1 + coalesce(t.n, 0) ELSE coalesce(g.w, 0) + coalesce(f.n, 0) END AS reused,
        CASE WHEN whole THEN 1 ELSE coalesce(g.n, 0) + coalesce(f.n, 0) END AS reused_subtrees FROM d LEFT JOIN t ON d.doc_id = t.doc_id LEFT JOIN g ON d.doc_id = g.doc_id LEFT JOIN f ON d.doc_id = f.doc_id""",
    "module_calls": _calls_sql(_MODULES),
    "page_calls": _calls_sql("SELECT page_id AS path, html AS code FROM pages"),
    "call_shapes": f"SELECT kind, n_args, count(*) AS calls FROM ({_calls_sql(_MODULES)}) GROUP BY kind, n_args",
    "variable_types": """WITH RECURSIVE a AS (SELECT doc_id AS scope, string_split(text, '.') AS ss FROM documents), b AS (SELECT scope, unnest(ss) AS s, unnest(range(len(ss))) AS pos FROM a),
      w AS (SELECT scope, pos, regexp_extract_all(s, '[A-Za-z]+') AS w FROM b), e AS (SELECT scope, pos, row_number() OVER (PARTITION BY scope ORDER BY pos) AS i, lower(left(w[-1], 2)) AS name, length(w[1]) % 5 AS kind,
        lower(left(w[2], 2)) AS head, upper(left(w[2], 1)) AS made, lower(left(w[3], 1)) AS member FROM w WHERE len(w) >= 3),
      x AS (SELECT split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part), n AS (SELECT left(b, 2) AS name, max(upper(left(a, 1))) AS id FROM x GROUP BY ALL),
      m AS (SELECT map(list(k), list(v)) AS m FROM (SELECT upper(left(a, 1)) || '.' || left(b, 1) AS k, max(upper(substr(b, 2, 1))) AS v FROM x GROUP BY ALL)), d AS (SELECT map(list(name), list(id)) AS d FROM n),
      r AS (SELECT scope, 0::BIGINT AS i, NULL::BIGINT AS pos, NULL::VARCHAR AS name, NULL::VARCHAR AS type, MAP {}::MAP(VARCHAR, VARCHAR) AS held FROM a
        UNION ALL SELECT scope, i, pos, name, type, CASE WHEN type IS NULL THEN held ELSE map_concat(held, map([name], [type])) END FROM (
          SELECT scope, i, pos, name, held, CASE kind WHEN 0 THEN 'Число' WHEN 1 THEN made WHEN 3 THEN map_extract(m, h || '.' || member)[1] ELSE h END AS type FROM (
            SELECT e.*, held, m, coalesce(map_extract(held, head)[1], map_extract(d, head)[1]) AS h FROM r JOIN e ON r.scope = e.scope AND e.i = r.i + 1, m, d)))
      SELECT scope, name, pos, type FROM r WHERE type IS NOT NULL""",
}
