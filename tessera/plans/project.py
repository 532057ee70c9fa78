"""Queries on modules, calls, documentation items and relinking over the driver's tables, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import call_check as cc
from tessera.operators import doc_index as di
from tessera.operators import incremental as inc
from tessera.operators import index as ix
from tessera.operators import project as pr
from tessera.operators import reach
from tessera.plans._tables import CLOSURE_SQL, DIAGNOSTICS_SQL, EDGES_SQL, diagnostics, edges, read
from tessera.sources import kinds


def _name(key, lead="m"):
    return F.concat(F.lit(lead), key.cast("string"))


def _modules(spark, sf):
    n = read(spark, sf, "nation")
    again = n.where("n_nationkey = 3")  # a name that is there twice
    return n.union(again).select(_name(F.col("n_nationkey")).alias("name"), _name(F.col("n_regionkey"), "t").alias("module_type"))


def _imports(spark, sf):
    n = read(spark, sf, "nation").select(F.col("n_nationkey").alias("n"))
    return n.select(_name(F.col("n")).alias("module"), F.explode(F.array(_name((F.col("n") * 3 + 1) % 25), _name(F.col("n") + 7))).alias("imported"))


def _exports(spark, sf):
    return read(spark, sf, "supplier").select(_name(F.col("s_nationkey")).alias("module"), _name(F.col("s_suppkey") % 7, "s").alias("name"))


def module_exports(spark, sf):
    got = pr.export_map(_exports(spark, sf))
    return got.select("name", "n", F.array_join("modules", ",").alias("modules"))


def module_dependents(spark, sf):
    wanted = read(spark, sf, "nation").where("n_regionkey = 1").select(_name(F.col("n_nationkey")).alias("imported"))
    return pr.dependents(_imports(spark, sf), wanted)


def module_problems(spark, sf):
    return pr.problems(_modules(spark, sf), _imports(spark, sf))


def _customer_imports(spark, sf):
    """Customers in runs of 50, each importing the next, and across the runs what orders that are pending say."""
    next_ = read(spark, sf, "customer").where("c_custkey % 50 != 0").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"))
    across = read(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") * 7 % 997 + 1).alias("b"))
    return next_.union(across).select(_name(F.col("a"), "c").alias("module"), _name(F.col("b"), "c").alias("imported"))


def import_cycles(spark, sf):
    return pr.circles(_customer_imports(spark, sf)).select("module", "other")


def reach_pairs(spark, sf):
    """Of customers and those that their number leads to, who imports whom, however far."""
    e = _customer_imports(spark, sf).select(F.col("module").alias("child"), F.col("imported").alias("parent"))
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    pairs = c.select(_name(F.col("k"), "c").alias("from_id"), F.explode(F.array(*(_name(x, "c") for x in (F.col("k"), F.col("k") + 3, F.col("k") * 13 % 997 + 1, F.col("k") * 31 % 997 + 1)))).alias("to_id")).distinct()
    return reach.reachable(pairs, reach.build(e))


def module_statistics(spark, sf):
    return pr.statistics(_modules(spark, sf), _exports(spark, sf), _imports(spark, sf))


def file_metrics(spark, sf):
    d = diagnostics(spark, sf)
    files = d.groupBy(F.col("file_path").alias("path")).agg(F.max("line").alias("lines"))
    routines = d.where("code = 'click'").select(F.col("file_path").alias("path"))
    return pr.file_metrics(files, routines, d)


def _calls(spark, sf):
    """Calls of words of part names on part types: unknown types, unknown words, counts and contexts among them."""
    li, p = read(spark, sf, "lineitem"), read(spark, sf, "part")
    rows = li.join(p, F.col("l_partkey") == F.col("p_partkey"))
    kind = F.when(F.col("l_suppkey") % 50 == 0, "NoType").otherwise(F.col("p_type"))
    word = F.element_at(F.split("p_name", " "), 2)
    member = F.when(F.col("l_suppkey") % 7 == 0, F.upper(word)).otherwise(word)
    id_ = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return rows.select(id_.alias("call_id"), kind.alias("type"), member.alias("member"), (F.col("l_linenumber") % 4).alias("n_args"), F.when(F.col("l_returnflag") == "A", "Client").otherwise("Server").alias("context"))


def _members(spark, sf):
    words = read(spark, sf, "part").select(F.col("p_type").alias("type"), F.explode(F.split("p_name", " ")).alias("member")).distinct()
    size = F.length("member")
    where = F.when(size % 4 == 0, F.array(F.lit("Client"))).when(size % 4 == 1, F.array(F.lit("Client"), F.lit("Server"))).otherwise(F.array().cast("array<string>"))
    return words.select("type", "member", (size % 3).alias("least"), (size % 3 + size % 2).alias("most"), where.alias("availability"), (size == 5).alias("is_deprecated"), F.when(F.col("member") == "green", "use blue").alias("deprecation"))


def calls_checked(spark, sf):
    types = read(spark, sf, "part").select(F.col("p_type").alias("type"))
    return cc.check(_calls(spark, sf), types, _members(spark, sf), F.col("context"))


def type_compatibility(spark, sf):
    e = edges(spark, sf)
    parents = e.select(F.col("child").alias("id"), F.col("parent").alias("name"))
    does = read(spark, sf, "supplier").select(_name(F.col("s_suppkey"), "supplier.").alias("id"), _name(F.col("s_suppkey") % 25, "nation.").alias("name"))
    s = read(spark, sf, "supplier").select(_name(F.col("s_suppkey"), "supplier.").alias("from_id"), F.col("s_suppkey").alias("k"))
    pairs = s.select("from_id", F.explode(F.array("from_id", _name(F.col("k") % 25, "nation."), _name((F.col("k") + 3) % 25, "nation."), _name(F.col("k") % 6, "region."))).alias("to_id")).distinct()
    got = cc.compatibility(pairs, parents, does, reach.build(e))
    known = e.select(F.col("child").alias("id")).union(e.select("parent"))
    return cc.compatibility_report(got, known, parents)


def _items(spark, sf):
    return read(spark, sf, "documents").select(F.col("source").alias("category"), F.col("doc_id").alias("item_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))


def chunk_bounds(spark, sf):
    """Documents of each source in chunks of 50 items and 50 KB at most."""
    return di.chunks(_items(spark, sf))


def chunk_bounds_whole(spark, sf):
    """All documents as one category, two of each id."""
    return di.chunks(_items(spark, sf).select(F.lit("all").alias("category"), F.floor(F.col("item_id") / 2).alias("item_id"), "bytes"))


def doc_categories(spark, sf):
    return di.category_index(di.chunked(_items(spark, sf)))


def doc_totals(spark, sf):
    return di.main_index(doc_categories(spark, sf))


def doc_top_objects(spark, sf):
    kind = F.when(F.col("event_type") == "click", "methods").when(F.col("event_type") == "view", "properties").when(F.col("event_type") == "purchase", "functions").otherwise("operators")
    return di.top_objects(di.object_stats(read(spark, sf, "events").select(_name(F.col("user_id"), "o").alias("object"), kind.alias("category"))))


def doc_search(spark, sf):
    methods = read(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("description"))
    return di.search_methods(methods, "RED").select("p_partkey", "name")


def line_look_ahead(spark, sf):
    """Of each line the size of the first long one among the next nine, none past an empty line."""
    lines = read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "body"))
    size = F.length("body")
    got = di.look_ahead(lines.withColumn("size", size), F.when(size > 300, size), F.col("body") == "")
    return got.where("ahead is not null").select("doc_id", F.col("line").cast("long").alias("line"), F.col("ahead").cast("long").alias("ahead"))


def edges_relinked(spark, sf):
    e = edges(spark, sf)
    changed = read(spark, sf, "supplier").where("s_acctbal < 0").select(_name(F.col("s_suppkey"), "supplier.").alias("id"))
    fresh = read(spark, sf, "supplier").select(_name(F.col("s_suppkey"), "supplier.").alias("child"), _name((F.col("s_nationkey") + 1) % 25, "nation.").alias("parent"))
    return inc.relinked(e, changed, fresh)


def edges_imported(spark, sf):
    known = read(spark, sf, "nation").where("n_regionkey < 3").select(_name(F.col("n_nationkey"), "nation.").alias("id"))
    some = read(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(_name(F.col("c_custkey"), "customer.").alias("id"))
    return inc.imported_edges(edges(spark, sf), known.union(some))


_KINDS = ("Primitive", "Map", "ValueTree", "Catalog", "Document", "ChartOfAccounts", "Task", "CommonModule", "Global", "System", "Form", "Webhook", "Report")


def kind_tree(spark, sf):
    """Parts under the categories of kinds dealt to them, as a tree."""
    p = read(spark, sf, "part")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("p_partkey") % len(_KINDS) + 1).cast("int"))
    cat = kinds.category(kind)
    got = ix.tree(p.select(_name(F.col("p_partkey"), "part.").alias("id"), F.col("p_name").alias("display_name"), "p_partkey"), cat, kinds.category_place(cat))
    return got.withColumn("place", F.col("place").cast("long"))


QUERIES = {
    f.__name__: f
    for f in (module_exports, module_dependents, module_problems, import_cycles, reach_pairs, module_statistics, file_metrics, calls_checked, type_compatibility)
    + (chunk_bounds, chunk_bounds_whole, doc_categories, doc_totals, doc_top_objects, doc_search, line_look_ahead, edges_relinked, edges_imported, kind_tree)
}

_MODULES = "modules AS (SELECT 'm' || n_nationkey AS name, 't' || n_regionkey AS module_type FROM nation UNION ALL SELECT 'm3', 't' || n_regionkey FROM nation WHERE n_nationkey = 3)"
_IMPORTS = "imports AS (SELECT 'm' || n_nationkey AS module, 'm' || ((n_nationkey * 3 + 1) % 25) AS imported FROM nation UNION ALL SELECT 'm' || n_nationkey, 'm' || (n_nationkey + 7) FROM nation)"
_EXPORTS = "exports AS (SELECT 'm' || s_nationkey AS module, 's' || (s_suppkey % 7) AS name FROM supplier)"
_CUSTOMER_IMPORTS = """e AS (SELECT 'c' || c_custkey AS a, 'c' || (c_custkey + 1) AS b FROM customer WHERE c_custkey % 50 <> 0
  UNION SELECT 'c' || o_custkey, 'c' || (o_orderkey * 7 % 997 + 1) FROM orders WHERE o_orderstatus = 'P')"""
_OVER = "r.k >= 50 OR r.held + d.b > 51200"
_CHUNKS = f"""d AS (SELECT source, doc_id, coalesce(octet_length(encode(text)), 0) AS b, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
  r AS (SELECT source, n, doc_id, b, 1::BIGINT AS chunk, 1 AS k, b AS held FROM d WHERE n = 1
    UNION ALL SELECT d.source, d.n, d.doc_id, d.b, CASE WHEN {_OVER} THEN chunk + 1 ELSE chunk END, CASE WHEN {_OVER} THEN 1 ELSE k + 1 END, CASE WHEN {_OVER} THEN d.b ELSE held + d.b END FROM r JOIN d ON d.source = r.source AND d.n = r.n + 1)"""
_CHUNKS_WHOLE = _CHUNKS.replace("SELECT source, doc_id, coalesce", "SELECT 'all' AS source, doc_id // 2 AS doc_id, coalesce").replace("PARTITION BY source ORDER BY doc_id", "ORDER BY doc_id // 2, coalesce(octet_length(encode(text)), 0)")
_CATEGORIES = "SELECT source AS category, count(*) AS items, max(chunk) AS files, sum(b)::BIGINT AS bytes, count(*) / max(chunk) AS items_per_file FROM r GROUP BY source"
ORACLE_SQL = {
    "module_exports": f"WITH {_EXPORTS}, x AS (SELECT DISTINCT name, module FROM exports) SELECT name, count(*) AS n, string_agg(module, ',' ORDER BY module) AS modules FROM x GROUP BY name",
    "module_dependents": f"WITH {_IMPORTS} SELECT DISTINCT imported, module FROM imports WHERE imported IN (SELECT 'm' || n_nationkey FROM nation WHERE n_regionkey = 1)",
    "module_problems": f"""WITH RECURSIVE {_MODULES}, {_IMPORTS}, r AS (SELECT module, imported FROM imports UNION SELECT r.module, i.imported FROM r JOIN imports i ON r.imported = i.module)
      SELECT DISTINCT 'missing' AS problem, module, imported AS other FROM imports WHERE imported NOT IN (SELECT name FROM modules)
      UNION ALL SELECT 'duplicate', name, NULL FROM modules GROUP BY name HAVING count(*) > 1
      UNION ALL SELECT 'circular', a.module, min(a.imported) FROM r a JOIN r b ON a.module = b.imported AND a.imported = b.module GROUP BY a.module""",
    "import_cycles": f"""WITH RECURSIVE {_CUSTOMER_IMPORTS}, r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
      SELECT x.a AS module, min(x.b) AS other FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a""",
    "reach_pairs": f"""WITH RECURSIVE {_CUSTOMER_IMPORTS}, r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
      p AS (SELECT DISTINCT 'c' || c_custkey AS a, 'c' || unnest([c_custkey, c_custkey + 3, c_custkey * 13 % 997 + 1, c_custkey * 31 % 997 + 1]) AS b FROM customer)
      SELECT p.a AS from_id, p.b AS to_id FROM p JOIN r ON p.a = r.a AND p.b = r.b""",
    "module_statistics": f"""WITH {_MODULES}, {_IMPORTS}, {_EXPORTS} SELECT module_type, count(*) AS modules, coalesce(sum(e), 0)::BIGINT AS exports, coalesce(sum(i), 0)::BIGINT AS imports FROM modules
      LEFT JOIN (SELECT module, count(*) AS e FROM exports GROUP BY module) x ON x.module = name LEFT JOIN (SELECT module, count(*) AS i FROM imports GROUP BY module) y ON y.module = name GROUP BY module_type""",
    "file_metrics": f"""WITH {DIAGNOSTICS_SQL} SELECT file_path AS path, max(line) AS lines, count(*) FILTER (code = 'click') AS routines, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warning') AS warnings,
      greatest(0, 100 - 5 * count(*) FILTER (level = 'error') - count(*) FILTER (level = 'warning')) AS score FROM diagnostics GROUP BY file_path""",
    "calls_checked": """WITH k AS (SELECT l_orderkey * 10 + l_linenumber AS call_id, CASE WHEN l_suppkey % 50 = 0 THEN 'NoType' ELSE p_type END AS type, CASE WHEN l_suppkey % 7 = 0 THEN upper(split_part(p_name, ' ', 2)) ELSE split_part(p_name, ' ', 2) END AS member,
        l_linenumber % 4 AS n, CASE WHEN l_returnflag = 'A' THEN 'Client' ELSE 'Server' END AS ctx FROM lineitem JOIN part ON l_partkey = p_partkey),
      w AS (SELECT DISTINCT p_type AS type, unnest(string_split(p_name, ' ')) AS member FROM part), m AS (SELECT *, length(member) % 3 AS least, length(member) % 3 + length(member) % 2 AS most FROM w), t AS (SELECT DISTINCT p_type AS type FROM part)
      SELECT call_id, k.type, k.member, CASE WHEN t.type IS NULL THEN 'Type ''' || k.type || ''' not found' WHEN m.member IS NULL THEN 'Method ''' || k.member || ''' not found for type ''' || k.type || ''''
        WHEN n < least THEN 'Method ''' || k.member || ''' takes at least ' || least || ' arguments' WHEN n > most THEN 'Method ''' || k.member || ''' takes at most ' || most || ' arguments'
        WHEN length(k.member) % 4 = 0 AND ctx = 'Server' THEN 'Method ''' || k.member || ''' is not available in Server context' END AS problem,
        CASE WHEN m.member IS NOT NULL AND length(k.member) = 5 THEN 'Method ''' || k.member || ''' is deprecated' || CASE WHEN k.member = 'green' THEN ': use blue' ELSE '' END END AS warning
      FROM k LEFT JOIN t ON k.type = t.type LEFT JOIN m ON k.type = m.type AND k.member = m.member""",
    "type_compatibility": f"""WITH RECURSIVE {EDGES_SQL}, {CLOSURE_SQL}, s AS (SELECT 'supplier.' || s_suppkey AS f, s_suppkey AS k FROM supplier),
      p AS (SELECT DISTINCT f, unnest([f, 'nation.' || (k % 25), 'nation.' || ((k + 3) % 25), 'region.' || (k % 6)]) AS t, k FROM s), ids AS (SELECT child AS id FROM edges UNION SELECT parent FROM edges),
      q AS (SELECT f, t, CASE WHEN f = t THEN 'exact_match' WHEN EXISTS (SELECT 1 FROM edges WHERE child = f AND parent = t) THEN 'inheritance' WHEN t = 'nation.' || (k % 25) THEN 'implements_interface'
        WHEN EXISTS (SELECT 1 FROM reach WHERE descendant = f AND ancestor = t) THEN 'compatible' ELSE 'incompatible_types' END AS reason FROM p)
      SELECT f AS from_id, t AS to_id, f IN (SELECT id FROM ids) AS from_found, t IN (SELECT id FROM ids) AS to_found, reason <> 'incompatible_types' AS compatible, reason, (SELECT string_agg(parent, ', ' ORDER BY parent) FROM edges WHERE child = f) AS parents FROM q""",
    "chunk_bounds": f"WITH RECURSIVE {_CHUNKS} SELECT source AS category, doc_id AS item_id, chunk FROM r",
    "chunk_bounds_whole": f"WITH RECURSIVE {_CHUNKS_WHOLE} SELECT source AS category, doc_id AS item_id, chunk FROM r",
    "doc_categories": f"WITH RECURSIVE {_CHUNKS} {_CATEGORIES}",
    "doc_totals": f"WITH RECURSIVE {_CHUNKS}, c AS ({_CATEGORIES}) SELECT sum(items)::BIGINT AS items, sum(files)::BIGINT AS files, sum(bytes)::BIGINT AS bytes, sum(items) / sum(files) AS items_per_file FROM c",
    "doc_top_objects": """SELECT 'o' || user_id AS object, count(*) FILTER (event_type = 'click') AS methods, count(*) FILTER (event_type = 'view') AS properties, count(*) FILTER (event_type = 'purchase') AS functions,
      count(*) FILTER (event_type NOT IN ('click', 'view', 'purchase')) AS operators FROM events GROUP BY user_id ORDER BY methods DESC, object LIMIT 10""",
    "doc_search": "SELECT p_partkey, p_name AS name FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_type), 'red')",
    "line_look_ahead": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents),
      w AS (SELECT doc_id, line, min(CASE WHEN length(body) > 300 THEN line END) OVER n AS f, min(CASE WHEN body = '' THEN line END) OVER n AS s FROM l WINDOW n AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 1 FOLLOWING AND 9 FOLLOWING))
      SELECT w.doc_id, w.line, length(l.body) AS ahead FROM w JOIN l ON l.doc_id = w.doc_id AND l.line = f WHERE s IS NULL OR f < s""",
    "edges_relinked": f"""WITH {EDGES_SQL}, g AS (SELECT 'supplier.' || s_suppkey AS id, 'nation.' || ((s_nationkey + 1) % 25) AS up FROM supplier WHERE s_acctbal < 0)
      SELECT child, parent FROM edges WHERE child NOT IN (SELECT id FROM g) UNION SELECT id, up FROM g""",
    "edges_imported": f"""WITH {EDGES_SQL}, k AS (SELECT 'nation.' || n_nationkey AS id FROM nation WHERE n_regionkey < 3 UNION SELECT 'customer.' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
      SELECT child, parent FROM edges WHERE child IN (SELECT id FROM k) AND parent IN (SELECT id FROM k)""",
    "kind_tree": """WITH v(i, category, place) AS (VALUES (0, 'PrimitiveTypes', 1), (1, 'Collections', 2), (2, 'TabularData', 3), (3, 'Catalogs', 10), (4, 'Documents', 11), (5, 'ChartsOfAccounts', 999), (6, 'Tasks', 999),
        (7, 'CommonModules', 30), (8, 'GlobalContext', 4), (9, 'SystemTypes', 90), (10, 'Forms', 50), (11, 'Other', 99), (12, 'Reports', 40)), p AS (SELECT 'part.' || p_partkey AS id, p_name, category, place FROM part JOIN v ON p_partkey % 13 = i)
      SELECT id AS node_id, 'category.' || category AS parent_id, p_name AS label, 0::BIGINT AS n, place::BIGINT AS place FROM p
      UNION ALL SELECT 'category.' || category, 'root', category, count(*), place FROM p GROUP BY category, place UNION ALL SELECT 'root', NULL, 'root', count(*), 0 FROM p""",
}
