"""Index, inheritance and verification queries, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import closure as c
from tessera.operators import index as ix
from tessera.operators import reach
from tessera.operators import verify as v
from tessera.plans._tables import CLOSURE_SQL, EDGES_SQL, ENTITIES_SQL, NAMES_SQL, edges, entities, read

TERMS = ("red", "BOLT", "nation_1", "zzz")
TERMS_SQL = "terms(term) AS (VALUES ('red'), ('BOLT'), ('nation_1'), ('zzz'))"
WRONG = ("rng", "wdget", "bluee", "red", "zzzzzz")


def _long(df, *cols):
    return df.withColumns({x: F.col(x).cast("long") for x in cols})


def index_counts_by_type(spark, sf):
    return entities(spark, sf).groupBy("entity_type", "entity_kind").agg(F.count(F.lit(1)).alias("n"))


def index_stats(spark, sf):
    e = entities(spark, sf).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("entity_type") == "Platform").alias("platform"), F.count_if(F.col("entity_type") == "Configuration").alias("configuration"))
    return e.join(edges(spark, sf).agg(F.count(F.lit(1)).alias("edges")))


def index_name_last_wins(spark, sf):
    return ix.last_of_name(entities(spark, sf))


def index_lookup_tiered(spark, sf):
    e = entities(spark, sf)
    wanted = e.select(F.col("display_name").alias("name")).union(read(spark, sf, "part").select("p_brand")).union(e.select("id")).union(read(spark, sf, "part").select(F.upper("p_name"))).distinct()
    return ix.lookup(wanted, ix.name_index(e)).select("name", "id", F.coalesce("tier", F.lit(-1)).cast("long").alias("tier"))


def index_suggest_top10(spark, sf):
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    return _long(ix.suggest(terms, ix.name_index(entities(spark, sf))), "rank")


def _part_members(spark, sf):
    p = read(spark, sf, "part").select(F.concat(F.lit("part."), F.col("p_partkey").cast("string")).alias("id"), "p_name")
    return ix.members(p, F.split("p_name", " "))


def index_members_inverted(spark, sf):
    return ix.member_index(_part_members(spark, sf))


def index_member_holders(spark, sf):
    """Every (member, id); index_members_inverted is the report of counts and first ids over it."""
    return _part_members(spark, sf)


def hierarchy_categories(spark, sf):
    e = entities(spark, sf)
    return ix.categories(e, F.col("entity_kind"), F.size(F.split("display_name", " ")).cast("long"), F.length("display_name").cast("long"))


def hierarchy_filter(spark, sf):
    e = entities(spark, sf).where(F.contains(F.lower("display_name"), F.lit("ring")))
    return ix.categories(e, F.col("entity_kind"), F.size(F.split("display_name", " ")).cast("long"), F.length("display_name").cast("long"))


def _lists(spark, sf):
    return {"part": read(spark, sf, "part").select(F.col("p_name").alias("label")), "nation": read(spark, sf, "nation").select(F.col("n_name").alias("label")), "customer": read(spark, sf, "customer").select(F.col("c_name").alias("label"))}


def completion_prefix(spark, sf):
    return ix.complete("R", _lists(spark, sf))


def completion_top50(spark, sf):
    return ix.complete("c", _lists(spark, sf), 50)


def closure_ancestors(spark, sf):
    return _long(c.closure(edges(spark, sf)), "depth")


def assignable_pairs(spark, sf):
    pairs = edges(spark, sf).select(F.col("child").alias("from_id")).distinct().join(F.broadcast(read(spark, sf, "region").select(F.concat(F.lit("region."), F.col("r_regionkey").cast("string")).alias("to_id"))))
    return c.assignable(pairs, edges(spark, sf), reach.build(edges(spark, sf)))


def _own(spark, sf):
    return edges(spark, sf).select(F.col("parent").alias("id"), F.concat(F.lit("m"), F.pmod(F.length("child"), F.lit(5)).cast("string")).alias("member")).distinct()


def effective_members(spark, sf):
    return _long(c.effective_members(_own(spark, sf), c.closure(edges(spark, sf))), "depth")


def _template_inherit(spark, sf, part):
    p = part.select(F.concat(F.lit("part."), F.col("p_partkey").cast("string")).alias("id"), F.col("p_type").alias("kind"), F.explode(F.split("p_name", " ")).alias("member")).distinct()
    templates = read(spark, sf, "part").groupBy(F.col("p_type").alias("kind")).agg(F.min("p_name").alias("name")).select("kind", F.explode(F.split("name", " ")).alias("member")).distinct()
    return c.with_template(p, templates)


def template_inherit(spark, sf):
    return _template_inherit(spark, sf, read(spark, sf, "part"))


def template_inherit_all(spark, sf):
    """The same rows under the name that they had while the other took a part of them."""
    return _template_inherit(spark, sf, read(spark, sf, "part"))


def depth_stats(spark, sf):
    reach = c.closure(edges(spark, sf))
    return _long(reach.groupBy("depth").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("ancestor").alias("ancestors")), "depth")


def missing_parent(spark, sf):
    known = read(spark, sf, "region").where("r_regionkey < 3").select(F.concat(F.lit("region."), F.col("r_regionkey").cast("string")).alias("id"))
    return c.missing_parents(edges(spark, sf).where("parent like 'region%'"), known)


def _words(spark, sf):
    return read(spark, sf, "part").select(F.col("p_type").alias("type"), F.explode(F.split("p_name", " ")).alias("member")).distinct()


def _wanted(spark, sf):
    kinds = read(spark, sf, "part").select(F.col("p_type").alias("type")).distinct()
    return kinds.select("type", F.explode(F.array(*map(F.lit, WRONG))).alias("member"))


def verify_member_exists(spark, sf):
    return v.existing(_wanted(spark, sf), _words(spark, sf))


def verify_member_missing(spark, sf):
    return v.missing(_wanted(spark, sf), _words(spark, sf))


def verify_similar(spark, sf):
    return _long(v.similar(_wanted(spark, sf).withColumnRenamed("member", "wanted"), _words(spark, sf)), "rank", "distance")


def verify_arity(spark, sf):
    calls = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_args")).join(read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    signatures = spark.createDataFrame([("O", 2, 4), ("F", 1, 3)], "name string, least int, most int")
    return v.arity(calls.select(F.col("l_orderkey").alias("call_id"), F.col("o_orderstatus").alias("name"), "n_args"), signatures)


def verify_first_mismatch(spark, sf):
    li = read(spark, sf, "lineitem")
    pos = F.col("l_linenumber").cast("long").alias("pos")
    args = li.select(F.col("l_orderkey").alias("call_id"), F.col("l_returnflag").alias("name"), pos, F.concat(F.lit("supplier."), F.col("l_suppkey").cast("string")).alias("type"))
    params = li.select(F.col("l_returnflag").alias("name"), pos).distinct().withColumn("type", F.concat(F.lit("region."), F.pmod(F.col("pos"), F.lit(5)).cast("string")))
    return v.first_mismatch(args, params, reach.build(edges(spark, sf)))


_CATEGORIES = """SELECT entity_kind AS category, count(*) AS n, sum(len(string_split(display_name, ' ')))::BIGINT AS methods, sum(length(display_name))::BIGINT AS properties,
  array_to_string(list(display_name ORDER BY display_name, id)[1:5], '|') AS names FROM entities {where} GROUP BY entity_kind"""
_LISTS = "lists AS (SELECT 'part' AS kind, p_name AS label FROM part UNION SELECT 'nation', n_name FROM nation UNION SELECT 'customer', c_name FROM customer)"
_WANTED = "wanted AS (SELECT DISTINCT p_type AS type, m AS member FROM part, (VALUES " + ", ".join(f"('{w}')" for w in WRONG) + ") w(m)), words AS (SELECT DISTINCT p_type AS type, unnest(string_split(p_name, ' ')) AS member FROM part)"
_OWN = "own AS (SELECT DISTINCT parent AS id, 'm' || (length(child) % 5) AS member FROM edges)"

QUERIES = {
    f.__name__: f
    for f in (index_counts_by_type, index_stats, index_name_last_wins, index_lookup_tiered, index_suggest_top10, index_members_inverted, index_member_holders, hierarchy_categories, hierarchy_filter, completion_prefix, completion_top50)
    + (closure_ancestors, assignable_pairs, effective_members, template_inherit, template_inherit_all, depth_stats, missing_parent, verify_member_exists, verify_member_missing, verify_similar, verify_arity, verify_first_mismatch)
}

ORACLE_SQL = {
    "index_counts_by_type": f"WITH {ENTITIES_SQL} SELECT entity_type, entity_kind, count(*) AS n FROM entities GROUP BY ALL",
    "index_stats": f"WITH {ENTITIES_SQL}, {EDGES_SQL} SELECT count(*) AS total, count(*) FILTER (entity_type = 'Platform') AS platform, count(*) FILTER (entity_type = 'Configuration') AS configuration, (SELECT count(*) FROM edges) AS edges FROM entities",
    "index_name_last_wins": f"WITH {ENTITIES_SQL} SELECT display_name, arg_max(id, load_ord) AS id, count(*) AS n FROM entities GROUP BY display_name",
    "index_lookup_tiered": f"""WITH {ENTITIES_SQL}, {NAMES_SQL}, q AS (SELECT display_name AS name FROM entities UNION SELECT p_brand FROM part UNION SELECT id FROM entities UNION SELECT upper(p_name) FROM part)
      SELECT q.name, arg_min(n.id, n.tier) AS id, coalesce(min(n.tier), -1)::BIGINT AS tier FROM q LEFT JOIN names n ON q.name = n.name GROUP BY q.name""",
    "index_suggest_top10": f"""WITH {ENTITIES_SQL}, {NAMES_SQL}, {TERMS_SQL}, h AS (SELECT DISTINCT term, name FROM names JOIN terms ON contains(lower(name), lower(term)))
      SELECT term, rank, name FROM (SELECT term, name, row_number() OVER (PARTITION BY term ORDER BY name) AS rank FROM h) WHERE rank <= 10""",
    "index_members_inverted": """WITH m AS (SELECT DISTINCT 'part.' || p_partkey AS id, unnest(string_split(p_name, ' ')) AS member FROM part)
      SELECT member, count(*) AS n, array_to_string(list(id ORDER BY id)[1:5], ',') AS ids FROM m GROUP BY member""",
    "index_member_holders": "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS member, 'part.' || p_partkey AS id FROM part",
    "hierarchy_categories": f"WITH {ENTITIES_SQL} " + _CATEGORIES.format(where=""),
    "hierarchy_filter": f"WITH {ENTITIES_SQL} " + _CATEGORIES.format(where="WHERE contains(lower(display_name), 'ring')"),
    "completion_prefix": f"WITH {_LISTS} SELECT kind, label FROM lists WHERE starts_with(lower(label), 'r')",
    "completion_top50": f"WITH {_LISTS} SELECT kind, label FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY label) AS r FROM lists WHERE starts_with(lower(label), 'c')) WHERE r <= 50",
    "closure_ancestors": f"WITH RECURSIVE {EDGES_SQL}, {CLOSURE_SQL} SELECT descendant, ancestor, depth::BIGINT AS depth FROM reach",
    "assignable_pairs": f"""WITH RECURSIVE {EDGES_SQL}, {CLOSURE_SQL}, p AS (SELECT DISTINCT child AS from_id, 'region.' || r_regionkey AS to_id FROM edges, region)
      SELECT from_id, to_id, CASE WHEN from_id = to_id THEN 'exact' WHEN depth = 1 THEN 'inheritance' WHEN depth > 1 THEN 'compatible' END AS reason FROM p LEFT JOIN reach ON descendant = from_id AND ancestor = to_id""",
    "effective_members": f"""WITH RECURSIVE {EDGES_SQL}, {CLOSURE_SQL}, {_OWN}, a AS (SELECT id, member, id AS owner, 0 AS depth FROM own UNION ALL SELECT descendant, member, ancestor, depth FROM reach JOIN own ON ancestor = id)
      SELECT id, member, owner, depth::BIGINT AS depth FROM (SELECT *, row_number() OVER (PARTITION BY id, member ORDER BY depth, owner) AS r FROM a) WHERE r = 1""",
    "template_inherit": """WITH p AS (SELECT DISTINCT 'part.' || p_partkey AS id, p_type AS kind, unnest(string_split(p_name, ' ')) AS member FROM part),
      t AS (SELECT DISTINCT kind, unnest(string_split(name, ' ')) AS member FROM (SELECT p_type AS kind, min(p_name) AS name FROM part GROUP BY p_type))
      SELECT id, member, false AS inherited FROM p UNION ALL SELECT DISTINCT p.id, t.member, true FROM p JOIN t ON p.kind = t.kind WHERE NOT EXISTS (SELECT 1 FROM p x WHERE x.id = p.id AND x.member = t.member)""",
    "template_inherit_all": """WITH p AS (SELECT DISTINCT 'part.' || p_partkey AS id, p_type AS kind, unnest(string_split(p_name, ' ')) AS member FROM part),
      t AS (SELECT DISTINCT kind, unnest(string_split(name, ' ')) AS member FROM (SELECT p_type AS kind, min(p_name) AS name FROM part GROUP BY p_type))
      SELECT id, member, false AS inherited FROM p UNION ALL SELECT DISTINCT p.id, t.member, true FROM p JOIN t ON p.kind = t.kind WHERE NOT EXISTS (SELECT 1 FROM p x WHERE x.id = p.id AND x.member = t.member)""",
    "depth_stats": f"WITH RECURSIVE {EDGES_SQL}, {CLOSURE_SQL} SELECT depth::BIGINT AS depth, count(*) AS pairs, count(DISTINCT ancestor) AS ancestors FROM reach GROUP BY depth",
    "missing_parent": f"WITH {EDGES_SQL} SELECT parent, child FROM edges WHERE parent LIKE 'region%' AND parent NOT IN (SELECT 'region.' || r_regionkey FROM region WHERE r_regionkey < 3)",
    "verify_member_exists": f"WITH {_WANTED} SELECT type, member FROM wanted w WHERE EXISTS (SELECT 1 FROM words x WHERE x.type = w.type AND x.member = w.member)",
    "verify_member_missing": f"WITH {_WANTED} SELECT type, member FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM words x WHERE x.type = w.type AND x.member = w.member)",
    "verify_similar": f"""WITH {_WANTED}, d AS (SELECT w.type, w.member AS wanted, x.member, levenshtein(w.member, x.member) AS distance FROM wanted w JOIN words x ON w.type = x.type),
      r AS (SELECT *, row_number() OVER (PARTITION BY type, wanted ORDER BY distance, member) AS rank FROM d WHERE distance <= 3) SELECT type, wanted, rank, member, distance FROM r WHERE rank <= 3""",
    "verify_arity": """WITH c AS (SELECT l_orderkey AS call_id, o_orderstatus AS name, count(*) AS n_args FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL), s(name, least, most) AS (VALUES ('O', 2, 4), ('F', 1, 3))
      SELECT call_id, c.name, n_args, CASE WHEN most IS NULL THEN 'unknown' WHEN n_args < least THEN 'too_few' WHEN n_args > most THEN 'too_many' END AS problem FROM c LEFT JOIN s ON c.name = s.name""",
    "verify_first_mismatch": f"""WITH RECURSIVE {EDGES_SQL}, {CLOSURE_SQL} SELECT l_orderkey AS call_id, min(l_linenumber)::BIGINT AS pos FROM lineitem
      WHERE NOT EXISTS (SELECT 1 FROM reach WHERE descendant = 'supplier.' || l_suppkey AND ancestor = 'region.' || (l_linenumber % 5)) GROUP BY l_orderkey""",
}
