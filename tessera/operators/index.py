"""The typed-entity index: names in tiers, lookup, suggestions, members, categories and completion.

An entity row has id, qualified_name, display_name, entity_type, entity_kind and load_ord. The index is
a set of derived DataFrames; a lookup joins a table of requests, so many are answered at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.names import first_name, is_cyrillic, second_name
from tessera.shared import stored

ALIAS, QUALIFIED, DISPLAY, FIRST_LANGUAGE, SECOND_LANGUAGE = range(5)
GRAM = 3  # characters of the longest stretches that names are posted under
_PARTS = 32


def name_index(entities: DataFrame, aliases: DataFrame | None = None, prefer_cyrillic: bool = True) -> DataFrame:
    """(name, tier, id): the last loaded entity of each name in each tier. aliases: (name, id)."""
    d = F.col("display_name")
    one, two = first_name(d), second_name(d)
    tier = lambda n: F.when(is_cyrillic(n) == F.lit(prefer_cyrillic), FIRST_LANGUAGE).otherwise(SECOND_LANGUAGE)
    names = F.array(
        F.struct(F.col("qualified_name").alias("name"), F.lit(QUALIFIED).alias("tier")),
        F.struct(d.alias("name"), F.lit(DISPLAY).alias("tier")),
        F.struct(one.alias("name"), tier(one).alias("tier")),
        F.struct(two.alias("name"), tier(two).alias("tier")),
    )
    rows = entities.select("id", "load_ord", F.inline(names)).where("name is not null")
    if aliases is not None:
        rows = rows.unionByName(aliases.select("id", F.lit(0).cast("long").alias("load_ord"), "name", F.lit(ALIAS).alias("tier")))
    return rows.groupBy("name", "tier").agg(F.max_by("id", F.struct("load_ord", "id")).alias("id"))


def lookup(requests: DataFrame, names: DataFrame) -> DataFrame:
    """(name, id, tier) of each request: the best tier that has the name, nulls if none has."""
    return requests.join(names, "name", "left").groupBy("name").agg(F.min_by("id", "tier").alias("id"), F.min("tier").alias("tier"))


def last_of_name(entities: DataFrame) -> DataFrame:
    """(display_name, id, n): who holds a display name after all are loaded, and how many had it."""
    return entities.groupBy("display_name").agg(F.max_by("id", F.struct("load_ord", "id")).alias("id"), F.count(F.lit(1)).alias("n"))


def _grams(text: Column, sizes: tuple[int, ...]) -> Column:
    """Distinct stretches of these sizes of a text."""
    of = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*(of(n) for n in sizes)))


def suggest(terms: DataFrame, names: DataFrame, limit: int = 10) -> DataFrame:
    """(term, rank, name): the first names in order that contain the term, whatever the case. Any number of terms; an empty one is in every name.

    Names are posted under their stretches of one to three characters, as far as some term asks for them. A term's
    candidates are the names under the rarest of its stretches; they are then tried. No term meets every name.
    """
    asked = terms.select("term").where("term is not null").distinct()
    low = F.lower("term")
    parts = [F.when(F.length(low) == n, F.array(low)) for n in range(1, GRAM)]
    wanted = stored(asked.where("term != ''").select("term", F.explode(F.coalesce(*parts, _grams(low, (GRAM,)))).alias("gram")), "wanted")
    known = names.select("name").where("name is not null").distinct()
    posted = known.select("name", F.explode(_grams(F.lower("name"), tuple(range(1, GRAM + 1)))).alias("gram")).join(wanted.select("gram").distinct(), "gram", "left_semi")
    posted = stored(posted, "postings")
    counts = posted.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = wanted.join(counts, "gram", "left").groupBy("term").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    hits = rarest.join(posted, "gram").where(F.contains(F.lower("name"), low)).select("term", "name")
    first = known.orderBy("name").limit(limit)
    hits = hits.unionByName(asked.where("term = ''").crossJoin(F.broadcast(first)))  # one term, `limit` names
    for keys in (("term", F.pmod(F.xxhash64("name"), F.lit(_PARTS))), ("term",)):  # the parts of a common term first
        hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("name"))).where(F.col("rank") <= limit)
    return hits.select("term", "rank", "name")


def members(entities: DataFrame, names: Column) -> DataFrame:
    """(member, id): the inverted index over an array of member names."""
    return entities.select(F.explode(F.array_distinct(names)).alias("member"), "id")


def member_index(rows: DataFrame, first: int = 5) -> DataFrame:
    """(member, n, ids): how many entities have a member, and the first of them in order."""
    w = Window.partitionBy("member").orderBy("id")
    top = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= first)
    lists = top.groupBy("member").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))
    return rows.groupBy("member").agg(F.count(F.lit(1)).alias("n")).join(lists, "member")


def categories(entities: DataFrame, category: Column, n_methods: Column, n_properties: Column, first: int = 5) -> DataFrame:
    """(category, n, methods, properties, names): counts of each category and its first names."""
    rows = entities.select(category.alias("category"), "display_name", "id", n_methods.alias("m"), n_properties.alias("p"))
    w = Window.partitionBy("category").orderBy("display_name", "id")
    top = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= first)
    names = top.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "display_name"))), lambda x: x["display_name"]), "|").alias("names"))
    sums = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("methods"), F.sum("p").alias("properties"))
    return sums.join(names, "category")


def complete(prefix: str, lists: dict[str, DataFrame], limit: int | None = None) -> DataFrame:
    """(kind, label): labels of every list that start with a prefix, whatever the case; up to `limit` of each kind."""
    out = None
    for kind, df in lists.items():
        rows = df.select(F.lit(kind).alias("kind"), "label").where(F.startswith(F.lower("label"), F.lit(prefix.lower()))).distinct()
        out = rows if out is None else out.unionByName(rows)
    if limit is None:
        return out
    w = Window.partitionBy("kind").orderBy("label")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).drop("rank")


def resolve_aliases(targets: dict[str, str], names: DataFrame) -> DataFrame:
    """(name, id) of each alias whose target is found: by qualified, display or alternative name, in that order, else by the first qualified name that holds it.

    targets: alias to target, a configuration's small table; names: what name_index gives.
    """
    spark = names.sparkSession
    rows = spark.createDataFrame(sorted(targets.items()), "alias string, target string")
    exact = F.broadcast(rows).join(names.where(F.col("tier") != ALIAS), F.col("target") == F.col("name")).groupBy("alias").agg(F.min_by("id", F.struct("tier", "id")).alias("id"))
    left = F.broadcast(rows.join(exact, "alias", "left_anti"))  # no more rows than targets
    held = names.where(F.col("tier") == QUALIFIED).join(left, F.contains("name", "target")).groupBy("alias").agg(F.min_by("id", "name").alias("id"))
    return exact.union(held).select(F.col("alias").alias("name"), "id")


def of_type(entities: DataFrame, entity_type: str | None = None, entity_kind: str | None = None) -> DataFrame:
    """Entities of a type, of a kind, or of both."""
    for col, value in (("entity_type", entity_type), ("entity_kind", entity_kind)):
        if value is not None:
            entities = entities.where(F.col(col) == value)
    return entities


def tree(entities: DataFrame, category: Column, place: Column) -> DataFrame:
    """(node_id, parent_id, label, n, place): the root, a node for each category in its place, and one for each entity."""
    rows = entities.select("id", "display_name", category.alias("category"), place.alias("place"))
    leaves = rows.select(F.col("id").alias("node_id"), F.concat(F.lit("category."), F.col("category")).alias("parent_id"), F.col("display_name").alias("label"), F.lit(0).cast("long").alias("n"), "place")
    nodes = rows.groupBy("category", "place").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("category."), F.col("category")).alias("node_id"), F.lit("root").alias("parent_id"), F.col("category").alias("label"), "n", "place")
    root = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit("root").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("root").alias("label"), "n", F.lit(0).alias("place"))
    return root.unionByName(nodes).unionByName(leaves)


def missing_types(entities: DataFrame, static: DataFrame) -> DataFrame:
    """Rows of static (english_name, ...) that no entity has the english_name of."""
    return static.join(entities.select("english_name").distinct(), "english_name", "left_anti")


def type_info(wanted: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, info): of each wanted id (id) its last parent and interface, its type and its kind, as a map without nulls. entities: (id, parents, implements, entity_type, entity_kind)."""
    last = lambda c: F.element_at(F.when(F.size(c) > 0, F.col(c)), -1)
    parts = {"parent": last("parents"), "implements": last("implements"), "entity_type": F.col("entity_type"), "entity_kind": F.col("entity_kind")}
    info = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, parts)), F.array(*parts.values())), lambda k, v: v.isNotNull())
    return entities.join(wanted.select("id").distinct(), "id", "left_semi").select("id", info.alias("info"))
