"""From pages of documentation to entities: what a page describes, which object a member belongs to, and one record for each object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.names import first_name, second_name
from tessera.schemas import ENTITY
from tessera.sources import archives, docs, kinds

GLOBAL = "Global"
# How pages of simple types begin, the page of directives, and words of titles that tell what a page describes.
SIMPLE, DIRECTIVES = "def_", "Pragma"
FUNCTION, METHOD, PROPERTY = ("Функция", "function"), ("Метод", "method"), ("Свойство", "property")


def _told(title: Column, words: tuple[str, str]) -> Column:
    return F.contains(title, F.lit(words[0])) | F.contains(F.lower(title), F.lit(words[1]))


def kind_of_page(facts: DataFrame) -> DataFrame:
    """facts (title, category, path, ...) with `kind`: simple, function, method, property, object or null. A page without a title describes nothing."""
    t, name = F.col("title"), F.substring_index("path", "/", -1)
    kind = (
        F.when(t.isNull(), None)
        .when(F.startswith(name, F.lit(SIMPLE)), "simple")
        .when(_told(t, FUNCTION), "function")
        .when(_told(t, METHOD) | (F.col("category") == "method"), "method")
        .when(_told(t, PROPERTY) | (F.col("category") == "property"), "property")
        .when(F.col("category") == "object", "object")
    )
    return facts.withColumn("kind", kind)


def directives(pages: DataFrame) -> DataFrame:
    """(directive): directives of the page on them, in both languages, each once. pages: (path, html)."""
    found = F.regexp_extract_all("html", F.lit("(?is)<strong[^>]*>(.*?)</strong>"), F.lit(1))
    rows = pages.where(F.substring_index("path", "/", -1).isin(DIRECTIVES, f"{DIRECTIVES}.html")).select(F.explode(found).alias("x")).select(docs.text_of(F.col("x")).alias("x")).where(F.startswith("x", F.lit("&")))
    both = F.transform(F.split("x", "[(]"), lambda p: F.trim(F.replace(p, F.lit(")"), F.lit(""))))
    return rows.select(F.explode(both).alias("directive")).where(F.length("directive") > 1).distinct()


def owners(members: DataFrame, objects: DataFrame) -> DataFrame:
    """members (context, kind, ...) with `object`: the object (name) that is named as the context; of methods else the least whose name begins with it; Global for functions and where there is no context. Properties and methods of no object are left out."""
    known = objects.select("name").distinct()
    wanted = members.where("context is not null and kind != 'function'").select("context").distinct()
    exact = wanted.join(known.withColumnRenamed("name", "context"), "context", "left_semi").select("context", F.col("context").alias("of_name"))
    # every beginning of every name, so that a beginning is found by equality
    starts = known.select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("n")).select(F.expr("left(name, n)").alias("context"), "name")
    near = wanted.join(exact, "context", "left_anti").join(starts, "context").groupBy("context").agg(F.min("name").alias("of_start"))
    rows = members.join(exact, "context", "left").join(near, "context", "left")
    own = F.coalesce("of_name", F.when(F.col("kind") == "method", F.col("of_start")))
    free = (F.col("kind") == "function") | (F.col("context").isNull() & (F.col("kind") == "method"))
    return rows.withColumn("object", F.when(free, GLOBAL).otherwise(own)).where("object is not null").drop("of_name", "of_start")


def _pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts of pages with their kind, and their parameters. pages: (page_id, path, html)."""
    args = docs.parameters(docs.chapters(pages)).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("chapter_pos", "pos", "name", "type", "is_optional"))).alias("p"))
    args = args.select("page_id", F.transform("p", lambda p: F.struct(p["name"].alias("name"), p["type"].alias("type_name"), p["is_optional"].alias("is_optional"))).alias("parameters"))
    return kind_of_page(docs.page_facts(pages).join(pages.select("page_id", "path"), "page_id")), args


def entities(pages: DataFrame, version: str = "") -> DataFrame:
    """Entities (schemas.ENTITY) of documentation pages (page_id, path, html): objects and simple types with their members, and Global. Of several pages on one member the last by page_id counts."""
    facts, args = _pages(pages)
    title = F.col("title")
    own = F.coalesce(first_name(title), title)
    objects = facts.where("kind in ('object', 'simple')").select(F.when(F.col("kind") == "simple", F.replace(F.substring_index("path", "/", -1), F.lit(SIMPLE), F.lit(""))).otherwise(own).alias("name"), second_name(title).alias("english_name"), (F.col("kind") == "simple").alias("simple"), "description", "availability", "page_id")
    objects = objects.groupBy("name").agg(F.max_by(F.struct("english_name", "simple", "description", "availability"), "page_id").alias("o"))
    rows = facts.where("kind in ('function', 'method', 'property')").join(args, "page_id", "left")
    member = F.substring_index(own, ".", -1)
    rows = rows.select(F.col("object_context").alias("context"), "kind", member.alias("member"), second_name(title).alias("english"), "return_type", "description", "availability", "parameters", "page_id")
    rows = owners(rows, objects).groupBy("object", (F.col("kind") == "property").alias("is_property"), "member").agg(F.max_by(F.struct("kind", "english", "return_type", "description", "availability", "parameters"), "page_id").alias("m"))
    where = F.transform(kinds.contexts(F.coalesce("m.availability", F.array().cast("array<string>"))), lambda x: x)
    shared = {"name": F.col("member"), "english_name": F.col("m.english"), "documentation": F.col("m.description"), "availability": where}
    method = shared | {"parameters": F.col("m.parameters"), "return_type": F.col("m.return_type"), "is_function": F.col("m.return_type").isNotNull(), "is_export": F.lit(False), "is_deprecated": F.lit(False)}
    prop = shared | {"type_name": F.coalesce("m.return_type", F.lit("Unknown")), "is_readonly": F.lit(False), "is_indexed": F.lit(False)}
    record = lambda d: F.struct(*(c.alias(k) for k, c in d.items()))
    entry = lambda d, wanted: F.collect_list(F.when(F.col("is_property") == F.lit(wanted), F.struct(F.col("member").alias("key"), record(d).alias("value"))))
    lists = rows.groupBy("object").agg(F.map_from_entries(entry(method, False)).alias("methods"), F.map_from_entries(entry(prop, True)).alias("properties"))
    names = objects.select("name", "o").join(lists.withColumnRenamed("object", "name"), "name", "full")
    kind = F.when(F.col("name") == GLOBAL, "Global").when(F.col("o.simple"), "Primitive").otherwise(kinds.type_kind(F.col("name")))
    whole = names.select(
        F.col("name").alias("id"), F.col("name").alias("qualified_name"), F.col("name").alias("display_name"), F.col("o.english_name").alias("english_name"), F.lit("Platform").alias("entity_type"), kind.alias("entity_kind"),
        F.struct(F.lit("HBK").alias("tag"), F.lit(version).alias("version")).alias("source"), F.struct("methods", "properties").alias("interface"), F.col("o.description").alias("documentation"),
        kinds.contexts(F.coalesce("o.availability", F.array().cast("array<string>"))).alias("availability"),
    )
    return whole.select(F.from_json(F.to_json(F.struct("*")), ENTITY).alias("e")).select("e.*")


def extract(spark: SparkSession, path: str, version: str = "") -> DataFrame:
    """Entities of the archives at a path."""
    pages = archives.read_pages(spark, path)
    return entities(pages.select(F.concat_ws("!", "archive", "path").alias("page_id"), "path", "html"), version)
