"""Documentation pages of a platform: facts read off their chapters, as columns.

A page is a row (page_id, path, html). Chapters begin at paragraphs of class V8SH_chapter; a chapter is
a row (page_id, pos, chapter, body), and what pages say about syntax, parameters, values, versions and
members is read off the body of the chapter that tells it. Nothing is parsed to a tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.kinds import mapped

# Classes of the pages' elements, and words that chapters are known by.
TITLE, CONTEXT, CHAPTER, RUBRIC, VERSION = "V8SH_pagetitle", "V8SH_title", "V8SH_chapter", "V8SH_rubric", "V8SH_versionInfo"
VARIANT, SYNTAX, PARAMETERS, RETURNS, DESCRIPTION = "Вариант синтаксиса:", "Синтаксис", "Параметры:", "Возвращаемое значение", "Описание"
AVAILABILITY, SINCE, EXAMPLE, METHODS, PROPERTIES = "Доступность", "Использование в версии", "Пример", "Методы", "Свойства:"
OPTIONAL = "(необязательный)"
# The word before a type, and link texts that are no type.
TYPE_WORD = "(?:Тип|Type):"
NO_TYPES = ("Описание", "Description", "Примечание", "Note")
_TYPE_NAME = "\\p{Lu}[\\p{L}\\p{N}_]*(?:[.]\\p{Lu}[\\p{L}\\p{N}_]*)*"
# Simple types by the end of their link.
LINK_TYPES = {"String": "Строка", "Number": "Число", "Boolean": "Булево", "Date": "Дата", "Undefined": "Неопределено", "Null": "Null", "Type": "Тип"}


def text_of(html: Column) -> Column:
    """The text of a stretch of HTML: tags out, entities resolved, blanks trimmed."""
    out = F.regexp_replace(html, "(?s)<[^>]*>", "")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return F.regexp_replace(out, "^\\s+|\\s+$", "")


def _element(html: Column, tag: str, css: str) -> Column:
    return F.nullif(text_of(F.regexp_extract(html, f'(?s)<{tag}[^>]*class="[^"]*{css}[^"]*"[^>]*>(.*?)</{tag}>', 1)), F.lit(""))


def title(html: Column) -> Column:
    return _element(html, "h1", TITLE)


def object_context(html: Column) -> Column:
    """The object a member belongs to, by its first name."""
    return F.substring_index(_element(html, "p", CONTEXT), " (", 1)


def english_name(name: Column) -> Column:
    """Of "A.b (C.d)" the C: what stands in the first parentheses, before a dot."""
    return F.nullif(F.substring_index(F.regexp_extract(name, " \\(([^)]*)\\)", 1), ".", 1), F.lit(""))


def category(path: Column) -> Column:
    has = lambda part: F.contains(path, F.lit(part))
    return F.when(has("/methods/"), "method").when(has("/properties/"), "property").when(has("objects/"), "object").when(has("tables/"), "table").otherwise("")


def chapters(pages: DataFrame) -> DataFrame:
    """(page_id, pos, chapter, variant, body): the chapters of each page; `variant` is the syntax variant that a chapter stands under."""
    parts = F.slice(F.split("html", f'(?i)<p[^>]*class="[^"]*{CHAPTER}[^"]*"[^>]*>'), 2, 1_000_000)
    rows = pages.select("page_id", F.posexplode(parts).alias("pos", "part"))
    name = text_of(F.regexp_extract("part", "(?s)^(.*?)</p>", 1))
    rows = rows.select("page_id", "pos", name.alias("chapter"), F.regexp_replace("part", "(?s)^.*?</p>", "").alias("body"))
    own = F.when(F.contains("chapter", F.lit(VARIANT)), F.trim(F.replace("chapter", F.lit(VARIANT), F.lit(""))))
    upto = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("variant", F.last(own, ignorenulls=True).over(upto)).select("page_id", "pos", "chapter", "variant", "body")


def syntax_variants(rows: DataFrame) -> DataFrame:
    """(page_id, variant, syntax): the first line of each chapter on syntax, with its variant if it has one."""
    first = F.regexp_extract(text_of(F.regexp_replace("body", "(?i)<br */?>", "\n")), "^([^\\n]*)", 1)
    got = rows.where(F.contains("chapter", F.lit(SYNTAX)) & ~F.contains("chapter", F.lit(VARIANT)))
    return got.select("page_id", "pos", "variant", first.alias("syntax"))


def type_of_link(href: Column) -> Column:
    """The type that a link leads to: a simple one by its ending, else the last part of a path to an object."""
    simple = mapped(F.regexp_extract(href, "def_([A-Za-z]+)", 1), LINK_TYPES)
    return F.coalesce(simple, F.nullif(F.regexp_extract(href, "objects/(?:[^\"]*/)?([^/\"]+?)(?:[.]html)?$", 1), F.lit("")))


def parameters(rows: DataFrame) -> DataFrame:
    """(page_id, variant, pos, name, type, is_optional, link): what each rubric under a chapter on parameters tells."""
    blocks = F.slice(F.split("body", f'(?i)<div[^>]*class="[^"]*{RUBRIC}[^"]*"[^>]*>'), 2, 1_000_000)
    rubrics = rows.where(F.contains("chapter", F.lit(PARAMETERS))).select("page_id", "variant", F.col("pos").alias("chapter_pos"), F.posexplode(blocks).alias("pos", "block"))
    head, rest = F.regexp_extract("block", "(?s)^(.*?)</div>", 1), F.regexp_replace("block", "(?s)^.*?</div>", "")
    link = F.nullif(F.regexp_extract(head, '<a[^>]*href="([^"]*)"', 1), F.lit(""))
    told = F.nullif(F.trim(F.regexp_extract(text_of(rest), "Тип:([^.]*)", 1)), F.lit(""))
    name = F.trim(F.regexp_extract(text_of(head), "<([^>]*)>", 1))
    return rubrics.select("page_id", "variant", "chapter_pos", "pos", name.alias("name"), F.coalesce(type_of_link(link), told).alias("type"), F.contains(text_of(head), F.lit(OPTIONAL)).alias("is_optional"), link.alias("link"))


def return_type(body: Column) -> Column:
    """The type of the returned value; null where nothing is returned.

    What follows the type word tells it: a link by its text, or else a dotted name. Without such a word it is the
    first link whose text is a name, unless that is one of NO_TYPES.
    """
    told = F.regexp_extract(body, f"(?s){TYPE_WORD}\\s*(.*)$", 1)
    linked = text_of(F.regexp_extract(told, "(?s)^<a\\b[^>]*>(.*?)</a>", 1))
    named = F.regexp_extract(text_of(told), f"^({_TYPE_NAME})", 1)
    links = F.transform(F.regexp_extract_all(body, F.lit("(?s)<a\\b[^>]*>(.*?)</a>"), F.lit(1)), text_of)
    other = F.get(F.filter(links, lambda x: F.regexp_like(x, F.lit(f"^{_TYPE_NAME}$"))), F.lit(0))
    return F.coalesce(F.nullif(linked, F.lit("")), F.nullif(named, F.lit("")), F.when(~other.isin(*NO_TYPES), other))


def availability(body: Column) -> Column:
    """Where a member may be called: the list before the first full stop."""
    listed = F.transform(F.split(F.regexp_extract(text_of(body), "^([^.]*)", 1), ","), lambda x: F.trim(x))
    return F.filter(listed, lambda x: x != "")


def version(body: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(_element(body, "p", VERSION), "(?s)версии(.*)$", 1)), F.lit(""))


def _members(body: Column, part: str) -> Column:
    """[(name, english_name)] of a list's items, else of the links into `part`."""
    items = F.transform(F.regexp_extract_all(body, F.lit("(?s)<li[^>]*>(.*?)</li>"), F.lit(1)), text_of)
    links = F.transform(F.regexp_extract_all(body, F.lit(f'(?s)<a[^>]*href="[^"]*{part}/[^"]*"[^>]*>(.*?)</a>'), F.lit(1)), text_of)
    names = F.filter(F.when(F.size(items) > 0, items).otherwise(F.array_distinct(links)), lambda x: x != "")
    both = lambda x: F.struct(F.trim(F.substring_index(x, "(", 1)).alias("name"), F.nullif(F.trim(F.regexp_extract(x, "\\(([^)]*)\\)", 1)), F.lit("")).alias("english_name"))
    return F.transform(names, both)


def links(html: Column) -> Column:
    """Targets of links inside the help, in order."""
    return F.regexp_extract_all(html, F.lit('href="(v8help://[^"]*)"'), F.lit(1))


def page_facts(pages: DataFrame) -> DataFrame:
    """One row for each page: names, category, and what its chapters tell; a page without chapters has nulls there."""
    rows = chapters(pages)
    b, c = F.col("body"), F.col("chapter")
    told = lambda word, value: F.min_by(F.when(F.contains(c, F.lit(word)), value), F.when(F.contains(c, F.lit(word)), F.col("pos")))
    facts = rows.groupBy("page_id").agg(
        told(DESCRIPTION, text_of(b)).alias("description"),
        told(RETURNS, return_type(b)).alias("return_type"),
        told(AVAILABILITY, availability(b)).alias("availability"),
        told(SINCE, version(b)).alias("version"),
        told(EXAMPLE, text_of(F.regexp_extract(b, "(?s)<table[^>]*>(.*?)</table>", 1))).alias("example"),
        told(METHODS, _members(b, "methods")).alias("methods"),
        told(PROPERTIES, _members(b, "properties")).alias("properties"),
    )
    h, t = F.col("html"), title(F.col("html"))
    heads = pages.select("page_id", t.alias("title"), english_name(t).alias("english_name"), object_context(h).alias("object_context"), category(F.col("path")).alias("category"), links(h).alias("links"))
    return heads.join(facts, "page_id", "left")


def entities(facts: DataFrame, params: DataFrame) -> DataFrame:
    """(object, member, kind, return_type, parameters): members with their objects, methods without one under Global."""
    args = params.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chapter_pos", "pos", "name", "type", "is_optional"))), lambda p: F.struct(p["name"].alias("name"), p["type"].alias("type_name"), p["is_optional"].alias("is_optional"))).alias("parameters"))
    member = F.substring_index(F.substring_index("title", " (", 1), ".", -1)
    rows = facts.where(F.col("category").isin("method", "property")).join(args, "page_id", "left")
    return rows.select(F.coalesce("object_context", F.lit("Global")).alias("object"), member.alias("member"), F.col("category").alias("kind"), "return_type", "availability", F.coalesce("parameters", F.array().cast("array<struct<name:string,type_name:string,is_optional:boolean>>")).alias("parameters"))


def statistics(facts: DataFrame) -> DataFrame:
    """Pages of each category, and how many tell a return type, a version, or members."""
    has = lambda col: F.count_if(F.col(col).isNotNull())
    return facts.groupBy("category").agg(F.count(F.lit(1)).alias("pages"), has("return_type").alias("returning"), has("version").alias("versioned"), F.count_if(F.size("methods") > 0).alias("with_methods"))
