"""Page queries over `pages`, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.plans._tables import read
from tessera.sources import pages as pg


def page_title(spark, sf):
    return read(spark, sf, "pages").select("page_id", pg.title(F.col("html")).alias("title"))


def page_links(spark, sf):
    return pg.links(read(spark, sf, "pages")).withColumn("pos", F.col("pos").cast("long"))


def page_category(spark, sf):
    u = F.col("url")
    return read(spark, sf, "pages").select("page_id", pg.category(u).alias("category"), pg.host(u).alias("host"), pg.directory(u).alias("dir"))


def page_object_name(spark, sf):
    return read(spark, sf, "pages").select("page_id", pg.object_name(F.col("html")).alias("object"))


def archive_structure(spark, sf):
    return pg.archive_structure(read(spark, sf, "pages"))


def archive_largest(spark, sf):
    return pg.largest(read(spark, sf, "pages"))


def item_index(spark, sf):
    return pg.item_index(read(spark, sf, "pages"))


def page_sections(spark, sf):
    return pg.sections(read(spark, sf, "pages")).select("page_id", "title", F.array_join("headings", "|").alias("headings"), F.size("links").cast("long").alias("n_links"))


def chunk_assign(spark, sf):
    """Documents of each category in chunks of 50, by id."""
    w = Window.partitionBy("source").orderBy("doc_id")
    d = read(spark, sf, "documents").select("doc_id", "source", F.row_number().over(w).alias("n"))
    return d.select("doc_id", "source", F.ceil(F.col("n") / 50).cast("long").alias("chunk"))


def chunk_statistics(spark, sf):
    return chunk_assign(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("items"), F.max("chunk").alias("files"))


QUERIES = {f.__name__: f for f in (page_title, page_links, page_category, page_object_name, archive_structure, archive_largest, item_index, page_sections, chunk_assign, chunk_statistics)}

_TITLE = "regexp_extract(html, '(?is)<title>(.*?)</title>', 1)"
_CATEGORY = "CASE WHEN contains(url, 'method') THEN 'method' WHEN contains(url, '/post') THEN 'post' WHEN contains(url, '/doc') THEN 'doc' WHEN regexp_matches(url, '[0-9]$') THEN 'numbered' ELSE 'page' END"
_OBJECT = f"CASE WHEN contains({_TITLE}, '.') THEN split_part({_TITLE}, '.', 1) WHEN contains({_TITLE}, ' (') THEN split_part({_TITLE}, ' (', 1) ELSE {_TITLE} END"
_CHUNK = "SELECT doc_id, source, ceil(row_number() OVER (PARTITION BY source ORDER BY doc_id) / 50)::BIGINT AS chunk FROM documents"
ORACLE_SQL = {
    "page_title": f"SELECT page_id, {_TITLE} AS title FROM pages",
    "page_links": """WITH l AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS ls FROM pages) SELECT page_id, unnest(range(len(ls))) AS pos, unnest(ls) AS href FROM l""",
    "page_category": f"SELECT page_id, {_CATEGORY} AS category, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+/([^/]*)', 1) AS dir FROM pages",
    "page_object_name": f"SELECT page_id, {_OBJECT} AS object FROM pages",
    "archive_structure": "SELECT regexp_extract(url, '\\.([a-z0-9]+)$', 1) AS ext, regexp_extract(url, '^[a-z]+://[^/]+/([^/]*)', 1) AS dir, count(*) AS n, sum(octet_length(encode(html)))::BIGINT AS bytes FROM pages GROUP BY ALL",
    "archive_largest": "SELECT page_id, octet_length(encode(html)) AS bytes FROM pages ORDER BY bytes DESC, page_id LIMIT 10",
    "item_index": f"SELECT page_id, {_TITLE} AS title, {_CATEGORY} AS category, {_OBJECT} AS object FROM pages",
    "chunk_assign": _CHUNK,
    "chunk_statistics": f"SELECT source, count(*) AS items, max(chunk) AS files FROM ({_CHUNK}) GROUP BY source",
}
