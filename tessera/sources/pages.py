"""Documentation pages: fields of HTML as columns, for flat fields; a page is a row (page_id, url, html)."""

from __future__ import annotations

import html
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.names import object_of_title
from tessera.sources import archives

PAGE_SCHEMA = "title string, headings array<string>, sections array<struct<heading:string,text:string>>, links array<struct<text:string,href:string>>"


def title(page: Column) -> Column:
    return F.regexp_extract(page, "(?is)<title>(.*?)</title>", 1)


def hrefs(page: Column) -> Column:
    return F.regexp_extract_all(page, F.lit('href="([^"]*)"'), F.lit(1))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href)."""
    return pages.select("page_id", F.posexplode(hrefs(F.col("html"))).alias("pos", "href"))


def category(url: Column) -> Column:
    """What kind of page a path names; the first rule that fits counts."""
    return F.when(F.contains(url, F.lit("method")), "method").when(F.contains(url, F.lit("/post")), "post").when(F.contains(url, F.lit("/doc")), "doc").when(F.regexp_like(url, F.lit("[0-9]$")), "numbered").otherwise("page")


def host(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://([^/]+)", 1)


def directory(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://[^/]+/([^/]*)", 1)


def extension(url: Column) -> Column:
    return F.regexp_extract(url, "\\.([a-z0-9]+)$", 1)


def archive_structure(pages: DataFrame) -> DataFrame:
    """Pages and bytes of each extension and top directory."""
    return pages.groupBy(extension(F.col("url")).alias("ext"), directory(F.col("url")).alias("dir")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("html")).alias("bytes"))


def largest(pages: DataFrame, n: int = 10) -> DataFrame:
    return pages.select("page_id", F.octet_length("html").cast("long").alias("bytes")).orderBy(F.desc("bytes"), "page_id").limit(n)


def object_name(page: Column) -> Column:
    return object_of_title(title(page))


def item_index(pages: DataFrame) -> DataFrame:
    """(page_id, title, category, object): the index that items are found by."""
    return pages.select("page_id", title(F.col("html")).alias("title"), category(F.col("url")).alias("category"), object_name(F.col("html")).alias("object"))


class _Sections(HTMLParser):
    """Title, headings, links, and the text that follows each heading."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.open, self.href = "", "", None
        self.sections: list[list[str]] = []
        self.links: list[list[str]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("title", "script", "style"):
            self.open = tag
        elif tag in ("h1", "h2", "h3", "h4"):
            self.open = tag
            self.sections.append(["", ""])
        elif tag == "a":
            self.href = dict(attrs).get("href")
            if self.href is not None:
                self.links.append(["", self.href])

    def handle_endtag(self, tag: str) -> None:
        if tag == self.open:
            self.open = ""
        elif tag == "a":
            self.href = None

    def handle_data(self, data: str) -> None:
        if self.open == "title":
            self.title += data
        elif self.open in ("script", "style"):
            return
        elif self.open.startswith("h"):
            self.sections[-1][0] += data
        elif self.sections:
            self.sections[-1][1] += data
        if self.href is not None and self.links:
            self.links[-1][0] += data


def sections(pages: DataFrame) -> DataFrame:
    """page_id and the parsed page: what regular expressions can't tell, such as the text under each heading."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page_id, text in zip(pdf["page_id"], pdf["html"], strict=True):
                p = _Sections()
                p.feed(text or "")
                clean = [(h.strip(), " ".join(t.split())) for h, t in p.sections]
                rows.append((page_id, html.unescape(p.title).strip(), [h for h, _ in clean], [{"heading": h, "text": t} for h, t in clean], [{"text": " ".join(t.split()), "href": u} for t, u in p.links]))
            yield pd.DataFrame(rows, columns=["page_id", "title", "headings", "sections", "links"])

    return pages.select("page_id", "html").mapInPandas(parse, "page_id long, " + PAGE_SCHEMA)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, html): pages of ZIP archives; a member is UTF-8, else Windows-1251. Archives are read by ranges of members: see `sources.archives`."""
    pages = archives.read_members(spark, path)
    found = pages.where(F.regexp_like(F.lower("member"), F.lit("[.]html?$")))
    return found.select("archive", "member", archives.text_of_bytes(F.col("content")).alias("html"))
