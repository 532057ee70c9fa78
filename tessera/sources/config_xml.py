"""Configuration trees: metadata objects and forms from XML files, read as one binary-file scan.

The kind comes from the folder, the name from the path; a file that can't be parsed gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.kinds import FOLDERS, TYPE_NAMES, mapped, parent_types

OBJECT_SCHEMA = "path string, name string, synonym string, attributes array<struct<name:string,type_name:string>>, sections array<struct<name:string,display_name:string,attributes:array<struct<name:string,type_name:string>>>>, enum_values array<string>, value_type string"
FORM_SCHEMA = "path string, commands array<string>, attributes array<string>, items array<string>"
_ITEMS = ("InputField", "LabelField", "Table", "Button", "UsualGroup", "CheckBoxField", "Pages")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").load(path).select("path", "modificationTime", "length", "content")


def folder(path: Column) -> Column:
    """The metadata folder that a path lies in."""
    return F.regexp_extract(path, "/(" + "|".join(FOLDERS) + ")/", 1)


def kind(path: Column) -> Column:
    return mapped(folder(path), {k: v[0] for k, v in FOLDERS.items()})


def qualified_name(path: Column) -> Column:
    """prefix.object, and prefix.object.Form.name for a form."""
    prefixes = {k: v[1] for k, v in FOLDERS.items()}
    obj = F.regexp_extract(path, "/(?:" + "|".join(FOLDERS) + ")/([^/.]+)", 1)
    form = F.regexp_extract(path, "/Forms/([^/.]+)", 1)
    return F.concat_ws(".", mapped(folder(path), prefixes), obj, F.when(form != "", F.lit("Form")), F.nullif(form, F.lit("")))


def is_form(path: Column) -> Column:
    return F.contains(path, F.lit("/Forms/")) | F.endswith(path, F.lit("/Form.xml"))


def config_uuid(content: Column) -> Column:
    return F.regexp_extract(F.decode(content, "UTF-8"), 'uuid="([0-9a-fA-F-]{36})"', 1)


def project_name(path: Column, uuid: Column) -> Column:
    """folder_uuid of a configuration; without a UUID a hash of the path stands for it."""
    base = F.regexp_extract(F.regexp_replace(path, "/Configuration[.]xml$", ""), "([^/]+)/?$", 1)
    return F.concat_ws("_", base, F.coalesce(F.nullif(uuid, F.lit("")), F.lower(F.hex(F.xxhash64(path)))))


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _find(e: ElementTree.Element | None, *names: str) -> ElementTree.Element | None:
    for n in names:
        e = next((c for c in e if _tag(c) == n), None) if e is not None else None
    return e


def _text(e: ElementTree.Element | None) -> str | None:
    return (e.text or "").strip() or None if e is not None else None


def _synonym(props: ElementTree.Element | None) -> str | None:
    found = _find(props, "Synonym")
    return next((_text(c) for item in (found if found is not None else ()) for c in item if _tag(c) == "content"), None)


def _attribute(e: ElementTree.Element) -> dict:
    raw = _text(_find(e, "Properties", "Type", "Type"))
    return {"name": _text(_find(e, "Properties", "Name")), "type_name": TYPE_NAMES.get(raw, raw) if raw else None}


def metadata_objects(files: DataFrame) -> DataFrame:
    """One row for each metadata object, with attributes, tabular sections and enum values."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    root = ElementTree.fromstring(content)
                except ElementTree.ParseError:
                    continue
                top = next(iter(root), root)
                props, kids = _find(top, "Properties"), _find(top, "ChildObjects")
                kids = list(kids) if kids is not None else []
                value_type = _text(_find(props, "Type", "Type"))  # of a constant
                sections = [{"name": _text(_find(k, "Properties", "Name")), "display_name": _synonym(_find(k, "Properties")) or _text(_find(k, "Properties", "Name")), "attributes": [_attribute(a) for a in (_find(k, "ChildObjects") or ()) if _tag(a) == "Attribute"]} for k in kids if _tag(k) == "TabularSection"]
                rows.append((path, _text(_find(props, "Name")), _synonym(props), [_attribute(k) for k in kids if _tag(k) == "Attribute"], sections, [_text(_find(k, "Properties", "Name")) for k in kids if _tag(k) == "EnumValue"], TYPE_NAMES.get(value_type, value_type)))
            yield pd.DataFrame(rows, columns=["path", "name", "synonym", "attributes", "sections", "enum_values", "value_type"])

    got = files.where(~is_form(F.col("path")) & (folder(F.col("path")) != "")).select("path", "content").mapInPandas(parse, OBJECT_SCHEMA)
    p = F.col("path")
    return got.withColumns({"kind": kind(p), "qualified_name": qualified_name(p), "display_name": F.coalesce("name", F.substring_index(qualified_name(p), ".", -1))})


def forms(files: DataFrame) -> DataFrame:
    """One row for each form, with commands, attributes and items as "name (Tag)"."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    root = ElementTree.fromstring(content)
                except ElementTree.ParseError:
                    continue
                named = [(_tag(e), e.get("name")) for e in root.iter() if e.get("name")]
                rows.append((path, [n for t, n in named if t == "Command"], [n for t, n in named if t == "Attribute"], [f"{n} ({t})" for t, n in named if t in _ITEMS]))
            yield pd.DataFrame(rows, columns=["path", "commands", "attributes", "items"])

    got = files.where(is_form(F.col("path"))).select("path", "content").mapInPandas(parse, FORM_SCHEMA)
    return got.withColumn("qualified_name", qualified_name(F.col("path")))


def scan(files: DataFrame) -> DataFrame:
    """Objects, common modules and all forms of a configuration as one table of entities, with owner, base types and names of forms.

    An object's file lies in its folder or beside it; a module that has a folder but no readable file is
    an entity by its path alone.
    """
    p = F.col("path")
    found = metadata_objects(files)
    every = forms(files).withColumn("kind", F.lit("Form"))
    owner = F.when(F.contains(p, F.lit("/Forms/")), F.regexp_replace("qualified_name", "[.]Form[.][^.]+$", ""))
    every = every.select("qualified_name", F.substring_index("qualified_name", ".", -1).alias("display_name"), "kind", owner.alias("owner"), F.lit(None).cast("string").alias("documentation"), "attributes", "commands", "items")
    of_owner = every.where("owner is not null").groupBy("owner").agg(F.array_sort(F.collect_list("qualified_name")).alias("forms"))
    objects = found.select("qualified_name", "display_name", "kind", F.lit(None).cast("string").alias("owner"), F.col("synonym").alias("documentation"), F.transform("attributes", lambda a: a["name"]).alias("attributes"), "sections", "enum_values", "value_type")
    objects = objects.withColumn("parent_types", parent_types(F.col("kind"))).join(of_owner.withColumnRenamed("owner", "qualified_name"), "qualified_name", "left")
    seen = files.where(folder(p) == "CommonModules").select(qualified_name(p).alias("qualified_name")).distinct().join(objects, "qualified_name", "left_anti")
    modules = seen.select("qualified_name", F.substring_index("qualified_name", ".", -1).alias("display_name"), F.lit("CommonModule").alias("kind"))
    return objects.unionByName(modules, allowMissingColumns=True).unionByName(every, allowMissingColumns=True)
