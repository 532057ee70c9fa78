"""Configuration reports as objects with attributes and properties.

A report is a row (path, text). Lines are sessions: a line that names an object opens one, and what follows, up to the
next, belongs to it. An attribute's type is carried back from one of the nine lines after it. Both are windows over the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.doc_index import look_ahead

# Folders that name an object's type, tried in turn, and the words of nested lines.
TYPES = {
    "Справочники": "Справочник", "Документы": "Документ", "Константы": "Константа", "РегистрыСведений": "РегистрСведений", "РегистрыНакопления": "РегистрНакопления",
    "Перечисления": "Перечисление", "Отчеты": "Отчет", "Обработки": "Обработка", "Языки": "Язык",
}
ATTRIBUTE, SECTION, TYPE, NO_TYPE = ".Реквизиты.", ".ТабличныеЧасти.", "Тип:", "Неизвестный"


def object_type(name: Column) -> Column:
    return F.coalesce(*(F.when(F.contains(name, F.lit(f"{folder}.")), F.lit(kind)) for folder, kind in TYPES.items()))


def report_lines(reports: DataFrame) -> DataFrame:
    """(path, line, body, role, name, object, ...): lines without outer blanks; role is object, attribute, property or null; object: place, name and type of the object a line belongs to."""
    cut = reports.where("text is not null").select("path", F.posexplode(F.split("text", "\\r?\\n")).alias("line", "body")).withColumn("body", F.trim("body", F.lit(" \t\r\x0b\x0c")))
    dash = F.startswith("body", F.lit("-")) & F.contains("body", F.lit("."))
    name = F.trim(F.ltrim("body", F.lit("-")))
    rows = cut.withColumn("name", F.when(dash, name)).withColumn("nested", F.contains("name", F.lit(ATTRIBUTE)) | F.contains("name", F.lit(SECTION)))
    opens = F.col("name").isNotNull() & ~F.col("nested") & object_type(F.col("name")).isNotNull()
    upto = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    now = F.when(opens, F.struct(F.col("line").alias("line"), F.col("name").alias("name"), object_type(F.col("name")).alias("type")))
    rows = rows.withColumn("object", F.last(now, ignorenulls=True).over(upto)).withColumn("opens", opens)
    inside = F.col("object").isNotNull()
    role = (
        F.when(F.col("opens"), "object")
        .when(inside & F.contains("name", F.lit(ATTRIBUTE)) & (F.size(F.split("name", "[.]")) >= 4), "attribute")
        .when(inside & ~F.startswith("body", F.lit("-")) & F.contains("body", F.lit(":")), "property")
    )
    return rows.withColumn("role", role).drop("nested", "opens")


def objects(reports: DataFrame) -> DataFrame:
    """(path, line, name, type, attributes, properties) of each object; attributes are structs of line, name and type; of one property's values the last counts. Lines count from 1."""
    told = F.when(F.startswith("body", F.lit(TYPE)), F.trim(F.regexp_replace("body", f"^{TYPE}", "")))
    rows = look_ahead(report_lines(reports).withColumnRenamed("path", "doc_id"), told, F.startswith("body", F.lit("-")) & told.isNull()).withColumnRenamed("doc_id", "path")
    key, value = F.trim(F.substring_index("body", ":", 1)), F.trim(F.trim(F.expr("substring(body, instr(body, ':') + 1)")), F.lit('"'))
    is_property = (F.col("role") == "property") & (value != "") & (key != "Тип")
    attribute = F.struct((F.col("line") + 1).alias("line"), F.get(F.split("name", "[.]"), F.lit(3)).alias("name"), F.coalesce("ahead", F.lit(NO_TYPE)).alias("type"))
    inside = rows.where("object is not null")
    lists = inside.groupBy("path", "object").agg(F.array_sort(F.collect_list(F.when(F.col("role") == "attribute", attribute))).alias("attributes"))
    props = inside.where(is_property).groupBy("path", "object", key.alias("key")).agg(F.max_by(value, "line").alias("value"))
    props = props.groupBy("path", "object").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("properties"))
    same = F.col("path").eqNullSafe(F.col("_path")) & (F.col("object") == F.col("_object"))
    got = lists.join(props.withColumnsRenamed({"path": "_path", "object": "_object"}), same, "left")
    return got.select("path", (F.col("object.line") + 1).alias("line"), F.col("object.name").alias("name"), F.col("object.type").alias("type"), "attributes", F.coalesce("properties", F.create_map().cast("map<string,string>")).alias("properties"))


def statistics(found: DataFrame) -> DataFrame:
    """(type, objects, attributes) of each type, and of all under a null type, with the attributes of an object on average."""
    got = found.withColumn("n", F.size("attributes")).rollup("type").agg(F.count(F.lit(1)).alias("objects"), F.coalesce(F.sum("n"), F.lit(0)).alias("attributes"))
    return got.withColumn("average", F.when(F.col("objects") > 0, F.col("attributes") / F.col("objects")).otherwise(0.0))
