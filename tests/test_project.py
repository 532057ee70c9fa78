"""Configuration scan, documentation pages, call checks, aliases, rule catalogue, documentation index and relinking on small fixtures."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import names
from tessera.operators import call_check, doc_index, incremental, index, project, results, rules, verify, words
from tessera.sources import config_xml, docs, entities, kinds, modules

OBJECT = """<M xmlns="http://x" xmlns:v8="http://v8"><{tag}><Properties><Name>{name}</Name><Synonym><v8:item><v8:content>Syn {name}</v8:content></v8:item></Synonym>{more}</Properties>
<ChildObjects><TabularSection><Properties><Name>Rows</Name><Synonym><v8:item><v8:content>Строки</v8:content></v8:item></Synonym></Properties></TabularSection></ChildObjects></{tag}></M>"""
FORM = '<Form><Attributes><Attribute name="Object"/></Attributes><Commands><Command name="Post"/></Commands></Form>'


def test_scan_of_every_folder(spark, tmp_path):
    root = tmp_path / "conf"
    for folder, (kind, _, _) in kinds.FOLDERS.items():
        if folder not in ("CommonForms", "CommonModules"):
            more = "<Type><v8:Type>xs:boolean</v8:Type></Type>" if folder == "Constants" else ""
            at = root / folder / f"{kind}1.xml"
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text(OBJECT.format(tag=kind, name=f"{kind}1", more=more), encoding="utf-8")
    for path, text in (("Catalogs/Catalog1/Forms/Item/Ext/Form.xml", FORM), ("CommonForms/Main/Ext/Form.xml", FORM), ("CommonModules/Tools.xml", "<broken")):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text, encoding="utf-8")
    by = {r.qualified_name: r for r in config_xml.scan(config_xml.read_files(spark, str(root))).collect()}
    assert len(by) == 17 + 2 + 1
    assert by["Константы.Constant1"].value_type == "Булево" and by["ПланыСчетов.ChartOfAccounts1"].parent_types == ["ПланСчетовОбъект"] and by["Задачи.Task1"].parent_types == []
    c = by["Справочники.Catalog1"]
    assert c.forms == ["Справочники.Catalog1.Form.Item"] and c.documentation == "Syn Catalog1" and c.sections[0].display_name == "Строки"
    f = by["Справочники.Catalog1.Form.Item"]
    assert (f.kind, f.owner, f.commands, f.attributes) == ("Form", "Справочники.Catalog1", ["Post"], ["Object"])
    assert by["ОбщиеМодули.Tools"].kind == "CommonModule" and by["ОбщиеФормы.Main"].owner is None
    p = spark.createDataFrame([("file:/a/Conf/Configuration.xml", "u1"), ("/b/Conf/Configuration.xml", "")], "p string, u string")
    one, two = [r.n for r in p.select(config_xml.project_name(F.col("p"), F.col("u")).alias("n")).collect()]
    assert one == "Conf_u1" and two.startswith("Conf_") and len(two) == 21


def test_kinds(spark):
    df = spark.createDataFrame([("Map", "Массив", "МенеджерДокументов"), ("Odd", "Odd", "Odd")], "k string, n string, t string")
    k = F.col("k")
    got = df.select(kinds.category(k).alias("c"), kinds.category_place(kinds.category(k)).alias("p"), kinds.type_kind(F.col("n")).alias("t"), kinds.prefix(k).alias("x"), kinds.manager_type(F.col("t"), F.lit("A")).alias("m")).collect()
    assert [tuple(r) for r in got] == [("Collections", 2, "Array", "Прочие", "ДокументМенеджер.A"), ("Other", 99, "System", "Прочие", None)]
    assert df.select(kinds.contexts(F.array(F.lit("Клиент"), F.lit("x"), F.lit("WebClient"))).alias("c")).first().c == ["Client", "WebClient"]


PAGE = """<html><h1 class="V8SH_pagetitle">Массив.Найти (Array.Find)</h1><p class="V8SH_title">Массив (Array)</p>
<p class="V8SH_chapter">Вариант синтаксиса: По значению</p><p class="V8SH_chapter">Синтаксис:</p>Найти(&lt;Значение&gt;)<br>ещё
<p class="V8SH_chapter">Параметры:</p><div class="V8SH_rubric"><p>&lt;Значение&gt; (необязательный)</p></div>Тип: Число. Что ищут.<div class="V8SH_rubric">&lt;Где&gt; <a href="v8help://x/def_String">Строка</a></div>
<p class="V8SH_chapter">Возвращаемое значение:</p>Тип: <a href="x">Число</a>. <br>
<p class="V8SH_chapter">Описание:</p>Ищет <b>значение</b>.
<p class="V8SH_chapter">Доступность: </p>Сервер, тонкий клиент. Ещё.
<p class="V8SH_chapter">Методы:</p><ul><li>Добавить (Add)</li><li>Количество</li></ul>
<p class="V8SH_chapter">Пример:</p><table><tr><td>А = 1;</td></tr></table>
<p class="V8SH_chapter">Использование в версии:</p><p class="V8SH_versionInfo">Доступен, начиная с версии 8.0.</p></html>"""


def test_documentation_page(spark):
    pages = spark.createDataFrame([(1, "objects/a/methods/find.html", PAGE), (2, "tables/t.html", "<p>no chapters</p>"), (3, "x", None)], "page_id long, path string, html string")
    f = {r.page_id: r for r in docs.page_facts(pages).collect()}
    one = f[1]
    assert (one.title, one.english_name, one.object_context, one.category, one.return_type, one.version) == ("Массив.Найти (Array.Find)", "Array", "Массив", "method", "Число", "8.0.")
    assert one.description == "Ищет значение." and one.availability == ["Сервер", "тонкий клиент"] and one.example == "А = 1;" and one.links == ["v8help://x/def_String"]
    assert [tuple(m) for m in one.methods] == [("Добавить", "Add"), ("Количество", None)]
    assert f[2].category == "table" and f[2].description is None and f[3].title is None
    rows = docs.chapters(pages)
    params = docs.parameters(rows)
    assert [(p.variant, p.name, p.type, p.is_optional) for p in params.orderBy("pos").collect()] == [("По значению", "Значение", "Число", True), ("По значению", "Где", "Строка", False)]
    assert [(s.variant, s.syntax) for s in docs.syntax_variants(rows).collect()] == [("По значению", "Найти(<Значение>)")]
    e = docs.entities(docs.page_facts(pages), params).collect()
    assert [(x.object, x.member, x.kind, len(x.parameters)) for x in e] == [("Массив", "Найти", "method", 2)]
    assert {r.category: r.pages for r in docs.statistics(docs.page_facts(pages)).collect()} == {"method": 1, "table": 1, "": 1}
    tries = spark.createDataFrame([('Тип: <a href="a">Дата</a>. <br>', "Дата"), ("Тип: Справочник.Товары, и", "Справочник.Товары"), ('<a href="q">Описание</a>', None), ("", None), ('Type: <a class="z" href="a"><b>Date</b></a>', "Date"), ("Тип:\n <i>Массив</i> строк", "Массив"), ('см. <a href="q">далее</a>, <a href="w">Запрос.Поле</a>', "Запрос.Поле"), ("Тип: нет", None)], "b string, want string")
    assert [r.got for r in tries.select(docs.return_type(F.col("b")).alias("got")).collect()] == [r.want for r in tries.collect()]


MEMBERS = "type string, member string, least int, most int, returns string, availability array<string>, is_deprecated boolean, deprecation string"


def test_calls_from_modules_to_diagnostics(spark):
    text = "Процедура П()\n  А = Новый Массив;\n  Б = А.Копия();\n  Б.Добавить(1, 2);\n  А.Добавит(1);\n  Б.Найти(1);\n  В.Найти(1);\nКонецПроцедуры\n"
    m = spark.createDataFrame([("m.bsl", text)], "path string, text string")
    line = m.select("path", F.posexplode(F.split("text", "\n")).alias("pos", "body"))
    value = line.select(F.col("path").alias("scope"), "pos", F.regexp_extract("body", "^\\s*(\\S+) = (.*);", 1).alias("name"), F.regexp_extract("body", "^\\s*(\\S+) = (.*);", 2).alias("value")).where("name != ''")
    members = spark.createDataFrame([("Массив", "Добавить", 1, 1, None, [], False, None), ("Массив", "Копия", 0, 0, "Массив", [], False, None), ("Массив", "Найти", 1, 1, "Число", ["Client"], True, "Искать")], MEMBERS)
    none = spark.createDataFrame([], "name string, tier int, id string")
    types = call_check.assigned_types(value, none, members)
    assert {(r.name, r.type) for r in types.collect()} == {("А", "Массив"), ("Б", "Массив")}
    found = line.withColumnRenamed("body", "text").select(F.concat_ws("#", "path", "pos").alias("path"), "text")
    calls = modules.calls(found).where("object is not null")
    calls = calls.select(F.xxhash64("path").alias("call_id"), F.split("path", "#")[0].alias("scope"), F.split("path", "#")[1].cast("int").alias("pos"), "object", "member", "n_args")
    checked = call_check.check(call_check.typed_calls(calls, types), members.select("type"), members)
    by = {(r.member, r.type): (r.problem, r.warning) for r in checked.collect()}
    assert by["Копия", "Массив"] == (None, None) and "takes at most 1" in by["Добавить", "Массив"][0] and "not found for type" in by["Добавит", "Массив"][0]
    assert by["Найти", "Массив"] == ("Method 'Найти' is not available in Server context", "Method 'Найти' is deprecated: Искать") and by["Найти", None][0] == "Type '?' not found"
    told = [r.message for r in call_check.diagnostics(checked, members).collect()]
    assert any(t.endswith("\n\nПредложения:\n• Добавить\n") for t in told) and len(told) == 4
    assert call_check.in_context(members, "Client").count() == 1 and call_check.in_context(members, None).count() == 3
    assert tuple(call_check.summary(members.where("member = 'Копия'"), members).first()) == ("Массив", 3, 1, 2)
    s = project.call_stats(calls).first()
    assert (s.calls, s.method_calls, s.arguments, s.most_arguments) == (5, 5, 5, 2)


def test_types_of_managers_and_names(spark):
    names_ = spark.createDataFrame([("Справочники", 0, "СправочникиМенеджер (CatalogsManager)")], "name string, tier int, id string")
    rows = [("s", "a", 1, "Справочники.Товары"), ("s", "b", 2, "a"), ("s", "c", 3, "b"), ("s", "d", 4, '"x"'), ("s", "e", 5, "Неопределено"), ("s", "f", 6, "later"), ("s", "later", 7, "1")]
    got = call_check.assigned_types(spark.createDataFrame(rows, "scope string, name string, pos int, value string"), names_, spark.createDataFrame([], MEMBERS))
    assert {r.name: r.type for r in got.collect()} == {"a": "СправочникМенеджер.Товары", "b": "СправочникМенеджер.Товары", "c": "СправочникМенеджер.Товары", "d": "Строка", "e": "Неопределено", "later": "Число"}


def test_aliases(spark):
    e = spark.createDataFrame([("1", "q.ConstantsManager", "x", 1), ("2", "q2", "МенеджерКонстант", 2), ("3", "a.ConstantsManager", "y", 3)], "id string, qualified_name string, display_name string, load_ord long")
    got = {r.name: r.id for r in index.resolve_aliases(kinds.ALIASES, index.name_index(e)).collect()}
    assert got == {"Константы": "2", "Constants": "3"}
    e = e.withColumns({"english_name": F.lit("Number"), "entity_type": F.lit("P"), "entity_kind": F.col("id")})
    assert index.of_type(e, "P", "2").count() == 1 and index.of_type(e).count() == 3
    static = spark.createDataFrame([("Number",), ("String",)], "english_name string")
    assert [r.english_name for r in index.missing_types(e, static).collect()] == ["String"]
    info = index.type_info(e.where("id = '1'"), e.withColumns({"parents": F.array(F.lit("a"), F.lit("b")), "implements": F.array().cast("array<string>")})).first().info
    assert info == {"parent": "b", "entity_type": "P", "entity_kind": "1"}


def test_similar_by_containment_or_distance(spark):
    w = spark.createDataFrame([("t", "добавит")], "type string, wanted string")
    m = spark.createDataFrame([("t", x) for x in ("Добавить", "ДобавитьВсе", "Дабавид", "Удалить", "доб")], "type string, member string")
    assert [r.member for r in verify.alike(w, m).orderBy("rank").collect()] == ["Дабавид", "Добавить", "ДобавитьВсе"]


def test_rule_catalogue_and_custom_rules(spark):
    assert rules.catalogue(spark).count() == 10 and not rules.catalogue(spark).where("rule_id = 'BSL008'").first().enabled
    toml = '[CUSTOM1]\npattern_type = "Regex"\npattern = "a+"\nmessage_template = "m"\n[odd]\nconfidence = 2.0\n'
    table = rules.custom_rules(spark, toml)
    assert {(r.rule_id, r.pattern_type) for r in table.collect()} == {("CUSTOM1", "regex"), ("odd", "contains")}
    assert rules.custom_problems({"id": "odd", "confidence": 2.0}) == ["the id begins with none of CUSTOM, USER", "there is no pattern to look for", "a confidence of 2.0 is not within 0 and 1", "there is no message"]
    with pytest.raises(ValueError, match="no regular expression"):
        rules.custom_rules(spark, '[USER1]\npattern_type = "regex"\npattern = "("\nmessage_template = "m"\n')
    d = spark.createDataFrame([("BSL001", "warning"), ("X", "hint")], "code string, level string")
    assert {r.code: len(r.advice) for r in rules.advice(d).collect()} == {"BSL001": 3, "X": 1} and rules.at_least(d, "warning").count() == 1
    s = rules.summary(rules.stats(d, rules.catalogue(spark))).first()
    assert (s.rules, s.applications, s.violations) == (1, 1, 0)


def test_documentation_index(spark, tmp_path):
    items = spark.createDataFrame([("a", f"i{i:03}", "o" if i % 2 else "p", "x" * (10 if i else 60_000)) for i in range(60)] + [("b", "z", "o", "y")], "category string, item_id string, object string, body string")
    got = {(r.category, r.item_id): r.chunk for r in doc_index.chunks(items.withColumn("bytes", F.length("body"))).collect()}
    assert got["a", "i000"] == 1 and got["a", "i001"] == 2 and got["a", "i050"] == 2 and got["a", "i051"] == 3 and got["b", "z"] == 1
    path = f"{tmp_path}/out"
    doc_index.write(items, path)
    back = doc_index.read(spark, path, "item_id string, object string, body string", "a")
    assert back.count() == 60 and back.select("chunk").distinct().count() == 3
    cats = spark.read.json(f"{path}/categories")
    assert {r.category: (r["items"], r.files) for r in cats.collect()} == {"a": (60, 3), "b": (1, 1)}
    assert doc_index.main_index(cats).first().files == 4 and doc_index.main_index(cats.limit(0)).first().items_per_file == 0
    main = spark.read.json(f"{path}/main_index").first()
    assert (main["items"], main.files, main.objects) == (61, 4, 2)
    assert {r.object for r in spark.read.json(f"{path}/top_objects").collect()} == {"o", "p"} and spark.read.json(f"{path}/item_index").count() == 61
    assert {r.group: r.objects for r in doc_index.grouped_objects(spark.createDataFrame([("Запрос",), ("Массив",), ("Дата",), ("Q",)], "object string")).collect()}["other"] == ["Q"]
    assert doc_index.by_object(items, "o").count() == 31


def test_relinking_and_freshness(spark):
    files = spark.createDataFrame([("p", "/p/Configuration.xml", 100, 5), ("q", "/q/Configuration.xml", 300, 5), ("q", "/q/a.xml", 900, 5)], "project string, path string, at long, length long").withColumn("modificationTime", F.timestamp_seconds("at"))
    manifest = spark.createDataFrame([("p", 200), ("q", 200), ("r", 200)], "project string, at long").select("project", F.timestamp_seconds("at").alias("created_at"))
    assert {r.project: r.fresh for r in incremental.fresh(manifest, files).collect()} == {"p": True, "q": False, "r": False}
    assert incremental.file_hashes(files).select("hash").distinct().count() == 3
    cache, depends = spark.createDataFrame([("k1",), ("k2",)], "key string"), spark.createDataFrame([("k1", "/q/a.xml"), ("k2", "/p/Configuration.xml")], "key string, path string")
    assert [r.key for r in incremental.stale(cache, depends, files, F.timestamp_seconds(F.lit(1000)), 500).collect()] == ["k1"]
    r = "doc_id long, kind string, name string, body string"
    old, new = spark.createDataFrame([(1, "f", "a", "1"), (1, "f", "b", "1")], r), spark.createDataFrame([(1, "f", "a", "2"), (1, "f", "b", "2")], r)
    got = incremental.rebuilt(old, old.where("name = 'a'"), new)
    assert {(x.name, x.body, x.rebuilt) for x in got.collect()} == {("a", "2", True), ("b", "1", False)} and incremental.reuse(got).first().ratio == 0.5
    ties = spark.createDataFrame([(1, "a", 1)], "k int, v string, n int")
    up = incremental.upsert(ties, spark.createDataFrame([(1, "b", 1), (1, "c", 1)], ties.schema), ["k"], "n")
    assert [x.v for x in up.collect()] == ["c"]


def test_names_and_reports(spark):
    p = F.array(F.struct(F.lit("a").alias("name"), F.lit("T").alias("type_name"), F.lit(False).alias("is_optional")), F.struct(F.lit("b").alias("name"), F.lit(None).cast("string").alias("type_name"), F.lit(True).alias("is_optional")))
    one = spark.range(1).select(names.display_text(F.lit("m"), p, F.lit(None).cast("string"), F.lit(True)).alias("d"), names.word_at(F.lit("Новый Массив;"), F.lit(8)).alias("w"), names.word_at(F.lit("a ;"), F.lit(3)).alias("e")).first()
    assert (one.d, one.w, one.e) == ("m(a: T, [b: ?]) -> ? [DEPRECATED]", "Массив", "")
    t = spark.range(1).select(names.binary_type(F.lit("+"), F.lit("Число"), F.lit("Число")).alias("a"), names.binary_type(F.lit("+"), F.lit("Число"), F.lit("Строка")).alias("b"), names.unary_type(F.lit("Не"), F.lit("Число")).alias("c"), names.unary_type(F.lit("-"), F.lit("Число")).alias("d")).first()
    assert tuple(t) == ("Число", "Unknown", "Булево", "Число")
    r = spark.createDataFrame([("error", "f"), ("hint", "g")], "level string, file_path string")
    assert [x.value for x in results.summary_lines(r).collect()] == ["Issues: 2", "Files: 2", "error: 1", "warning: 0", "info: 0", "hint: 1"]


def test_words_in_context(spark):
    lines = [("  Если А", "Если"), ("Б = Новый Массив", "Массив"), ("Перем Х Как Число", "Число"), ("А = Если", "Если"), ("нет", "Если")]
    df = spark.createDataFrame(lines, "line string, word string").withColumn("context", words.context(F.col("line"), F.col("word")))
    assert [r.context for r in df.collect()] == ["StatementStart", "AfterNew", "TypeDeclaration", "Expression", "Unknown"]
    e = spark.createDataFrame([("Число (Number)", "Primitive", False), ("Массив (Array)", "Array", False), ("Сообщить", "System", True)], "display_name string, entity_kind string, is_global_function boolean")
    v = words.union(words.vocabulary_of(e), spark.createDataFrame([("Если", "strict"), ("Если", "strict")], "word string, role string"))
    assert {(r.word, r.role) for r in v.collect()} == {("Число", "type"), ("Number", "type"), ("Массив", "object"), ("Array", "object"), ("Сообщить", "function"), ("Если", "strict")}
    got = {(r.word, r.context): (r.is_reserved, r.can_be_variable) for r in words.classified(df, v).collect()}
    assert got["Если", "StatementStart"] == (True, False) and got["Массив", "AfterNew"] == (True, False) and got["Число", "TypeDeclaration"] == (True, True) and got["Если", "Expression"] == (True, False)


def test_reports_and_json_records(spark, tmp_path):
    (tmp_path / "r").mkdir()
    for name, raw in (("a", "\ufeffТекст".encode("utf-16-le")), ("b", "Текст".encode()), ("c", "Текст".encode("cp1251"))):
        (tmp_path / "r" / f"{name}.txt").write_bytes(raw)
    assert {(r.text, r.encoding) for r in modules.read_reports(spark, f"{tmp_path}/r").collect()} == {("Текст", "UTF-16LE"), ("Текст", "UTF-8"), ("Текст", "CP1251")}
    rows = spark.createDataFrame([("1", '{"name":"M","is_function":true}')], "id string, json string")
    assert entities.methods_of_json(rows).first().method.is_function and entities.properties_of_json(rows).first().property.type_name == "Unknown"
    assert spark.range(1).select(modules.looks_like_module(F.lit("Процедура А()")).alias("m")).first().m
