"""Operators on small hand-made tables, and on the driver's smallest ones against SQL."""

import io
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions import names as nm
from tessera.lexicon import SCRIPT
from tessera.operators import closure, flow, incremental, index, metrics, passages, results, rules, spans, verify
from tessera.plans import ORACLE_SQL, QUERIES
from tessera.plans._tables import RULES_TOML
from tessera.sources import config_xml, entities, modules, pages

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def _rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(repr, df.where(df.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def _one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_names(spark):
    n = F.col("n")
    assert _one(spark, nm.first_name(n), n="Массив (Array)") == "Массив" and _one(spark, nm.second_name(n), n="Массив (Array)") == "Array"
    assert _one(spark, nm.first_name(n), n="plain") is None
    assert _one(spark, nm.short_name(n), n="A.B.C") == "C" and _one(spark, nm.root_name(n), n="A.B.C") == "A"
    assert _one(spark, nm.object_of_title(n), n="Запрос.Выполнить (Query.Execute)") == "Запрос" and _one(spark, nm.object_of_title(n), n="Запрос (Query)") == "Запрос"
    assert _one(spark, nm.completion_token(n), n="x = Справ") == "Справ"
    assert _one(spark, nm.to_uri(n), n="C:\\a\\b") == "file:///C:/a/b" and _one(spark, nm.to_uri(n), n="a/b") == "a/b"
    assert _one(spark, nm.value_type(n), n='"s"') == "Строка" and _one(spark, nm.value_type(n), n="12.5") == "Число" and _one(spark, nm.value_type(n), n="Истина") == "Булево"
    sig = nm.method_signature(n, F.expr("array(named_struct('name','p','type_name','T'), named_struct('name','q','type_name',cast(null as string)))"), F.lit("R"), "Any")
    assert _one(spark, sig, n="m") == "m(p: T, q: Any) -> R"
    assert _one(spark, nm.insert_text(n, F.array(F.lit("a"), F.lit("b"))), n="m") == "m(${0:a}, ${1:b})"


def test_metrics_of_a_script(spark):
    body = "\n".join(["Процедура А()"] + ["  Если Х = 1 Тогда"] * 2 + ["  Для Н = 1 По 3 Цикл"] + ['  Т = Т + "1";'] + ["КонецПроцедуры", ""])
    docs = spark.createDataFrame([(1, body), (2, ""), (3, "a\nb\nc\na\nb\nc\n"), (4, "\n".join(["Функция Ф()"] + ["x"] * 60 + ["КонецФункции"]))], "doc_id long, text string").withColumns({"lang": F.lit("x"), "source": F.lit("y")})
    got = {r.doc_id: r for r in metrics.quality(docs, SCRIPT).collect()}
    assert got[1].loc == 6 and got[1].cyclomatic == 5.0 and got[1].cognitive == 7.0
    assert got[2].maintainability is None and got[2].dup_pct == 0.0 and got[2].loc == 0
    assert got[3].dup_pct == 50.0
    items = {(r.doc_id, r.item) for r in metrics.debt_items(docs, SCRIPT).collect()}
    assert (4, "long_routine") in items and (1, "concat_in_loop") in items and (1, "undocumented") in items


def test_lookup_prefers_tiers_and_last_loaded(spark):
    e = spark.createDataFrame([("a", "q.a", "Имя (Name)", "P", "k", 1), ("b", "q.b", "Имя (Name)", "P", "k", 2), ("c", "Name", "other", "P", "k", 0)], "id string, qualified_name string, display_name string, entity_type string, entity_kind string, load_ord long")
    n = index.name_index(e, spark.createDataFrame([("alias", "a")], "name string, id string"))
    got = {r.name: (r.id, r.tier) for r in index.lookup(spark.createDataFrame([(x,) for x in ("alias", "Name", "Имя (Name)", "Имя", "none")], "name string"), n).collect()}
    assert got == {"alias": ("a", 0), "Name": ("c", 1), "Имя (Name)": ("b", 2), "Имя": ("b", 3), "none": (None, None)}


def test_closure_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "child string, parent string")
    got = {(r.descendant, r.ancestor): r.depth for r in closure.closure(e).collect()}
    assert got["a", "a"] == 3 and got["d", "c"] == 3 and len(got) == 12


def test_link_by_qualified_then_display(spark):
    parents = spark.createDataFrame([("1", "Q", "D", 1), ("2", "D", "E", 2)], "id string, qualified_name string, display_name string, load_ord long")
    kids = spark.createDataFrame([("x", "D"), ("y", "E"), ("z", "none")], "child string, parent_name string")
    assert {tuple(r) for r in closure.link(kids, parents).collect()} == {("x", "2"), ("y", "2")}


def test_similar_needs_the_same_type(spark):
    w = spark.createDataFrame([("t", "Adn"), ("u", "Adn")], "type string, wanted string")
    m = spark.createDataFrame([("t", "Add"), ("t", "Insert"), ("u", "Count")], "type string, member string")
    assert [(r.type, r.member, r.distance) for r in verify.similar(w, m).collect()] == [("t", "Add", 1)]


def test_rules_config(spark):
    c = rules.RulesConfig.from_toml(RULES_TOML)
    assert not c.problems() and c.effective().excludes == ["view"]
    assert {r.rule_id for r in rules.strict(c).table(spark).where("enabled").collect()} == set(c.rules)
    bad = rules.RulesConfig({}, {"a": rules.Profile("a", "b"), "b": rules.Profile("b", "a")}, "a")
    with pytest.raises(ValueError, match="extends itself"):
        bad.effective()
    d = spark.createDataFrame([("error", "info", "m", 0.5), ("new", "info", "m", 0.1)], "code string, level string, message string, confidence double")
    assert [r.code for r in rules.apply_rules(d, c.table(spark)).collect()] == ["new"]


def test_reports(spark, tmp_path):
    d = spark.createDataFrame([("BSL001", "error", "a < b", "/x y.bsl", 1, 2), ("BSL002", "hint", "m", "z.bsl", 3, 4)], "code string, level string, message string, file_path string, line long, column_no long")
    results.write_all(d, f"{tmp_path}/out", "tool")
    assert spark.read.text(f"{tmp_path}/out/sarif/results").count() == 2
    assert "a &lt; b" in spark.read.text(f"{tmp_path}/out/html").first()[0]
    assert spark.read.text(f"{tmp_path}/out/text").first()[0] == "/x y.bsl:1:2: error BSL001: a < b"


def test_passages(spark):
    docs = spark.createDataFrame([(1, "xone two three four five six seven!"), (2, "nothing"), (3, "a b"), (4, "one two  three four five six seven")], "doc_id long, text string")
    p = spark.createDataFrame([(1, "one two three four five six seven"), (2, "a b"), (3, None)], "item_id long, passage string")
    assert {tuple(r) for r in passages.holding(docs, p).collect()} == {(1, 1), (3, 2)}


def test_spans(spark):
    docs = spark.createDataFrame([(1, "añb\n\nc")], "doc_id long, text string")
    offs = spark.createDataFrame([(1, o) for o in (0, 3, 5, 6)], "doc_id long, offset long")
    got = {r.offset: (r.line, r.column_no) for r in spans.offset_to_line(offs, spans.line_starts(docs)).collect()}
    assert got == {0: (0, 0), 3: (0, 3), 5: (1, 0), 6: (2, 0)}
    nodes = spark.createDataFrame([(1, 1, None), (1, 2, 1), (1, 3, 2)], "doc_id long, node_id long, parent_id long")
    hit = nodes.where("node_id in (1, 2)").select("doc_id", "node_id")
    up = spark.createDataFrame([(1, 2, 1), (1, 3, 1), (1, 3, 2)], "doc_id long, node_id long, ancestor long")
    assert [r.node_id for r in spans.topmost(hit, up).collect()] == [1] and [r.node_id for r in spans.deepest(hit, nodes).collect()] == [2]


@pytest.mark.parametrize(("old", "new", "want"), [("abcdef", "abXef", (2, 4, 3)), ("same", "same", (4, 4, 4)), ("", "x", (0, 0, 1)), ("aa", "aaa", (2, 2, 3)), ("é", "è", (1, 2, 2))])
def test_dirty_range(spark, old, new, want):
    got = spark.createDataFrame([(old, new)], "a string, b string").select(spans.dirty_range(F.col("a"), F.col("b")).alias("r")).first().r
    assert tuple(got) == want


def test_incremental(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, n int")
    up = incremental.upsert(base, spark.createDataFrame([(2, "c", 2), (3, "d", 2)], base.schema), ["k"], "n")
    assert {tuple(r)[:2] for r in up.collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {r.k for r in incremental.delete(up, up.where("k = 2"), ["k"]).collect()} == {1, 3}
    f = "doc_id long, node_id long, fingerprint string"
    old, new = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "q")], f), spark.createDataFrame([(1, 1, "x"), (1, 2, "z"), (2, 1, "q"), (2, 2, "r")], f)
    assert [tuple(r) for r in incremental.changed_nodes(old, new).collect()] == [(1, 2)]


MODULE = "\ufeffПерем Общая;\r\nФункция Имя(Знач А, Б = 1) Экспорт\r\n  Перем В, Г;\r\n  В = А + Б; // Г\r\n  Сообщить(В, \"Г\");\r\nКонецФункции\r\n"


def test_modules(spark, tmp_path):
    (tmp_path / "CommonModules").mkdir()
    (tmp_path / "CommonModules" / "m.bsl").write_text(MODULE, encoding="utf-8", newline="")
    (tmp_path / "n.txt").write_text("x")
    m = modules.read_modules(spark, str(tmp_path))
    assert m.first().text.startswith("Перем") and m.count() == 1
    r = modules.routines(m).first()
    assert (r.kind, r.name, r.parameters, r.is_export) == ("function", "Имя", ["А", "Б"], True)
    assert r.by_value == [True, False]
    c = {(x.object, x.member): x.n_args for x in modules.calls(m).collect()}
    assert c[None, "Сообщить"] == 2
    ev = modules.variable_events(m)
    assert "Г" in {x.name for x in flow.unused(ev).collect()} and "В" not in {x.name for x in flow.unused(ev).collect()}
    assert m.select(modules.module_type(F.col("path"))).first()[0] == "common"


OBJECT = """<MetaDataObject xmlns="http://x" xmlns:v8="http://v8"><Catalog uuid="u"><Properties><Name>Goods</Name><Synonym><v8:item><v8:content>Товары</v8:content></v8:item></Synonym></Properties>
<ChildObjects><Attribute><Properties><Name>Code</Name><Type><v8:Type>xs:string</v8:Type></Type></Properties></Attribute>
<TabularSection><Properties><Name>Rows</Name></Properties><ChildObjects><Attribute><Properties><Name>Qty</Name><Type><v8:Type>xs:decimal</v8:Type></Type></Properties></Attribute></ChildObjects></TabularSection></ChildObjects></Catalog></MetaDataObject>"""
FORM = """<Form><ChildItems><UsualGroup name="G"><ChildItems><InputField name="Code"/></ChildItems></UsualGroup></ChildItems><Attributes><Attribute name="Object"/></Attributes><Commands><Command name="Post"/></Commands></Form>"""


def test_config_xml(spark, tmp_path):
    for p, t in (("Catalogs/Goods.xml", OBJECT), ("Catalogs/Goods/Forms/Item/Ext/Form.xml", FORM), ("Catalogs/Bad.xml", "<a"), ("Other/x.xml", OBJECT)):
        f = tmp_path / "conf" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(t, encoding="utf-8")
    files = config_xml.read_files(spark, f"{tmp_path}/conf")
    o = config_xml.metadata_objects(files).collect()
    assert len(o) == 1 and o[0].qualified_name == "Справочники.Goods" and o[0].kind == "Catalog" and o[0].synonym == "Товары"
    assert [tuple(a) for a in o[0].attributes] == [("Code", "Строка")] and o[0].sections[0].attributes[0].type_name == "Число"
    form = config_xml.forms(files).first()
    assert form.qualified_name == "Справочники.Goods.Form.Item" and form.commands == ["Post"] and form["items"] == ["G (UsualGroup)", "Code (InputField)"]


def test_archives(spark, tmp_path):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("a.html", "<title>Да</title>".encode("cp1251"))
        z.writestr("b.txt", "no")
    (tmp_path / "h.zip").write_bytes(b.getvalue())
    r = pages.read_archives(spark, str(tmp_path)).collect()
    assert [(x.member, x.html) for x in r] == [("a.html", "<title>Да</title>")]


def test_entities_round_trip(spark, tmp_path):
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "a.jsonl").write_text('{"id":"1","qualified_name":"Q","interface":{"methods":{"M":{"name":"M"}}},"constraints":{"parent_types":["P"]}}\n\n', encoding="utf-8")
    e = entities.read_jsonl(spark, f"{tmp_path}/e")
    assert e.count() == 1 and entities.method_rows(e).first().member == "M" and entities.parent_rows(e).first().parent_name == "P"
    entities.write_jsonl(e, f"{tmp_path}/out", "proj", "8.3")
    assert entities.read_jsonl(spark, f"{tmp_path}/out/project=proj/version=8.3").first().id == "1"
    (tmp_path / "e" / "bad.jsonl").write_text("nonsense\n")
    with pytest.raises(Exception):
        entities.read_jsonl(spark, f"{tmp_path}/e").collect()
