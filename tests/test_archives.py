"""Archives read by ranges of members, and their pages made into entities."""

import random
import zipfile

import pytest

from tessera.sources import archives, entities, syntax_db

PAGE = '<html><h1 class="V8SH_pagetitle">{title}</h1>{context}<p class="V8SH_chapter">Описание:</p>{text}{more}</html>'


def _page(title, context="", text="x", more=""):
    return PAGE.format(title=title, context=f'<p class="V8SH_title">{context}</p>' if context else "", text=text, more=more)


def test_one_archive_in_many_tasks(spark, tmp_path):
    rng = random.Random(1)
    want = {}
    with zipfile.ZipFile(tmp_path / "a.hbk", "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(300):
            name, body = f"objects/f{i % 7}/p{i}.html", bytes(rng.randrange(256) for _ in range(rng.choice([0, 10, 3000])))
            z.writestr(name, body)
            want[name] = body
        z.writestr("folder/", "")
        z.writestr("big.bin", b"y" * 3_000_000)
        want["big.bin"] = b"y" * 3_000_000
    (tmp_path / "notes.txt").write_text("no archive")
    got = archives.read_members(spark, str(tmp_path), partMembers="40")
    assert got.rdd.getNumPartitions() >= 8
    rows = got.collect()
    assert {r.member: bytes(r.content) for r in rows} == want and len(rows) == len(want) and all(r.size == len(r.content) for r in rows)
    assert archives.read_members(spark, f"{tmp_path}/a.hbk").count() == len(want)
    assert archives.read_members(spark, f"file://{tmp_path}/a.hbk").count() == len(want)
    (tmp_path / "none").mkdir()
    assert archives.read_members(spark, f"{tmp_path}/none").collect() == []


@pytest.mark.parametrize("most", [(10, 3), (1, 100), (1000, 1), (5, 2)])
def test_ranges(most):
    sizes = [3, 4, 20, 0, 0, 0, 9, 1, 1, 1]
    got = archives.ranges(sizes, *most)
    assert [i for a, b in got for i in range(a, b)] == list(range(len(sizes)))
    assert all(b - a <= most[1] and (sum(sizes[a:b]) <= most[0] or b - a == 1) for a, b in got)
    assert archives.ranges([], 1, 1) == []


def test_texts(spark):
    rows = spark.createDataFrame([("Текст".encode(),), ("Текст".encode("cp1251"),), (b"\xef\xbb\xbfx",), (b"",), (None,)], "content binary")
    assert [r.t for r in rows.select(archives.text_of_bytes(rows.content).alias("t")).collect()] == ["Текст", "Текст", "x", "", None]


def test_archive_to_entities(spark, tmp_path):
    args = '<p class="V8SH_chapter">Параметры:</p><div class="V8SH_rubric"><p>&lt;Что&gt;</p></div>Тип: Число. Что.<p class="V8SH_chapter">Возвращаемое значение:</p>Тип: Число.<p class="V8SH_chapter">Доступность: </p>Сервер, Клиент.'
    pages = {
        "objects/array.html": _page("Массив (Array)", text="Список"),
        "objects/catalog.html": _page("СправочникМенеджер.&lt;Имя&gt; (CatalogManager)"),
        "objects/array/methods/find.html": _page("Массив.Найти (Array.Find)", "Массив (Array)", more=args),
        "objects/cat/methods/get.html": _page("Найти (Find)", "СправочникМенеджер"),
        "objects/lost/methods/x.html": _page("Х (X)", "Нет такого"),
        "objects/array/properties/size.html": _page("Массив.Размер (Array.Size)", "Массив (Array)", more='<p class="V8SH_chapter">Возвращаемое значение:</p>Тип: Число.'),
        "objects/cat/properties/y.html": _page("У (Y)", "Справочник"),
        "functions/msg.html": _page("Функция Сообщить (Message)"),
        "Global context/methods/do.html": _page("Сделать (Do)"),
        "tables/t.html": _page("Таблица"),
        "empty.html": "<p>nothing</p>",
    }
    with zipfile.ZipFile(tmp_path / "shcntx.hbk", "w") as z:
        for name, html in pages.items():
            z.writestr(name, html.encode("cp1251" if "array" in name else "utf-8"))
    with zipfile.ZipFile(tmp_path / "shlang.hbk", "w") as z:
        z.writestr("def_String", _page("Строка", text="Текст"))
        z.writestr("Pragma", "<STRONG>&amp;НаКлиенте (&amp;AtClient)</STRONG><strong>&amp;НаСервере</strong><strong>&amp;НаСервере</strong><strong>нет</strong>")
    got = syntax_db.extract(spark, str(tmp_path), "8.3")
    by = {r.id: r for r in got.collect()}
    assert set(by) == {"Массив", "СправочникМенеджер.<Имя>", "String", "Global"}
    one = by["Массив"]
    assert (one.english_name, one.documentation, one.entity_type, one.source.version, one.entity_kind) == ("Array", "Список", "Platform", "8.3", "Array")
    find = one.interface.methods["Найти"]
    assert (find.return_type, find.is_function, find.availability, [(p.name, p.type_name) for p in find.parameters]) == ("Число", True, ["Server", "Client"], [("Что", "Число")])
    assert one.interface.properties["Размер"].type_name == "Число"
    assert set(by["СправочникМенеджер.<Имя>"].interface.methods) == {"Найти"} and not by["СправочникМенеджер.<Имя>"].interface.properties
    assert set(by["Global"].interface.methods) == {"Функция Сообщить", "Сделать"} and by["String"].entity_kind == "Primitive"
    words = syntax_db.directives(archives.read_pages(spark, str(tmp_path)))
    assert {r.directive for r in words.collect()} == {"&НаКлиенте", "&AtClient", "&НаСервере"} and words.count() == 3
    entities.write_jsonl(got, f"{tmp_path}/out", version="8.3")
    assert entities.method_rows(entities.read_jsonl(spark, f"{tmp_path}/out")).count() == 4
