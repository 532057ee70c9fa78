"""Bodies of routines, and reports read by sessions of lines."""

import random

from tessera.operators import incremental
from tessera.sources import reports, tokens

MODULE = "path string, text string"


def test_bodies(spark):
    text = 'Перем А;\nПроцедура П(\n  А,\n  Б = ")") Экспорт\n  А = Ф(1); // КонецПроцедуры\n  Сообщить("КонецПроцедуры");\nКонецПроцедуры\n\nФункция Ф(А) Возврат А;\nКонецФункции\nFunction Open(x)\n y = 1;\nПроцедура Конец() КонецПроцедуры\nКонецФункции'
    df = spark.createDataFrame([("m", text), ("m", text), (None, "нет"), ("n", None)], MODULE)
    got = {r.name: (r.kind, r.is_export, r.is_closed, r.body) for r in tokens.bodies(df).collect()}
    assert got == {
        "П": ("procedure", True, True, 'А = Ф(1); // КонецПроцедуры\n  Сообщить("КонецПроцедуры");'),
        "Ф": ("function", False, True, "Возврат А;"),
        "Open": ("function", False, False, "y = 1;"),
        "Конец": ("procedure", False, True, ""),
    }
    bodies = tokens.bodies(df).selectExpr("path doc_id", "kind", "name", "body")
    changed = tokens.bodies(spark.createDataFrame([("m", text.replace("Ф(1)", "Ф(2)"))], MODULE)).selectExpr("path doc_id", "kind", "name", "body")
    rebuilt = incremental.rebuilt(bodies, bodies.join(changed, ["doc_id", "kind", "name", "body"], "left_anti"), changed)
    assert {r.name for r in rebuilt.where("rebuilt").collect()} == {"П"}
    assert tokens.bodies(spark.createDataFrame([], MODULE)).collect() == []


def _plain(text):
    """[(line, name, type, attributes, properties)] by going through the lines."""
    lines, out, now = [x.strip() for x in text.split("\n")], [], None
    for i, line in enumerate(lines):
        if line.startswith("-") and "." in line:
            name = line.lstrip("-").strip()
            if ".Реквизиты." not in name and ".ТабличныеЧасти." not in name:
                kind = next((v for k, v in reports.TYPES.items() if k + "." in name), None)
                if kind:
                    now = (i + 1, name, kind, [], {})
                    out.append(now)
            elif now and ".Реквизиты." in name and len(name.split(".")) >= 4:
                found = "Неизвестный"
                for later in lines[i + 1 : i + 10]:
                    if later.startswith("Тип:"):
                        found = later[4:].strip()
                        break
                    if later.startswith("-"):
                        break
                now[3].append((i + 1, name.split(".")[3], found))
        elif not line.startswith("-") and now and ":" in line:
            key, value = (x.strip() for x in line.split(":", 1))
            if value.strip('"') and key != "Тип":
                now[4][key] = value.strip('"')
    return out


def test_reports(spark):
    rng = random.Random(2)
    choices = ["- Справочники.Товары", "-- Документы.Заказ", "- Прочее.Х", "- Справочники.Товары.Реквизиты.Код", "- Справочники.Товары.ТабличныеЧасти.Строки.Реквизиты.Цена", "- Документы.Заказ.ТабличныеЧасти.Т", "Тип: Число", 'Имя: "Товар"', "Имя: Другое", "Пусто:", "- просто", "текст", "", "Тип: Строка, 10", "а: б: в"]
    texts = ["\n".join(rng.choice(["", "  "]) + rng.choice(choices) for _ in range(rng.randrange(80))) for _ in range(40)]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] + [("none", None)], MODULE)
    found = reports.objects(df)
    got = {}
    for r in found.collect():
        got.setdefault(r.path, []).append((r.line, r.name, r.type, [(a.line, a.name, a.type) for a in r.attributes], dict(r.properties)))
    assert {p: sorted(v, key=lambda x: x[0]) for p, v in got.items()} == {str(i): _plain(t) for i, t in enumerate(texts) if _plain(t)}
    whole = [x for t in texts for x in _plain(t)]
    stats = {r.type: (r.objects, r.attributes) for r in reports.statistics(found).collect()}
    assert stats[None] == (len(whole), sum(len(x[3]) for x in whole))
    assert stats["Документ"] == (sum(x[2] == "Документ" for x in whole), sum(len(x[3]) for x in whole if x[2] == "Документ"))
