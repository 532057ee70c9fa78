"""Calls, arguments, assignments and types from module texts, against plain versions that go through a text sign by sign."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import call_check
from tessera.sources import modules, tokens

MODULE = "path string, text string"


def _calls(text):
    """[(object, member, kind, arguments)] of a text, by a stack."""
    word = re.compile(r"\.?[\wЀ-ӿ]+(?:[ \t]*\.[ \t]*[\wЀ-ӿ]+)*")
    out, stack, i, path, before = [], [], 0, None, None
    while i < len(text):
        c = text[i]
        if c == '"':
            j = i + 1
            while j < len(text) and (text[j] != '"' or text[j + 1 : j + 2] == '"'):
                j += 1 + (text[j] == '"')
            i, path, before = j + 1, None, '"'
            continue
        if text.startswith("//", i):
            i = (text + "\n").index("\n", i)
            continue
        m = word.match(text, i)
        if m:
            path, before, i = (m[0].replace(" ", "").replace("\t", ""), before if path is None else path), m[0], m.end()
            continue
        if c == "(":
            stack.append([path, i, [], i + 1])
        elif c == "," and stack:
            stack[-1][2].append(text[stack[-1][3] : i])
            stack[-1][3] = i + 1
        elif c == ")" and stack:
            head, at, args, begun = stack.pop()
            args.append(text[begun:i])
            if len(args) == 1 and not re.sub(r"//[^\n]*", "", args[0]).strip():
                args = []
            if head:
                name, word_before = head
                word_before = (word_before[0] if isinstance(word_before, tuple) else word_before) or ""
                low = name.lower()
                if word_before.lower() not in tokens.HEADERS and low not in tokens.NOT_CALLED + tokens.NEW and not name[:1].isdigit() and not re.match("^[0-9.]", name.lstrip(".")):
                    new = word_before.lower() in tokens.NEW
                    obj, _, member = name.rpartition(".")
                    out.append((at, None if new or "." not in name or not obj else obj, name if new else member, "new" if new else "method" if "." in name else "function", [a.strip() for a in args]))
        elif c == ";":
            stack = []
        if not c.isspace():
            before, path = c, None
        i += 1
    return sorted(out, key=lambda x: x[0])


def _got(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "path int, text string")
    found = tokens.calls(df)
    args = {}
    for r in tokens.arguments(df, found).collect():
        args.setdefault((r.path, r.pos), {})[r.place] = r.argument
    out = {i: [] for i, _ in enumerate(texts)}
    for r in sorted(found.collect(), key=lambda r: r.pos):
        own = args.get((r.path, r.pos), {})
        assert len(own) == r.n_args
        out[r.path].append((r.pos, r.object, r.member, r.kind, [own[k] for k in range(r.n_args)]))
    return out


CASES = [
    'Сообщить("a, b(c)"); // Foo(1)',
    "А = f(g(1), 2);",
    "Процедура П(А, Б) Экспорт\n  А.Добавить(\n    1, // один, (два\n    Х(2),\n    );\nКонецПроцедуры",
    'Если (А = 1) И Ф(Б) Тогда Возврат (1 + (2)); КонецЕсли; Новый Массив(10); Б = Новый Структура("а, б", 1);',
    "а.б.в(1).г(2, 3)().д();",
    'f("x ""(y)"" z", \'20240101\');',
    "f(1;g(2);h(3));(4);k()",
    "f());g(1,2)",
    'f("never closed (1, 2); g(3)',
    "ф ( ) ; ф\n(1)\n;",
    "",
    None,
    "1.5(2); .5(3)",
]


def test_calls(spark):
    got = _got(spark, CASES)
    assert [[c[1:] for c in got[i]] for i in range(2)] == [[(None, "Сообщить", "function", ['"a, b(c)"'])], [(None, "f", "function", ["g(1)", "2"]), (None, "g", "function", ["1"])]]
    for i, text in enumerate(CASES):
        assert got[i] == _calls(text or ""), text


def test_calls_of_random_texts(spark):
    rng = random.Random(4)
    signs = ["f", "g.h", "(", "(", ")", ")", ",", ";", '"s, ("', "// c (\n", " ", "\n", "1", "Новый ", "Если ", "Процедура ", ".m", "+", "="]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(300)]
    got = _got(spark, texts)
    for i, text in enumerate(texts):
        assert got[i] == _calls(text), text


def test_scopes_and_repeated_rows(spark):
    text = "Функция Ф()\n Возврат g(1);\nКонецФункции\nh(2);\nПроцедура П() k(3); КонецПроцедуры"
    df = spark.createDataFrame([("a", text), ("a", text), (None, text), ("a", "m()")], MODULE)
    rows = {(r.path, r.member, r.scope) for r in tokens.calls(df).collect()}
    assert rows == {(p, m, s) for p in ("a", None) for m, s in (("g", "Ф"), ("h", None), ("k", "П"))} | {("a", "m", None)}
    assert tokens.calls(df).count() == 7 and tokens.calls(spark.createDataFrame([], MODULE)).count() == 0


def test_assignments(spark):
    text = "Процедура П()\n  А = Новый Массив;\n Если А = 1 Тогда Б = А . Копия(1, \"x;\"); КонецЕсли; В = f(Г = 1);\n К.Л = 2; // Д = 3;\nКонецПроцедуры\nЕ = 5"
    rows = tokens.assignments(spark.createDataFrame([("m", text)], MODULE)).orderBy("pos").collect()
    assert [(r.scope, r.name, r.value) for r in rows] == [("П", "А", "Новый Массив"), ("П", "Б", 'А . Копия(1,"x;")'), ("П", "В", "f(Г=1)"), (None, "Е", "5")]
    assert [text[r.pos] for r in rows] == ["А", "Б", "В", "Е"]


MEMBERS = "type string, member string, least int, most int, returns string, availability array<string>, is_deprecated boolean, deprecation string"
RETURNS = {("T", "m"): "U", ("U", "m"): "T", ("T", "n"): "Число", ("Число", "k"): "T"}


def _typed(rows, index):
    """{(scope, name, pos): type} by going through each scope in order."""
    held, out = {}, {}
    for scope, name, pos, value in sorted(rows, key=lambda r: (str(r[0]), r[2])):
        def of(head):
            return held.get((scope, head)) or index.get(head)
        kind = None
        if re.fullmatch(r"-?\d+", value):
            kind = "Число"
        elif m := re.match(r"New (\w+)", value):
            kind = m[1]
        elif m := re.fullmatch(r"(\w+)\.(\w+)(\(.*)?", value):
            kind = RETURNS.get((of(m[1]) or m[1], m[2]))
        elif re.fullmatch(r"\w+", value):
            kind = of(value)
        if kind:
            held[scope, name] = out[scope, name, pos] = kind
    return out


def _inferred(spark, rows, index=()):
    members = spark.createDataFrame([(t, m, 0, 1, r, [], False, None) for (t, m), r in RETURNS.items()], MEMBERS)
    names = spark.createDataFrame([(n, 0, t) for n, t in dict(index).items()], "name string, tier int, id string")
    got = call_check.assigned_types(spark.createDataFrame(rows, "scope string, name string, pos int, value string"), names, members)
    return {(r.scope, r.name, r.pos): r.type for r in got.collect()}


def test_types_of_a_chain(spark):
    text = "a=1; p=New T; q=p; r=q; a=r; b=a; c=b; d=c"
    rows = [("s", *x.strip().split("=")) for x in text.split(";")]
    rows = [(s, n, i, v) for i, (s, n, v) in enumerate(rows)]
    got = _inferred(spark, rows)
    assert {n: t for (_, n, p), t in got.items() if p} == dict.fromkeys("pqrabcd", "T") and got["s", "a", 0] == "Число"
    read = tokens.assignments(spark.createDataFrame([("m", text)], MODULE))
    assert {(r.name, r.value) for r in read.collect()} == {(n, v) for _, n, _, v in rows}


@pytest.mark.parametrize("seed", range(1))
def test_types_against_a_walk(spark, seed):
    rng = random.Random(seed)
    rows = []
    for scope in [None, "s", "t", "u"]:
        for pos in range(60):
            names = "abcdeX"
            value = rng.choice(["1", "New T", "New U", rng.choice(names), rng.choice(names), rng.choice(names) + "." + rng.choice("mnkz"), rng.choice(names) + "." + rng.choice("mnk") + "(1)", "x + 1", "W", "W.m", "V.m()"])
            rows.append((scope, rng.choice(names), pos, value))
    index = {"W": "T", "X": "U"}
    assert _inferred(spark, rows + rows[:20], index) == _typed(rows, index)


def test_types_of_long_chains(spark):
    rows = [("s", "v0", 0, "New T")] + [("s", f"v{i}", i, f"v{i - 1}") for i in range(1, 1000)]
    rows += [("u", f"v{i}", i, f"v{i - 1}") for i in range(1, 400)]  # starts from nothing: none has a type
    rows += [("h", "hot", 2 * i, "New T" if i % 3 else "hot.m()") for i in range(2000)] + [("h", f"x{i}", 4 * i + 1, "hot") for i in range(1000)]
    assert _inferred(spark, rows) == _typed(rows, {})


def test_calls_of_modules_to_problems(spark):
    text = "Процедура П()\n А = Новый Массив; Б = А;\n Б.Добавить(f(1), 2);\n Б.Нет();\n Сообщить(П2(1));\n В.Х();\n Найти(1);\nКонецПроцедуры\nФункция П2(А) Возврат А; КонецФункции"
    m = spark.createDataFrame([("m", text)], MODULE)
    found = tokens.statements(m)
    calls = tokens.calls(m, found).withColumn("call_id", F.col("pos")).withColumn("scope", F.concat_ws("#", "path", "scope"))
    written = tokens.assignments(m, found).withColumn("scope", F.concat_ws("#", "path", "scope"))
    members = [("Массив", "Массив.Добавить", 1), ("Массив", "Добавить", 1), ("Массив", "Копия", 0)]
    none = spark.createDataFrame([], "name string, tier int, id string")
    types = call_check.assigned_types(written, none, spark.createDataFrame([], MEMBERS))
    typed = call_check.typed_calls(calls, types)
    got = {r.member: r.problem for r in call_check.method_problems(typed.where("kind = 'method'"), spark.createDataFrame(members, "type string, member string, parameters int")).collect()}
    assert got == {"Добавить": "wrong_count", "Нет": "unknown_method"}
    functions = spark.createDataFrame([("сообщить",)], "word string")
    lost = call_check.unknown_functions(calls, modules.routines(m), functions)
    assert {r.member for r in lost.collect()} == {"f", "Найти"}


def test_types_store_nothing_of_the_assignments(spark, monkeypatch):
    """Writes that turn out to have no type, one behind the other, cost no round: only the heads and what members return are stored."""
    names, put = [], call_check.stored
    monkeypatch.setattr(call_check, "stored", lambda df, name: names.append(name) or put(df, name))
    rows = [("s", "a", 0, "New T")] + [("s", "a", i, f"{'a' if i % 2 else 'b'}.z()") for i in range(1, 9)] + [("s", "c", 9, "a"), ("s", "d", 10, "c.m()"), ("s", "e", 10, "d")]
    assert _inferred(spark, rows) == {("s", "a", 0): "T", ("s", "c", 9): "T", ("s", "d", 10): "U"}
    assert sorted(names) == ["heads", "results"]


def test_calls_sort_signs_alone(spark):
    """A row for each bracket, comma and semicolon, none for each word; modules are cut once for calls and arguments."""
    text = "word " * 500 + "f(a, 'x(', g());" + " // h(1)\n" + "word " * 500
    df = spark.createDataFrame([("m", text)], MODULE)
    assert [r.token for r in tokens._signs(df).orderBy("k").collect()] == ["(", ",", ",", "(", ")", ")", ";"]
    rows = tokens.with_arguments(df, tokens.calls(df)).collect()
    assert {(r.member, r.pos, tuple(r.arguments)) for r in rows} == {("f", 2501, ("a", "'x('", "g()")), ("g", 2512, ())}


def test_bodies_look_at_no_rest_of_a_text(spark, capsys):
    """No window looks at all that follows, which takes the square of a text's tokens."""
    df = spark.createDataFrame([("m", "Процедура А() x; КонецПроцедуры Функция Процедура Б() Экспорт y; Процедура В")], MODULE)
    got = tokens.bodies(df)
    assert {(r.name, r.body, r.is_export, r.is_closed) for r in got.collect()} == {("А", "x;", False, True), ("Б", "y;", True, False), ("В", "", False, False)}
    got.explain()
    assert "unboundedfollowing" not in capsys.readouterr().out.lower()
