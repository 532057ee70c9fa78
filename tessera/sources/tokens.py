"""Modules as rows of tokens, and what brackets and statements say: calls with their own arguments, and assignments.

A module's text is cut into tokens by one expression: strings, comments and dates are tokens, so nothing in
them counts; dotted names are one token; all else is a sign. How deep a token lies in brackets is a running
sum over the tokens of its statement, and the tokens of one pair of brackets are those of one depth between
two openings of that depth. Statements end at semicolons, where depth begins anew, so one bracket too many spoils no
more than its own statement. Everything is windows over (module, statement) rows; no text is parsed by a UDF.

Modules are told apart by path and text: the same row twice is one module. Null texts have no token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NAME = "[\\w\\u0400-\\u04FF]+"
_PATH = f"\\.?{NAME}(?:[\\x20\\t]*\\.[\\x20\\t]*{NAME})*+"
#: Strings with doubled quotes, comments, dates, dotted names, blanks, and any other sign; together they cover a text.
TOKEN = f'"[^"]*+(?:""[^"]*+)*+"?|//[^\\n]*+|\'[^\'\\n]*+\'?|{_PATH}|\\s++|[^\\s]'
# Words of the script language, in both its languages, lower-cased.
HEADERS = ("процедура", "функция", "procedure", "function")
ENDS = ("конецпроцедуры", "конецфункции", "endprocedure", "endfunction")
NEW = ("новый", "new")
EXPORT = ("экспорт", "export")
BEFORE_STATEMENT = ("тогда", "иначе", "цикл", "попытка", "исключение", "then", "else", "do", "try", "except", *EXPORT)
BY_VALUE = ("знач", "val")
NOT_CALLED = (
    "если", "иначеесли", "пока", "для", "каждого", "из", "по", "возврат", "и", "или", "не", "тогда", "цикл", "перем",
    "if", "elsif", "while", "for", "each", "in", "to", "return", "and", "or", "not", "then", "do", "var",
)
_ROW = ("path", "module")
_ANY = f'"[^"]*+(?:""[^"]*+)*+"?|//[^\\n]*+|\'[^\'\\n]*+\'?|{_PATH}|\\s++'
#: A text up to its next bracket, comma or semicolon outside strings and comments, that sign included; the last has none.
PIECE = f"(?:{_ANY}|[^\\s();,])*+[();,]?"


def _is(word: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower(word).isin(*words), F.lit(False))


def tokens(modules: DataFrame) -> DataFrame:
    """(path, module, k, at, token): tokens of each module in order with their offsets, without blanks and comments. module: a hash of the text."""
    rows = modules.select("path", F.xxhash64("text").alias("module"), "text").dropDuplicates(["path", "module"])
    cut = rows.select(*_ROW, F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("k", "token"))
    before = Window.partitionBy(*_ROW).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("at", F.coalesce(F.sum(F.length("token")).over(before), F.lit(0)))
    return placed.where(~(F.trim("token", F.lit(" \t\r\n\x0b\x0c")) == "") & ~F.startswith("token", F.lit("//"))).select(*_ROW, "k", "at", "token")


def statements(modules: DataFrame) -> DataFrame:
    """tokens with `statement` (semicolons before it), `depth` (brackets it lies in; those of a pair lie in it), the tokens before and after it, and `scope`, the routine it is in."""
    order = Window.partitionBy(*_ROW).orderBy("k")
    upto, past = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, -1)
    t = F.col("token")
    rows = tokens(modules).withColumns({"before": F.lag("token").over(order), "after": F.lead("token").over(order), "statement": F.coalesce(F.count_if(t == ";").over(past), F.lit(0))})
    rows = rows.withColumn("_head", F.when(_is(F.col("before"), HEADERS), t).when(_is(F.col("before"), ENDS), ""))
    rows = rows.withColumn("scope", F.nullif(F.last("_head", ignorenulls=True).over(upto), F.lit("")))
    inside = Window.partitionBy(*_ROW, "statement").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    depth = F.count_if(t == "(").over(inside) - F.count_if(t == ")").over(inside) + (t == ")").cast("int")
    return rows.withColumn("depth", depth).drop("_head")


def _signs(modules: DataFrame) -> DataFrame:
    """Brackets, commas and semicolons alone, with what `calls` asks of the tokens about them: a row for each instead of for each token.

    path, module, k, at, token, statement, depth, scope, before and _before_head (the two tokens before an opening bracket, as far as they are
    after the sign before), and after (for a bracket that is closed at once).
    """
    rows = modules.select("path", F.xxhash64("text").alias("module"), "text").dropDuplicates(["path", "module"])
    cut = rows.select(*_ROW, F.posexplode(F.regexp_extract_all("text", F.lit(PIECE), F.lit(0))).alias("k", "piece"))
    own = F.filter(F.regexp_extract_all("piece", F.lit(TOKEN), F.lit(0)), lambda t: ~(F.trim(t, F.lit(" \t\r\n\x0b\x0c")) == "") & ~F.startswith(t, F.lit("//")))
    cut = cut.select(*_ROW, "k", F.length("piece").alias("length"), own.alias("own"))
    at = lambda i: F.try_element_at("own", F.lit(i))
    # a word before the last tells that the last names a routine, or that none is open any more
    heads = F.filter(F.transform("own", lambda t, i: F.when(_is(F.get("own", i - 1), HEADERS), t).when(_is(F.get("own", i - 1), ENDS), "")), lambda t: t.isNotNull())
    opens = at(-1) == "("
    cut = cut.select(
        *_ROW, "k", "length", at(-1).alias("token"), F.when(opens, at(-2)).alias("before"), F.when(opens, at(-3)).alias("_before_head"),
        F.when(F.size("own") == 1, at(1)).alias("_alone"), F.try_element_at(heads, F.lit(-1)).alias("_head"),
    )
    order = Window.partitionBy(*_ROW).orderBy("k")
    upto, past = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, -1)
    t = F.col("token")
    # the piece after a sign that has but a sign of its own begins with it
    placed = cut.withColumns({"at": F.sum("length").over(upto) - 1, "after": F.lead("_alone").over(order), "statement": F.coalesce(F.count_if(t == ";").over(past), F.lit(0)), "scope": F.nullif(F.last("_head", ignorenulls=True).over(upto), F.lit(""))})
    placed = placed.where(t.isin("(", ")", ",", ";"))
    inside = Window.partitionBy(*_ROW, "statement").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    depth = F.count_if(t == "(").over(inside) - F.count_if(t == ")").over(inside) + (t == ")").cast("int")
    return placed.withColumn("depth", depth).select(*_ROW, "k", "at", "token", "statement", "depth", "scope", "before", "_before_head", "after")


def calls(modules: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Calls with brackets: path, module, scope, pos (offset of its bracket), close (that of the other), object, member, kind, n_args and cuts (offsets between which arguments lie).

    kind is method (`object.member(...)`; of what another call returns, object is null), function or new (`New T(...)`). Calls within arguments
    and over several lines count; routine headers, brackets of expressions and keywords don't, nor brackets that aren't closed.
    found: what `statements` gives for the modules, if it is there already.
    """
    rows = _signs(modules) if found is None else found.withColumn("_before_head", F.lag("before").over(Window.partitionBy(*_ROW).orderBy("k")))
    rows = rows.where(F.col("token").isin("(", ",", ")"))
    order = Window.partitionBy(*_ROW, "statement", "depth").orderBy("k")
    t = F.col("token")
    rows = rows.withColumn("pair", F.count_if(t == "(").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.where(F.col("pair") > 0)
    opened = lambda c: F.max(F.when(t == "(", F.col(c)))  # noqa: E731  one row of a pair opens it
    at = F.array_sort(F.collect_list(F.when((t != ")"), F.col("at"))))
    got = rows.groupBy(*_ROW, "statement", "depth", "pair").agg(
        opened("scope").alias("scope"), opened("at").alias("pos"), F.min(F.when(t == ")", F.col("at"))).alias("close"), opened("before").alias("head"),
        opened("_before_head").alias("word"), opened("after").alias("first"), at.alias("marks"), F.min(F.when(t == ")", F.col("k"))).alias("_k"),
    )
    # after a pair is closed, commas at its depth belong to no pair
    got = got.withColumn("marks", F.filter("marks", lambda x: x < F.col("close")))
    name = F.regexp_replace("head", "[\\x20\\t]", "")
    last = F.substring_index(name, ".", -1)
    owner = F.left(name, F.length(name) - F.length(last) - 1)
    is_name = F.regexp_like("head", F.lit(f"^{_PATH}$")) & ~F.regexp_like("head", F.lit("^\\.?[0-9]"))
    made = _is(F.col("word"), NEW)
    kind = F.when(made, "new").when(F.contains(name, F.lit(".")), "method").otherwise("function")
    keep = F.col("close").isNotNull() & is_name & ~_is(F.col("word"), HEADERS) & ~_is(name, (*NOT_CALLED, *NEW))
    n = F.when(F.col("first") == ")", 0).otherwise(F.size("marks"))
    cuts = F.when(n > 0, F.concat(F.col("marks"), F.array("close"))).otherwise(F.array().cast("array<long>"))
    return got.where(keep).select(*_ROW, "scope", "pos", "close", F.when(kind == "method", F.nullif(owner, F.lit(""))).alias("object"), F.when(kind == "new", name).otherwise(last).alias("member"), kind.alias("kind"), n.alias("n_args"), cuts.alias("cuts"))


def with_arguments(modules: DataFrame, found: DataFrame) -> DataFrame:
    """Calls (`found`, of the same modules) with `arguments`, the texts of their arguments in order; one left out is empty."""
    rows = modules.select("path", F.xxhash64("text").alias("module"), "text").dropDuplicates(["path", "module"])
    same = F.col("_path").eqNullSafe(F.col("path")) & (F.col("_module") == F.col("module"))
    own = rows.select(F.col("path").alias("_path"), F.col("module").alias("_module"), "text")
    # the calls of a module come together as numbers before they meet its text
    lists = found.groupBy(*_ROW).agg(F.collect_list(F.struct(*(c for c in found.columns if c not in _ROW))).alias("calls"))
    each = lists.join(own, same).select(*_ROW, "text", F.explode("calls").alias("c"))
    cut = F.transform(F.slice("c.cuts", 1, F.greatest(F.size("c.cuts") - 1, F.lit(0))), lambda x, i: F.trim(F.substring("text", (x + 2).cast("int"), (F.get("c.cuts", i + 1) - x - 1).cast("int")), F.lit(" \t\r\n")))
    return each.select(*_ROW, "c.*", cut.alias("arguments"))


def arguments(modules: DataFrame, found: DataFrame) -> DataFrame:
    """(path, module, pos, place, argument): texts of the arguments of calls (`found`, of the same modules); an argument left out is empty."""
    return with_arguments(modules, found.where("n_args > 0")).select(*_ROW, "pos", F.posexplode("arguments").alias("place", "argument"))


def assignments(modules: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(path, module, scope, name, pos, value): `name = value` statements, with the text of the value up to the end of the statement."""
    rows = statements(modules) if found is None else found
    order = Window.partitionBy(*_ROW, "statement").orderBy("k")
    starts = F.col("before").isNull() | F.col("before").isin(";", ")") | _is(F.col("before"), (*BEFORE_STATEMENT, *ENDS)) | _is(F.lag("before").over(order), HEADERS)
    target = F.regexp_like("token", F.lit(f"^{NAME}$")) & ~F.regexp_like("token", F.lit("^[0-9]")) & (F.col("after") == "=") & (F.col("depth") == 0) & starts & ~_is(F.col("token"), NOT_CALLED)
    rows = rows.withColumn("_name", F.when(target, F.struct(F.col("token").alias("name"), F.col("at").alias("pos"), F.col("k").alias("k"))))
    rows = rows.withColumn("_name", F.last("_name", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.where(F.col("_name").isNotNull() & (F.col("token") != ";") & (F.col("k") > F.col("_name.k")))
    groups = rows.groupBy(*_ROW, "statement", "_name").agg(F.max("scope").alias("scope"), F.array_sort(F.collect_list(F.struct("k", "token"))).alias("parts"))
    tight = F.array_join(F.transform(F.slice("parts", 2, F.size("parts")), lambda x: F.when(_is(x["token"], NEW), F.concat(x["token"], F.lit(" "))).otherwise(x["token"])), "")
    return groups.select(*_ROW, "scope", F.col("_name.name").alias("name"), F.col("_name.pos").alias("pos"), tight.alias("value"))


def bodies(modules: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Routines with their bodies: path, module, pos (offset of the name), kind, name, is_export, is_closed and body, the text between the header and the word that ends it.

    A header is matched with the first ending word before the next header; without one the body goes on to that header or the end of the text.
    """
    rows = statements(modules) if found is None else found
    upto = Window.partitionBy(*_ROW).orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = F.col("token")
    begins = _is(t, HEADERS)
    kind = F.when(F.lower("before").isin("функция", "function"), "function").otherwise("procedure")
    head = F.when(_is(F.col("before"), HEADERS) & F.regexp_like(t, F.lit(f"^{NAME}$")), F.struct(F.col("at").alias("pos"), t.alias("name"), kind.alias("kind")))
    exported = F.when(_is(t, EXPORT) & (F.col("before") == ")"), F.col("at") + F.length(t))
    # the word of the next header belongs to it, not to the routine before; most tokens tell nothing of routines
    rows = rows.select(*_ROW, "at", "token", "after", F.when(~begins, head).alias("head"), begins.alias("begins"), exported.alias("exported"), F.count_if(begins).over(upto).alias("nth"))
    rows = rows.where((F.col("nth") > 0) & (F.col("begins") | F.col("head").isNotNull() | (t == ")") | _is(t, ENDS) | F.col("exported").isNotNull()))
    groups = rows.groupBy(*_ROW, "nth").agg(F.max("head").alias("head"), F.min(F.when(F.col("begins"), F.col("at"))).alias("begun"), F.min(F.when(t == ")", F.struct("at", "after"))).alias("close"), F.min(F.when(_is(t, ENDS), F.col("at"))).alias("stop"), F.min("exported").alias("exported"))
    spans = groups.withColumn("next", F.lead("begun").over(Window.partitionBy(*_ROW).orderBy("nth"))).where("head is not null")
    export = _is(F.col("close.after"), EXPORT)
    start = F.when(export, F.col("exported")).otherwise(F.coalesce(F.col("close.at") + 1, F.col("head.pos") + F.length("head.name")))
    spans = spans.select(*_ROW, "head.*", export.alias("is_export"), F.col("stop").isNotNull().alias("is_closed"), start.alias("start"), F.coalesce("stop", "next").alias("stop"))
    own = modules.select(F.col("path").alias("_path"), F.xxhash64("text").alias("_module"), "text").dropDuplicates(["_path", "_module"])
    got = spans.join(own, F.col("_path").eqNullSafe(F.col("path")) & (F.col("_module") == F.col("module")))
    body = F.substring("text", (F.col("start") + 1).cast("int"), (F.coalesce("stop", F.length("text").cast("long")) - F.col("start")).cast("int"))
    return got.select(*_ROW, "pos", "kind", "name", "is_export", "is_closed", F.trim(body, F.lit(" \t\r\n")).alias("body"))
