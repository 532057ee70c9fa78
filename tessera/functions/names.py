"""Column functions over names: bilingual names, qualified names, completion tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_name(display: Column) -> Column:
    """A of "A (B)"; null for other names."""
    return F.nullif(F.regexp_extract(display, "^(.*?) \\((.*)\\)", 1), F.lit(""))


def second_name(display: Column) -> Column:
    """B of "A (B)"; null for other names."""
    return F.nullif(F.regexp_extract(display, "^(.*?) \\((.*)\\)", 2), F.lit(""))


def is_cyrillic(name: Column) -> Column:
    return F.regexp_like(name, F.lit("[\\u0400-\\u04FF]"))


def short_name(name: Column) -> Column:
    """What follows the last dot."""
    return F.substring_index(name, ".", -1)


def root_name(name: Column) -> Column:
    """What precedes the first dot."""
    return F.substring_index(name, ".", 1)


def object_of_title(title: Column) -> Column:
    """Text before the first dot, else before " (", else the whole title."""
    return F.when(F.instr(title, ".") > 0, F.substring_index(title, ".", 1)).when(F.instr(title, " (") > 0, F.substring_index(title, " (", 1)).otherwise(title)


def completion_token(line: Column) -> Column:
    """The word that a line ends in."""
    return F.regexp_extract(line, "[\\w\\u0400-\\u04FF]+$", 0)


def method_signature(name: Column, parameters: Column, returns: Column, untyped: str) -> Column:
    """`name(p: T, q: U) -> R` from array<struct<name,type_name>>; a missing type is `untyped`."""
    args = F.array_join(F.transform(parameters, lambda p: F.concat(p["name"], F.lit(": "), F.coalesce(p["type_name"], F.lit(untyped)))), ", ")
    return F.concat(name, F.lit("("), args, F.lit(")"), F.coalesce(F.concat(F.lit(" -> "), returns), F.lit("")))


def insert_text(name: Column, parameters: Column) -> Column:
    """`name(${0:p}, ${1:q})` from an array of parameter names."""
    args = F.transform(parameters, lambda p, i: F.concat(F.lit("${"), i.cast("string"), F.lit(":"), p, F.lit("}")))
    return F.concat(name, F.lit("("), F.array_join(args, ", "), F.lit(")"))


def display_text(name: Column, parameters: Column, returns: Column, deprecated: Column) -> Column:
    """`name(p: T, [q: U]) -> R [DEPRECATED]` from array<struct<name,type_name,is_optional>>; a missing type is `?`."""
    one = lambda p: F.concat(p["name"], F.lit(": "), F.coalesce(p["type_name"], F.lit("?")))
    args = F.array_join(F.transform(parameters, lambda p: F.when(p["is_optional"], F.concat(F.lit("["), one(p), F.lit("]"))).otherwise(one(p))), ", ")
    return F.concat(name, F.lit("("), args, F.lit(") -> "), F.coalesce(returns, F.lit("?")), F.when(deprecated, F.lit(" [DEPRECATED]")).otherwise(""))


def word_at(line: Column, column: Column) -> Column:
    """The word around a place (from 0) of a line; empty where there is none."""
    left = F.regexp_extract(F.substring(line, F.lit(1), column), "[\\w\\u0400-\\u04FF]*$", 0)
    return F.concat(left, F.regexp_extract(F.substring(line, column + 1, F.length(line)), "^[\\w\\u0400-\\u04FF]*", 0))


def binary_type(operator: Column, left: Column, right: Column) -> Column:
    """The type of a sum of numbers; others are unknown."""
    return F.when((operator == "+") & (left == "Число") & (right == "Число"), "Число").otherwise("Unknown")


def unary_type(operator: Column, operand: Column) -> Column:
    """Boolean for a negation, else the operand's type."""
    return F.when(operator.isin("Не", "Not"), "Булево").otherwise(operand)


def value_type(literal: Column) -> Column:
    """The type name that the text of a literal stands for; null for other expressions."""
    return (
        F.when(F.regexp_like(literal, F.lit('^".*"$')), F.lit("Строка"))
        .when(literal.isin("Истина", "Ложь", "True", "False"), F.lit("Булево"))
        .when(F.regexp_like(literal, F.lit("^-?[0-9]+([.][0-9]+)?$")), F.lit("Число"))
        .when(F.regexp_like(literal, F.lit("^'[0-9]+'$")), F.lit("Дата"))
        .when(literal.isin("Неопределено", "Undefined"), F.lit("Неопределено"))
        .when(literal == "Null", F.lit("Null"))
    )


def to_uri(path: Column) -> Column:
    """A path as a URI: slashes, and file:/// before an absolute one."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    drive = F.regexp_like(slashed, F.lit("^[A-Za-z]:/"))
    return F.when(drive, F.concat(F.lit("file:///"), slashed)).when(F.startswith(slashed, F.lit("/")), F.concat(F.lit("file://"), slashed)).otherwise(slashed)


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
