"""Words of the script in their lexical context: what is reserved, what may name a variable, what is a type or a global function.

A vocabulary is a table (word, role) with the roles of ROLES; it comes from a configuration or from entities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.names import first_name, second_name

STRICT, KEYWORD, OPERATOR, TYPE, OBJECT, FUNCTION = ROLES = ("strict", "keyword", "operator", "type", "object", "function")
START, AFTER_NEW, DECLARATION, EXPRESSION, UNKNOWN = "StatementStart", "AfterNew", "TypeDeclaration", "Expression", "Unknown"
# The roles that make a word reserved in each context.
RESERVED = {
    START: (STRICT, KEYWORD, OPERATOR),
    AFTER_NEW: (TYPE, OBJECT),
    DECLARATION: (TYPE, OBJECT, STRICT),
    EXPRESSION: (STRICT, OPERATOR),
    UNKNOWN: (STRICT, KEYWORD, TYPE, OPERATOR),
}
# Words that a constructor or a declared type follows.
NEW_WORDS, AS_WORDS = ("Новый", "New"), ("Как", "As")


def context(line: Column, word: Column) -> Column:
    """The lexical context of the first place of a word in a line."""
    trimmed = F.trim(line)
    at = F.instr(trimmed, word)
    before = F.trim(F.substring(trimmed, F.lit(1), at - 1))
    ends = lambda words: F.lit(False) if not words else F.greatest(*(F.endswith(before, F.lit(w)) for w in words))
    return F.when(at == 0, UNKNOWN).when(before == "", START).when(ends(NEW_WORDS), AFTER_NEW).when(ends(AS_WORDS), DECLARATION).otherwise(EXPRESSION)


def vocabulary_of(entities: DataFrame) -> DataFrame:
    """(word, role): names of primitive types and of other platform types, in either language, and names of global functions.

    entities: (display_name, entity_kind, is_global_function).
    """
    d = F.col("display_name")
    role = F.when(F.col("is_global_function"), FUNCTION).when(F.col("entity_kind") == "Primitive", TYPE).otherwise(OBJECT)
    names = F.array_compact(F.array(F.when(first_name(d).isNull(), d), first_name(d), second_name(d)))
    return entities.select(F.explode(names).alias("word"), role.alias("role")).distinct()


def union(*vocabularies: DataFrame) -> DataFrame:
    """(word, role) of several vocabularies, each once."""
    out = vocabularies[0].select("word", "role")
    for v in vocabularies[1:]:
        out = out.unionByName(v.select("word", "role"))
    return out.distinct()


def classified(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """words (word, context, ...) with `roles`, `is_reserved`, `can_be_variable`, `is_type` and `is_function`."""
    roles = vocabulary.groupBy("word").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    out = words.join(roles, "word", "left").withColumn("roles", F.coalesce("roles", F.array().cast("array<string>")))
    has = lambda r: F.array_contains("roles", r)
    reserved = F.lit(False)
    for c, wanted in RESERVED.items():
        reserved = F.when(F.col("context") == c, F.arrays_overlap("roles", F.array(*map(F.lit, wanted)))).otherwise(reserved)
    return out.withColumns({"is_reserved": reserved, "can_be_variable": (F.col("context") != AFTER_NEW) & ~has(STRICT), "is_type": has(TYPE), "is_function": has(FUNCTION)})
