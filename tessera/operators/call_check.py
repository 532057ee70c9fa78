"""Checks of member calls, composed: the type of the object, its effective members, arguments, context and age.

A call is a row (call_id, object, member, n_args); members are rows (type, member, least, most,
returns, availability, is_deprecated, deprecation) of each type, those inherited among them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from tessera.functions.names import value_type
from tessera.operators.index import lookup
from tessera.operators.reach import ReachIndex, reachable
from tessera.operators.verify import alike
from tessera.shared import stored
from tessera.sources.kinds import MANAGERS

DEFAULT_CONTEXT = "Server"
_SMALL = 100_000  # rows up to which a counted table is broadcast


_WORD = "[\\w\\u0400-\\u04FF]+"


def _nodes(assignments: DataFrame, names: DataFrame) -> DataFrame:
    """Assignments that may have a type, each once: scope, name, pos, `base` (type of a literal or constructor), `head` (what the value starts from), member, is_call, of_index (id of the head in the index)."""
    v = F.trim("value")
    part = lambda p, i: F.nullif(F.regexp_extract(v, p, i), F.lit(""))
    dotted = f"^({_WORD})\\.({_WORD})(\\(|$)"
    once = assignments.groupBy("scope", "name", "pos").agg(F.max("value").alias("value"))
    base = F.coalesce(value_type(v), part(f"^(?:Новый|New)\\s+({_WORD})", 1))
    rows = once.select("scope", "name", "pos", base.alias("base"), part(f"^({_WORD})$", 1).alias("alone"), part(dotted, 1).alias("object"), part(dotted, 2).alias("member"), F.regexp_like(v, F.lit(f"^{_WORD}\\.{_WORD}\\(")).alias("is_call"))
    rows = rows.withColumn("head", F.when(F.col("base").isNull(), F.coalesce("alone", "object"))).where("base is not null or head is not null").drop("alone", "object")
    known = lookup(rows.select(F.col("head").alias("name")).where("name is not null").distinct(), names).where("id is not null")
    known = stored(known.select(F.col("name").alias("head"), F.col("id").alias("of_index")), "heads")
    return rows.join(F.broadcast(known) if known.count() <= _SMALL else known, "head", "left")


def _member_type(kind: str, member: str, is_call: bool, results: dict[str, str]) -> str | None:
    """What a member of a type is: a call what it returns, else the manager of the member if the type has managers, else what it returns."""
    got = results.get(kind)
    if is_call and got is not None:
        return got
    manager = next((b for p, b, _ in MANAGERS if p in kind), None)
    return f"{manager}.{member}" if manager is not None else got


def assigned_types(assignments: DataFrame, names: DataFrame, members: DataFrame) -> DataFrame:
    """(scope, name, pos, type): the type of each assigned variable. assignments: (scope, name, pos, value).

    A value is a literal, `New T(...)`, a name, `name.member` or `name.member(...)`, which has the type that the
    member returns. A name is the variable of the scope as it was last assigned before with a known type, else
    that of the index (names: what operators.index.name_index gives); an assignment of unknown type changes
    nothing. Repeated rows count once, of two values at one place the greater counts.

    Scopes are dealt over partitions and sorted by place; a scope streams through one task, which holds the last
    type of each of its names. What members return is a map of types, of each member, that goes to all tasks if
    it was counted and is small, else with the rows that ask for it.
    """
    rows = _nodes(assignments, names)
    result = stored(members.where("returns is not null").groupBy(F.col("type").alias("of_type"), "member").agg(F.max("returns").alias("result")).where("of_type is not null and member is not null"), "results")
    maps = result.groupBy("member").agg(F.map_from_entries(F.collect_list(F.struct("of_type", "result"))).alias("results"))
    small = {r.member: r.results for r in maps.collect()} if result.count() <= _SMALL else None
    rows = rows.withColumn("results", F.lit(None).cast("map<string,string>")) if small is not None else rows.join(maps, "member", "left")
    wanted = rows.select("scope", "name", "pos", "base", "head", "member", "is_call", "of_index", "results").repartition("scope").sortWithinPartitions("scope", "pos")
    schema = StructType([*(StructField(c, rows.schema[c].dataType) for c in ("scope", "name", "pos")), StructField("type", StringType())])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: tuple | None = None
        held: dict = {}
        fresh: dict = {}
        for batch in batches:
            out = []
            for scope, name, pos, base, head, member, is_call, of_index, results in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != (scope, pos):
                    # what is written at one place shows from the next on
                    if place is None or place[0] != scope:
                        held = {}
                    else:
                        held.update(fresh)
                    place, fresh = (scope, pos), {}
                kind = base
                if kind is None:
                    kind = held.get(head, of_index)
                    if member is not None:
                        kind = _member_type(head if kind is None else kind, member, is_call, dict(results or ()) if small is None else small.get(member, {}))
                if kind is not None:
                    fresh[name] = kind
                    out.append({"scope": scope, "name": name, "pos": pos, "type": kind})
            yield pa.RecordBatch.from_pylist(out, kinds)

    return wanted.mapInArrow(run, schema)


def typed_calls(calls: DataFrame, types: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """calls (call_id, scope, pos, object, ...) with `type`: that of the last typed assignment of the object before the call in its scope, else, if names are given, the object's id in the index."""
    upto = Window.partitionBy("scope", "object").orderBy("pos", "writes").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names_ = [c for c in calls.columns if c != "type"]
    rows = calls.select(F.struct(*names_).alias("call"), "scope", "object", F.col("pos").cast("long").alias("pos"), F.lit(0).alias("writes"), F.lit(None).cast("string").alias("type"))
    writes = types.select(F.lit(None).cast(rows.schema["call"].dataType).alias("call"), "scope", F.col("name").alias("object"), F.col("pos").cast("long").alias("pos"), F.lit(1).alias("writes"), "type")
    got = rows.unionByName(writes).withColumn("type", F.last("type", ignorenulls=True).over(upto)).where("call is not null").select("call.*", "type")
    if names is None:
        return got
    known = lookup(got.select(F.col("object").alias("name")).where("name is not null").distinct(), names).where("id is not null")
    return got.join(known.select(F.col("name").alias("object"), F.col("id").alias("_of_index")), "object", "left").withColumn("type", F.coalesce("type", "_of_index")).select(*names_, "type")


def unknown_functions(calls: DataFrame, routines: DataFrame, functions: DataFrame) -> DataFrame:
    """(path, pos, member): calls of functions that neither the language (`functions`: word) nor their module (`routines`: path, name) has, whatever the case."""
    free = calls.where("kind = 'function'").withColumn("_name", F.lower("member"))
    there = free.join(functions.select(F.lower("word").alias("_name")).distinct(), "_name", "left_anti")
    own = routines.select(F.col("path").alias("_path"), F.lower("name").alias("_own")).distinct()
    return there.join(own, F.col("path").eqNullSafe(F.col("_path")) & (F.col("_name") == F.col("_own")), "left_anti").select("path", "pos", "member")


def method_problems(calls: DataFrame, members: DataFrame) -> DataFrame:
    """(call_id, type, member, problem): calls (call_id, type, member, n_args) of typed objects against members (type, member, parameters), a name that ends in `.member` counting as the member.

    problem is unknown_type, unknown_method, wrong_count (not as many arguments as the method of just that name has parameters) or null.
    """
    short = F.substring_index("member", ".", -1)
    there = members.select("type", F.lit(True).alias("_type")).distinct()
    exact = members.groupBy("type", "member").agg(F.max("parameters").alias("_parameters"))
    ends = members.select("type", short.alias("member"), F.lit(True).alias("_ends")).distinct()
    got = calls.where("type is not null").join(there, "type", "left").join(exact, ["type", "member"], "left").join(ends, ["type", "member"], "left")
    count = F.col("_parameters").isNotNull() & (F.col("_parameters") != F.col("n_args"))
    problem = F.when(F.col("_type").isNull(), "unknown_type").when(F.col("_parameters").isNull() & F.col("_ends").isNull(), "unknown_method").when(count, "wrong_count")
    return got.select("call_id", "type", "member", problem.alias("problem"))


def check(calls: DataFrame, types: DataFrame, members: DataFrame, context: Column | None = None) -> DataFrame:
    """calls (call_id, type, member, n_args) with `problem` and `warning`.

    The first of: the type is unknown, it has no such member, too few or too many arguments, the member
    isn't available in the context. A deprecated member is a warning. types: (type).
    """
    there = types.select("type", F.lit(True).alias("_type")).distinct()
    rows = calls.withColumn("_context", F.coalesce(context if context is not None else F.lit(None).cast("string"), F.lit(DEFAULT_CONTEXT)))
    m = members.withColumn("_member", F.lit(True))
    got = rows.join(there, "type", "left").join(m, ["type", "member"], "left")
    closed = (F.size("availability") > 0) & ~F.array_contains("availability", F.col("_context"))
    problem = (
        F.when(F.col("_type").isNull(), F.concat(F.lit("Type '"), F.coalesce("type", F.lit("?")), F.lit("' not found")))
        .when(F.col("_member").isNull(), F.concat(F.lit("Method '"), F.col("member"), F.lit("' not found for type '"), F.col("type"), F.lit("'")))
        .when(F.col("n_args") < F.col("least"), F.concat(F.lit("Method '"), F.col("member"), F.lit("' takes at least "), F.col("least").cast("string"), F.lit(" arguments")))
        .when(F.col("n_args") > F.col("most"), F.concat(F.lit("Method '"), F.col("member"), F.lit("' takes at most "), F.col("most").cast("string"), F.lit(" arguments")))
        .when(closed, F.concat(F.lit("Method '"), F.col("member"), F.lit("' is not available in "), F.col("_context"), F.lit(" context")))
    )
    warning = F.when(F.col("is_deprecated"), F.concat(F.lit("Method '"), F.col("member"), F.lit("' is deprecated"), F.coalesce(F.concat(F.lit(": "), F.col("deprecation")), F.lit(""))))
    return got.select("call_id", "type", "member", problem.alias("problem"), warning.alias("warning"))


def diagnostics(checked: DataFrame, members: DataFrame, first: int = 3) -> DataFrame:
    """(call_id, message): an error for each problem, with similar members as bulleted suggestions."""
    wanted = checked.where(F.endswith("problem", F.concat(F.lit("for type '"), F.col("type"), F.lit("'")))).select("type", F.col("member").alias("wanted")).distinct()
    near = alike(wanted, members.select("type", "member"), first)
    lists = near.groupBy("type", F.col("wanted").alias("member")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "member"))), lambda x: F.concat(F.lit("• "), x["member"], F.lit("\n"))).alias("hints"))
    rows = checked.where("problem is not null").join(lists, ["type", "member"], "left")
    hints = F.when(F.size("hints") > 0, F.concat(F.lit("\n\nПредложения:\n"), F.array_join("hints", ""))).otherwise("")
    return rows.select("call_id", F.concat("problem", hints).alias("message"))


def in_context(members: DataFrame, context: str | None) -> DataFrame:
    """Members that Client or Server code may call; any other context leaves all."""
    return members.where(F.array_contains("availability", context)) if context in ("Client", "Server") else members


def summary(own: DataFrame, effective: DataFrame) -> DataFrame:
    """(type, total_methods, own_methods, inherited_methods)."""
    count = lambda df, n: df.groupBy("type").agg(F.count_distinct("member").alias(n))
    got = count(effective, "total_methods").join(count(own, "own_methods"), "type", "left").fillna(0, ["own_methods"])
    return got.withColumn("inherited_methods", F.col("total_methods") - F.col("own_methods"))


def compatibility(pairs: DataFrame, parents: DataFrame, implements: DataFrame, index: ReachIndex) -> DataFrame:
    """pairs (from_id, to_id) with `compatible` and `reason`. parents and implements: (id, name) as declared; index: operators.reach.build."""
    marks = [df.select(F.col("id").alias("from_id"), F.col("name").alias("to_id"), F.lit(True).alias(c)).distinct() for df, c in ((parents, "_up"), (implements, "_does"))]
    far = reachable(pairs.where("from_id != to_id"), index).withColumn("_far", F.lit(True))
    got = pairs
    for df in (*marks, far):
        got = got.join(df, ["from_id", "to_id"], "left")
    reason = F.when(F.col("from_id") == F.col("to_id"), "exact_match").when(F.col("_up"), "inheritance").when(F.col("_does"), "implements_interface").when(F.col("_far"), "compatible").otherwise("incompatible_types")
    return got.select("from_id", "to_id", (reason != "incompatible_types").alias("compatible"), reason.alias("reason"))


def compatibility_report(checked: DataFrame, entities: DataFrame, parents: DataFrame) -> DataFrame:
    """checked with from_found, to_found and the parents of from_id, in order. entities: (id)."""
    ids = entities.select("id").distinct()
    up = parents.groupBy(F.col("id").alias("from_id")).agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("parents"))
    out = checked
    for side in ("from", "to"):
        out = out.join(ids.select(F.col("id").alias(f"{side}_id"), F.lit(True).alias(f"{side}_found")), f"{side}_id", "left")
    return out.join(up, "from_id", "left").fillna(False, ["from_found", "to_found"]).select("from_id", "to_id", "from_found", "to_found", "compatible", "reason", "parents")


def ranked(rows: DataFrame, by: list[str], order: list[Column], first: int) -> DataFrame:
    """The first rows of each group in an order, with `rank`."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= first)
