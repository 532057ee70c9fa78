"""Modules of a project: exports, imports, dependents, what is wrong with them, and statistics.

A module is a row (name, module_type); exports are (module, name), imports (module, imported).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.cycles import on_cycles


def export_map(exports: DataFrame) -> DataFrame:
    """(name, n, modules): every exported name with the modules that export it, in order."""
    return exports.distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("module")).alias("modules"))


def imports_by_calls(calls: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, imported): modules whose name another one calls members of. calls: (module, object)."""
    names = modules.select(F.col("name").alias("object")).distinct()
    return calls.join(names, "object", "left_semi").select("module", F.col("object").alias("imported")).where("module != imported").distinct()


def dependents(imports: DataFrame, wanted: DataFrame) -> DataFrame:
    """(imported, module): modules that import one of `wanted` (imported)."""
    return imports.join(wanted.select("imported").distinct(), "imported", "left_semi").select("imported", "module").distinct()


def problems(modules: DataFrame, imports: DataFrame) -> DataFrame:
    """(problem, module, other): imports of missing modules, repeated names, and modules that import themselves through others."""
    names = modules.select(F.col("name").alias("imported"))
    missing = imports.join(names, "imported", "left_anti").select(F.lit("missing").alias("problem"), "module", F.col("imported").alias("other"))
    twice = modules.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate").alias("problem"), F.col("name").alias("module"), F.lit(None).cast("string").alias("other"))
    return missing.distinct().unionByName(twice).unionByName(circles(imports))


def circles(imports: DataFrame) -> DataFrame:
    """(problem, module, other): modules that lie on a cycle of imports, with the least module of those they are in cycles with."""
    found = on_cycles(imports.select(F.col("module").alias("src"), F.col("imported").alias("dst")))
    return found.select(F.lit("circular").alias("problem"), F.col("node").alias("module"), F.col("component").alias("other"))


def statistics(modules: DataFrame, exports: DataFrame, imports: DataFrame) -> DataFrame:
    """(module_type, modules, exports, imports), a row for each type of module."""
    counted = lambda df, n: df.groupBy(F.col("module").alias("name")).agg(F.count(F.lit(1)).alias(n))
    rows = modules.join(counted(exports, "e"), "name", "left").join(counted(imports, "i"), "name", "left")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("e", "exports"), ("i", "imports"))]
    return rows.groupBy("module_type").agg(F.count(F.lit(1)).alias("modules"), *sums)


def call_stats(calls: DataFrame) -> DataFrame:
    """(calls, method_calls, function_calls, arguments, most_arguments) over calls (object, n_args)."""
    method = F.col("object").isNotNull()
    return calls.agg(F.count(F.lit(1)).alias("calls"), F.count_if(method).alias("method_calls"), F.count_if(~method).alias("function_calls"), F.coalesce(F.sum("n_args"), F.lit(0)).alias("arguments"), F.coalesce(F.max("n_args"), F.lit(0)).alias("most_arguments"))


def file_metrics(files: DataFrame, routines: DataFrame, results: DataFrame) -> DataFrame:
    """(path, lines, routines, errors, warnings, score): score is 100 less 5 for an error and 1 for a warning, 0 at least."""
    r = routines.groupBy("path").agg(F.count(F.lit(1)).alias("routines"))
    d = results.groupBy(F.col("file_path").alias("path")).agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"))
    out = files.join(r, "path", "left").join(d, "path", "left").fillna(0, ["routines", "errors", "warnings"])
    return out.select("path", "lines", "routines", "errors", "warnings", F.greatest(F.lit(0), 100 - 5 * F.col("errors") - F.col("warnings")).alias("score"))
