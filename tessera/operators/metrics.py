"""Quality metrics of modules: size, complexity, maintainability, duplication, debt, score and advice.

Everything is column expressions over one row. Repeated blocks and long routines are folds over the lines
of a text, so nothing is shuffled, however many lines one text has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.lexicon import Lexicon

LONG_ROUTINE_LINES = 50
MANY_NUMBERS = 5
MANY_LOOPS = 2
BLOCK_LINES = 3


def lines(text: Column) -> Column:
    """Lines without their ends; a final line end opens no further line, and an empty text has none."""
    body = F.regexp_replace(text, "\\r?\\n\\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, "\\r?\\n"))


def occurrences(text: Column, token: str) -> Column:
    """How often a token stands in a text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(token), F.lit("")))) / len(token)).cast("long")


def count_of(text: Column, tokens: tuple[str, ...]) -> Column:
    total = F.lit(0).cast("long")
    for t in tokens:
        total = total + occurrences(text, t)
    return total


def has_any(text: Column, tokens: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for t in tokens:
        out = out | F.contains(text, F.lit(t))
    return out


def loc(text: Column) -> Column:
    """Lines that aren't blank."""
    return F.size(F.filter(lines(text), lambda x: F.trim(F.regexp_replace(x, "\\s", "")) != "")).cast("long")


def token_counts(docs: DataFrame, lex: Lexicon, more: dict[str, Column] | None = None) -> DataFrame:
    """doc_id and the counts that the other metrics are made from, and more columns of the same rows."""
    t = F.col("text")
    return docs.select(
        "doc_id",
        *(c.alias(n) for n, c in (more or {}).items()),
        loc(t).alias("loc"),
        F.size(lines(t)).cast("long").alias("n_lines"),
        count_of(t, lex.routine).alias("routines"),
        count_of(t, lex.condition).alias("conditions"),
        count_of(t, lex.loop).alias("loops"),
        count_of(t, lex.operator).alias("operators"),
        F.regexp_count(t, F.lit("\\S+")).cast("long").alias("operands"),
    )


def with_complexity(counts: DataFrame) -> DataFrame:
    """cyclomatic and cognitive complexity: 1 without a routine."""
    c = F.col("conditions") + F.col("loops") + 1
    return counts.withColumns(
        {
            "cyclomatic": F.when(F.col("routines") > 0, c).otherwise(F.lit(1)).cast("double"),
            "cognitive": F.when(F.col("routines") > 0, c + F.col("loops")).otherwise(F.lit(1)).cast("double"),
        }
    )


def with_maintainability(counts: DataFrame) -> DataFrame:
    """volume n * log2(n) and the index, clamped to 0..100; null where there is nothing to measure."""
    n = (F.col("operators") + F.col("operands")).cast("double")
    volume = F.when(n > 0, n * F.log2(n))
    decisions = (F.col("conditions") + F.col("loops") + 1).cast("double")
    index = F.lit(171.0) - F.lit(5.2) * F.ln("volume") - F.lit(0.23) * decisions - F.lit(16.2) * F.ln(F.col("loc").cast("double"))
    clamped = F.when(F.col("volume").isNull(), F.lit(None).cast("double")).when((F.col("volume") <= 0) | (F.col("loc") == 0), F.lit(100.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), index)))
    return counts.withColumn("volume", volume).withColumn("maintainability", clamped)


def repeated_lines(ls: Column) -> Column:
    """BLOCK_LINES for each block of as many lines that stands again later without overlap.

    Blocks are sorted by two hashes, those of one text from the last to the first, so that a fold sees for each where it last stands.
    """
    texts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(ls) - BLOCK_LINES + 1, F.lit(1))), lambda i: F.concat_ws("\n", F.slice(ls, i, BLOCK_LINES)))
    blocks = F.sort_array(F.transform(texts, lambda x, i: F.struct(F.xxhash64(x).alias("a"), F.crc32(x).alias("b"), (-i).alias("back"))))
    start = F.struct(F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(0).alias("last"), F.lit(0).cast("long").alias("n"))

    def step(seen: Column, x: Column) -> Column:
        last = F.when((seen["a"] == x["a"]) & (seen["b"] == x["b"]), seen["last"]).otherwise(-x["back"])
        return F.struct(x["a"].alias("a"), x["b"].alias("b"), last.alias("last"), (seen["n"] + (last + x["back"] >= BLOCK_LINES).cast("long")).alias("n"))

    return F.when(F.size(ls) >= BLOCK_LINES, F.aggregate(blocks, start, step, lambda seen: seen["n"]) * BLOCK_LINES).otherwise(F.lit(0).cast("long"))


def long_heads(ls: Column, lex: Lexicon) -> Column:
    """Routine heads with over LONG_ROUTINE_LINES lines up to the next end token or the end of the text: a fold from the last line to the first."""
    marks = F.reverse(F.transform(ls, lambda x, i: F.struct(i.alias("pos"), has_any(x, lex.routine).alias("starts"), has_any(x, lex.routine_end).alias("ends"))))

    def step(seen: Column, x: Column) -> Column:
        stop = F.when(x["ends"], x["pos"]).otherwise(seen["stop"])
        long = x["starts"] & (stop - x["pos"] > LONG_ROUTINE_LINES)
        return F.struct(stop.alias("stop"), (seen["n"] + long.cast("long")).alias("n"))

    return F.coalesce(F.aggregate(marks, F.struct(F.size(ls).alias("stop"), F.lit(0).cast("long").alias("n")), step, lambda seen: seen["n"]), F.lit(0).cast("long"))


def with_lines(docs: DataFrame) -> DataFrame:
    """docs with `_lines`, made once."""
    return docs.withColumn("_lines", lines(F.col("text")))


def dup_pct(n_lines: Column, dup_lines: Column) -> Column:
    return F.when((n_lines < BLOCK_LINES) | dup_lines.isNull() | (dup_lines == 0), F.lit(0.0)).otherwise(F.least(F.lit(100.0), dup_lines / n_lines * F.lit(100.0)))


def duplication(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """(doc_id, dup_pct): three lines for each block of three that stands again later without overlap, of 100 lines."""
    ls = F.col("_lines")
    return with_lines(docs).select("doc_id", dup_pct(F.size(ls).cast("long"), repeated_lines(ls)).alias("dup_pct"))


def long_routines(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """(doc_id, long_routines) of texts that have any."""
    return with_lines(docs).select("doc_id", long_heads(F.col("_lines"), lex).alias("long_routines")).where("long_routines > 0")


DEBT = (
    # name, type, severity, minutes
    ("long_routine", "CodeQuality", "Medium", 30),
    ("numbers", "CodeQuality", "Low", 15),
    ("loops", "Performance", "Medium", 45),
    ("concat_in_loop", "Performance", "High", 60),
    ("undocumented", "Documentation", "Medium", 20),
)


def debt_flags(t: Column, lex: Lexicon) -> dict[str, Column]:
    """What a text shows by itself of the kinds of DEBT: 1 or 0 each."""
    flags = {
        "numbers": F.regexp_count(t, F.lit("\\p{N}")) > MANY_NUMBERS,
        "loops": count_of(t, lex.loop_keyword) > MANY_LOOPS,
        "concat_in_loop": F.contains(t, F.lit(lex.loop_head)) & F.contains(t, F.lit(lex.concat)),
        "undocumented": (count_of(t, lex.routine) > 0) & (occurrences(t, lex.comment) == 0),
    }
    return {n: c.cast("long") for n, c in flags.items()}


def debt_items(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """(doc_id, item, type, severity, minutes, n): what of each kind of debt a text holds."""
    flags = debt_flags(F.col("text"), lex) | {"long_routine": long_heads(F.col("_lines"), lex)}
    counts = with_lines(docs).select("doc_id", *(c.alias(n) for n, c in flags.items()))
    items = [F.struct(F.lit(n).alias("item"), F.lit(k).alias("type"), F.lit(s).alias("severity"), F.lit(m).cast("long").alias("minutes"), F.coalesce(F.col(n), F.lit(0)).cast("long").alias("n")) for n, k, s, m in DEBT]
    return counts.select("doc_id", F.inline(F.array(*items))).where("n > 0")


def debt_totals(items: DataFrame) -> DataFrame:
    """(doc_id, n_items, minutes, high_minutes)."""
    cost = F.col("minutes") * F.col("n")
    high = F.sum(F.when(F.col("severity") == "High", cost).otherwise(0))
    return items.groupBy("doc_id").agg(F.sum("n").alias("n_items"), F.sum(cost).alias("minutes"), high.alias("high_minutes"))


def quality(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """All metrics of a text, its score of 0..100 and the advice drawn from them."""
    flags = {f"_{n}": c for n, c in debt_flags(F.col("text"), lex).items()}
    ls = F.col("_lines")
    base = with_maintainability(with_complexity(token_counts(with_lines(docs), lex, flags | {"dup_lines": repeated_lines(ls), "long_routine": long_heads(ls, lex)})))
    out = base.withColumn("dup_pct", dup_pct(F.col("n_lines"), F.col("dup_lines")))
    zero = F.lit(0).cast("long")
    n = {name: F.coalesce(F.col(f"_{name}" if f"_{name}" in flags else name).cast("long"), zero) for name, *_ in DEBT}
    cost = lambda keep: sum((n[name] * minutes for name, _, severity, minutes in DEBT if keep(severity)), zero)
    out = out.withColumns({"n_items": sum(n.values(), zero), "minutes": cost(lambda s: True), "high_minutes": cost(lambda s: s == "High")})
    out = out.drop("dup_lines", "long_routine", *flags)
    band = lambda c, steps, rest: _bands(F.col(c), steps, rest)
    score = (
        band("cyclomatic", ((2.0, 100.0), (5.0, 80.0), (10.0, 60.0)), 30.0) * F.lit(0.3)
        + F.col("maintainability") * F.lit(0.3)
        + band("n_items", ((0, 100.0), (3, 85.0), (7, 70.0), (15, 50.0)), 25.0) * F.lit(0.25)
        + F.when(F.col("dup_pct") < 5, F.lit(100.0)).when(F.col("dup_pct") < 10, F.lit(80.0)).when(F.col("dup_pct") < 20, F.lit(60.0)).otherwise(F.lit(30.0)) * F.lit(0.15)
    )
    score = F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))
    return out.withColumn("score", score).withColumn("advice", recommendations())


def _bands(value: Column, steps: tuple, rest: float) -> Column:
    out = None
    for upto, points in steps:
        cond = value <= upto
        out = F.when(cond, F.lit(points)) if out is None else out.when(cond, F.lit(points))
    return out.otherwise(F.lit(rest))


# The advice, by the predicate that calls for it, in order of priority.
ADVICE = (
    ("cyclomatic > 10", "Consider breaking down complex functions into smaller, more focused functions"),
    ("cyclomatic > 15", "Identify the most complex function and refactor it using Extract Method pattern"),
    ("maintainability < 60", "Focus on improving code maintainability by reducing complexity and adding documentation"),
    ("loc > 500", "Consider splitting this file into multiple smaller modules"),
    ("high_minutes > 60", "Prioritize fixing high-severity technical debt in the next sprint"),
    ("minutes > 240", "Consider dedicating time each sprint to reduce technical debt"),
    ("dup_pct > 15", "Extract common code into reusable functions to reduce duplication"),
    ("dup_pct > 25", "High code duplication detected - consider major refactoring"),
)
NO_ADVICE = ("Code quality looks good! Consider adding more comprehensive tests", "Keep monitoring metrics to maintain good code quality over time")
MORE_ADVICE = "Additional recommendations available - focus on top priorities first"
MOST_ADVICE = 5


def recommendations() -> Column:
    """Advice for a row of metrics, joined by a bar."""
    found = F.array_compact(F.array(*(F.when(F.expr(p), F.lit(a)) for p, a in ADVICE)))
    none = F.array(*map(F.lit, NO_ADVICE))
    cut = F.when(F.size(found) > MOST_ADVICE, F.array_append(F.slice(found, 1, MOST_ADVICE), F.lit(MORE_ADVICE))).otherwise(found)
    return F.array_join(F.when(F.size(found) == 0, none).otherwise(cut), "|")


def rollup(docs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Totals by language, by language and source, and over all."""
    joined = docs.select("doc_id", "lang", "source").join(metrics, "doc_id")
    return joined.rollup("lang", "source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("loc").alias("loc"), F.avg("maintainability").alias("avg_maintainability"), F.grouping_id().alias("level"))


def project_stats(docs: DataFrame) -> DataFrame:
    """Files, lines, files with any code, and whole lines a file on average."""
    t = F.col("text")
    n = F.size(lines(t)).cast("long")
    totals = docs.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(n), F.lit(0)).alias("n_lines"), F.count_if(loc(t) > 0).alias("with_code"))
    return totals.withColumn("avg_lines", F.when(F.col("files") > 0, F.floor(F.col("n_lines") / F.col("files"))).otherwise(F.lit(0)).cast("long"))
