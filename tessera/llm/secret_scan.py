"""Secret scanning through a trigram inverted index.

From each rule's regular expression a Boolean trigram query is derived: every match must hold, for
each mandatory stretch, all trigrams of one of its alternatives. The index has a posting (trigram,
document) for every trigram that some query asks for. Intersecting postings leaves the candidates of a
rule, and only their texts are tried against its expression. A rule without mandatory trigrams is
tried on every text. All work on rows is DataFrame operations.

Places are code points, the end exclusive. Defined cases: null and empty texts have no span; rows that
share a doc_id share candidates and are verified each on its own text; a null doc_id is a key like any
other; a very long text is scanned whole; an empty table gives no row; the given columns are kept,
whatever their names, but for a column `secrets`, which is replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._util import free_name, stored

_c, _parser = re._constants, re._parser

BROADCAST_ROWS = 2_000_000  # candidates are broadcast up to here (under 100 MB), else shuffled

SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match is dropped unless `group` has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # of a maximal run, the same matches as + and a check of the length
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES

_MOST = 48  # strings that a stretch may stand for before it is closed


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Stretches, all needed; each a list of alternatives, one needed; each a set of trigrams, all needed. None if empty."""
    stretches: list[list[frozenset[str]]] = []

    def close(strings: set[str]) -> None:
        grams = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        least = [g for g in grams if not any(h < g for h in grams)]
        if all(least):
            stretches.append(sorted(least, key=sorted))

    def strings_of(seq) -> set[str] | None:
        """All strings that a short expression stands for, lower-cased."""
        out = {""}
        for op, arg in seq:
            more = choices(op, arg)
            if more is None or len(out) * len(more) > _MOST:
                return None
            out = {a + b for a in out for b in more}
        return out

    def choices(op, arg) -> set[str] | None:
        if op is _c.LITERAL:
            return {chr(arg).lower()}
        if op is _c.IN and all(o is _c.LITERAL for o, _ in arg):
            return {chr(a).lower() for _, a in arg}
        if op is _c.SUBPATTERN:
            return strings_of(arg[3])
        if op is _c.BRANCH:
            parts = [strings_of(x) for x in arg[1]]
            return None if None in parts else set().union(*parts)
        if op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[1] == 1:
            inner = strings_of(arg[2])
            return inner if inner is None or arg[0] else inner | {""}
        return None

    def walk(seq, open_: set[str]) -> set[str]:
        for op, arg in seq:
            more = choices(op, arg)
            if more is not None and len(open_) * len(more) <= _MOST:
                open_ = {a + b for a in open_ for b in more}
            else:
                close(open_)
                open_ = more if more is not None else {""}
        return open_

    close(walk(_parser.parse(pattern), {""}))
    return stretches


def build_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Postings (trigram, doc_id) of every trigram that a query of the rules asks for."""
    grams = sorted({g for r in rules for s in trigram_query(r.pattern) for a in s for g in a})
    low = docs.select("doc_id", F.lower(F.col("text").cast("string")).alias("low"))  # named, so that it is made once and not for each trigram
    found = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams)))
    # outer, since a plain explode would have the array made once more for a filter on its size
    return low.select("doc_id", found.alias("found")).select(F.explode_outer("found").alias("trigram"), "doc_id").where("trigram is not null")


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, kinds): the rules whose trigram query the document's postings meet."""
    rows = [(r.kind, s, a, g, len(grams), len(query)) for r in rules for query in [trigram_query(r.pattern)] for s, alts in enumerate(query) for a, grams in enumerate(alts) for g in sorted(grams)]
    schema = "kind string, stretch int, alt int, trigram string, n_grams int, n_stretches int"
    needs = F.broadcast(postings.sparkSession.createDataFrame(rows, schema))
    met = postings.join(needs, "trigram").groupBy("doc_id", "kind", "stretch", "alt", "n_grams", "n_stretches").agg(F.count(F.lit(1)).alias("n")).where("n >= n_grams")
    whole = met.groupBy("doc_id", "kind", "n_stretches").agg(F.count_distinct("stretch").alias("n")).where("n >= n_stretches")
    return whole.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of one rule's matches, by the lengths of the matches and of what lies between them."""
    regex = F.lit(rule.pattern)
    gaps = F.split(text, rule.pattern, -1)
    parts = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, regex, F.lit(0)).alias("all"), F.regexp_extract_all(text, regex, F.lit(rule.group)).alias("part"))
    nothing = F.array().cast(SPANS)

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["all"])
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        kept = F.when(F.length(x["part"]) >= rule.least, F.array(span).cast(SPANS)).otherwise(nothing)
        return F.struct(F.coalesce(end, acc["at"]).cast("int").alias("at"), F.concat(acc["out"], kept).alias("out"))

    total = F.aggregate(parts, F.struct(F.lit(0).alias("at"), nothing.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.regexp_like(text, regex), total).otherwise(nothing)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with `secrets`: spans (start, rank, kind, end) of every rule, by start and then the order of the rules."""
    found = stored(candidates(stored(build_index(docs.select("doc_id", "text"), rules), "postings"), rules), "candidates")
    id_, kinds = free_name(docs, "id"), free_name(docs, "kinds")
    found = found.select(F.col("doc_id").alias(id_), F.col("kinds").alias(kinds))
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    each = []
    for rank, rule in enumerate(rules):
        spans = spans_of(text, rule, rank)
        each.append(F.when(F.array_contains(kinds, rule.kind), spans).otherwise(F.array().cast(SPANS)) if trigram_query(rule.pattern) else spans)
    out = docs.join(found, F.col("doc_id").eqNullSafe(F.col(id_)), "left")
    return out.withColumn("secrets", F.array_sort(F.concat(*each))).drop(id_, kinds)


def redact(found: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """Puts `mask` in place of every stretch of text that spans cover, and drops `secrets`."""
    acc = "struct<done:int,out:string>"
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def step(a: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= a["done"], F.concat(F.substring(text, a["done"] + 1, s["start"] - a["done"]), F.lit(mask))).otherwise(F.lit(""))
        return F.struct(F.greatest(a["done"], s["end"]).alias("done"), F.concat(a["out"], gap).alias("out")).cast(acc)

    new = F.aggregate("secrets", F.struct(F.lit(0).alias("done"), F.lit("").alias("out")).cast(acc), step, lambda a: F.concat(a["out"], F.substring(text, a["done"] + 1, F.length(text))))
    return found.withColumn("text", F.when(F.size("secrets") > 0, new).otherwise(F.col("text"))).drop("secrets")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
