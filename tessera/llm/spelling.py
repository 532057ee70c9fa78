"""Spelling variants: words that differ by one code point, found with forward and backward minimal automata.

One error lies in one half of a word, so the other half is the same in both words. Words that share a first
half go to a minimal acyclic automaton of the words as they are, those that share a last half to one of the
words read backwards. A query follows its whole half exactly and completes the other with one error; each
state knows how many words lie under each of its arcs, so the arcs of a found word add up to its number in
the sorted list, which gives its count. A word that has the query's first half is the forward automaton's to
find, so the backward one leaves it out and no neighbour counts twice.

Words are dealt out by their shared halves: a word stands in two groups in each direction, as its neighbours
may be shorter or longer by one. A task builds an automaton for some GROUP_WORDS words of whole groups at a
time. A group of more words is dealt over several automata, each of which all queries of the group visit.

The form of a word is the commonest of its neighbours, if that is at least twice as common. Counts at least
double along forms, so their chains are short; roots are found by joins that double the way they look ahead.

Defined cases: null texts have no words; a null doc_id counts as an empty string in the hash that damages
runs; texts and words of any length are taken whole (a word holds a state a code point); ties go to the word
that is smallest by code points; repeated rows count each; an empty table gives no row; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._util import bounded_batches
from tessera.shared import stored

RUN = "[a-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 5, 3
GROUP_WORDS = 20_000  # words of one automaton, but for the end of a group
GROUP_CHARS = 400_000
LONG = 64  # code points from which a search keeps what it found out about its ends
BROADCAST_GROUPS = 100_000  # large groups up to which their table is broadcast


class Automaton:
    """The minimal acyclic automaton of sorted words, each arc with the number of words before those it leads to."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self._sizes: list[int] = []
        known: dict[tuple, int] = {}
        open_states: list[tuple[list[bool], list[tuple[str, int]]]] = [([False], [])]
        last = ""
        for word in [*words, ""]:
            same, most = 0, min(len(word), len(last))
            while same < most and word[same] == last[same]:
                same += 1
            while len(open_states) > same + 1:
                closed = self._close(open_states.pop(), known)
                open_states[-1][1].append((last[len(open_states) - 1], closed))
            open_states += [([False], []) for _ in word[same:]]
            open_states[-1][0][0] |= bool(word)
            last = word
        self.root = self._close(open_states[0], known)

    def _close(self, state: tuple[list[bool], list[tuple[str, int]]], known: dict[tuple, int]) -> int:
        (final,), out = state
        key = (final, *out)
        if key not in known:
            known[key] = len(self.arcs)
            arcs, before = {}, int(final)
            for letter, to in out:
                arcs[letter] = to, before
                before += self._sizes[to]
            self.arcs.append(arcs)
            self.final.append(final)
            self._sizes.append(before)
        return known[key]

    def _end(self, state: int, word: str, at: int, seen: dict[tuple[int, int], int] | None) -> int:
        """The number that word[at:] adds from a state, or -1."""
        total, way = 0, []
        arcs = self.arcs
        for i in range(at, len(word)):
            if seen is not None:
                if (state, i) in seen:
                    got = seen[state, i]
                    total = -1 if got < 0 else total + got
                    break
                way.append((state, i, total))
            step = arcs[state].get(word[i])
            if step is None:
                total = -1
                break
            state, more = step
            total += more
        else:
            total = total if self.final[state] else -1
        for s, i, before in way:
            seen[s, i] = total - before if total >= 0 else -1  # type: ignore[index]
        return total

    def one_error(self, word: str, exact: int) -> set[int]:
        """Numbers of the words that begin with word[:exact] and differ from the word by one code point after it."""
        state, number, found = self.root, 0, set()
        for letter in word[:exact]:
            step = self.arcs[state].get(letter)
            if step is None:
                return found
            state, number = step[0], number + step[1]
        seen: dict[tuple[int, int], int] | None = {} if len(word) > LONG else None
        for i in range(exact, len(word) + 1):
            letter = word[i : i + 1]
            ends = [(0, self._end(state, word, i + 1, seen))] if letter else []
            for other, (to, more) in self.arcs[state].items():
                ends.append((more, self._end(to, word, i, seen)))
                if letter and other != letter:
                    ends.append((more, self._end(to, word, i + 1, seen)))
            found.update(number + more + end for more, end in ends if end >= 0)
            step = self.arcs[state].get(letter)
            if step is None:
                break
            state, number = step[0], number + step[1]
        return found


def words(docs: DataFrame) -> DataFrame:
    """(word, n): damaged runs of letters of at least LEAST_LENGTH code points that occur LEAST_COUNT times or more."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), upper, upper.lower())
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lowered, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= LEAST_LENGTH)  # damage only shortens
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.left("run", at), F.substr("run", at + 2))
    found = runs.select(F.when(h % 97 == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def _grouped(vocabulary: DataFrame) -> DataFrame:
    """Words of each group: `backward`, `group`, `part` (of a group's several), word, n, and whether it stands in the automaton (`listed`) and is a query (`asks`)."""
    size = F.length("word")

    def place(backward: bool, k: Column, half: Column, own: Column) -> Column:
        return F.struct(F.lit(backward).alias("backward"), F.xxhash64(half, F.lit(backward), k).alias("group"), (k == own).alias("asks"))

    floor = lambda c: F.floor(c / 2).cast("int")
    front = [place(False, k, F.left("word", k), floor(size)) for k in (floor(size - 1), floor(size + 1))]
    back = [place(True, k, F.right("word", k), floor(size + 1)) for k in (floor(size), floor(size) + 1)]
    rows = vocabulary.select("word", "n", F.explode(F.array(*front, *back)).alias("_p")).select("word", "n", "_p.*")
    large = rows.groupBy("group").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > GROUP_WORDS)
    large = stored(large.select("group", F.ceil(F.col("_n") / GROUP_WORDS).cast("int").alias("_parts")), "groups")
    if large.count() <= BROADCAST_GROUPS:
        large = F.broadcast(large)
    rows = rows.join(large, "group", "left").withColumn("parts", F.coalesce("_parts", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    every = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))
    rows = rows.select("backward", "group", "parts", "word", "n", "asks", own.alias("_own"), F.explode(every).alias("part"))
    return rows.withColumn("listed", F.col("part") == F.col("_own")).drop("_own")


NEIGHBOURS = "word string, n_near long, best_n long, best string"


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) of each word that has neighbours; vocabulary: (word, n) with distinct words of LEAST_LENGTH code points or more."""
    bounded_batches(vocabulary.sparkSession)
    rows = _grouped(vocabulary).repartition("group", "part").sortWithinPartitions("backward", "group", "part")
    rows = rows.select("backward", "group", "part", "parts", "word", "n", "asks", "listed")
    kinds = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])

    def search(listed: dict[str, int], asking: list[str], backward: bool) -> Iterator[pa.RecordBatch]:
        if not asking or not listed:
            return
        turned = sorted(w[::-1] for w in listed) if backward else sorted(listed)
        automaton, out = Automaton(turned), []
        for word in asking:
            half = len(word) // 2
            found = automaton.one_error(word[::-1], len(word) - half) if backward else automaton.one_error(word, half)
            near = [turned[k][::-1] for k in found] if backward else [turned[k] for k in found]
            if backward:
                near = [w for w in near if not w.startswith(word[:half])]
            if near:
                best = min(near, key=lambda w: (-listed[w], w))
                out.append((word, len(near), listed[best], best))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed: dict[str, int] = {}
        asking: list[str] = []
        chars, at = 0, (None, None, None, 1)
        for batch in batches:
            for backward, group, part, parts, word, n, asks, is_listed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now = (backward, group, part, parts)
                # a group dealt over several automata has each for itself; others share one
                if now != at and (now[0] != at[0] or max(parts, at[3]) > 1 or len(listed) >= GROUP_WORDS or chars >= GROUP_CHARS):
                    yield from search(listed, asking, bool(at[0]))
                    listed, asking, chars = {}, [], 0
                at = now
                if is_listed:
                    listed[word] = n
                    chars += len(word)
                if asks:
                    asking.append(word)
        yield from search(listed, asking, bool(at[0]))

    parts = rows.mapInArrow(run, NEIGHBOURS)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("_best")
    got = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return got.select("word", "n_near", F.col("_best.word").alias("best"), (-F.col("_best.n")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form) rows: the end of each chain of forms, by joins that double the steps looked ahead."""
    got = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = got.select(F.col("word").alias("_at"), F.col("root").alias("_root"))
        joined = got.join(ahead, F.col("root") == F.col("_at"), "left")
        got = stored(joined.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("_moved")), "roots")
        if got.where("_moved").isEmpty():
            return got.drop("_moved")
        got = got.drop("_moved")


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of the texts."""
    vocabulary = stored(words(docs), "words")
    near = neighbours(vocabulary)
    common = F.col("best_n") >= 2 * F.col("n")
    formed = vocabulary.join(near, "word", "left")
    formed = stored(formed.select("word", F.when(common, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(common, F.col("best_n")).alias("form_n")), "forms")
    ends = roots(formed.where("form is not null"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
