"""Repair of the structure of conversations by lazy weighted determinisation.

The rows of a conversation, by turn, must have roles that begin `(s?(ua)+)?`: perhaps a system row, then
user and assistant in turn. Edits are Keep (0), Rerole to user or assistant (1), Delete (2) and Insert of a
user or assistant row without text (5); a truncated row that stays costs 5 more, and blank and repeated rows
must go. What is wanted is the cheapest list of edits, of several the least as a string of initials.

Roles written so far are one of four states (nothing, s, u, a). The costs still to pay from each of them
form a vector; less its least entry it is a state of a deterministic automaton, made when it is first met
and kept with its transitions in a table. Scanning a conversation's symbols through the table, from its last
row to its first, gives the cost; the trace runs back against the scan, from the first row on, along arcs
that are tight (cost of the arc and of what follows make up what was to pay) and takes the least letter.

Rows are numbered over range partitions and cut into blocks of BLOCK rows, so no task holds a conversation.
A block's costs from each state to each state are found by itself, as are its traces from each state; only
those summaries, one a block, are chained along a conversation. The digest of the repaired text can't be
split: it is taken in a stream that holds one batch, one task for each conversation at a time.

Defined cases: null roles and texts count as one space; rows of one turn go by role, then text, null turns
come first; a role that begins with none of s, u and a, or is empty, must be changed or deleted; rows without
conv_id are one conversation; repeated rows are duplicates; long texts are read whole; an empty table gives
no row; other columns are dropped, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.llm._util import bounded_batches
from tessera.shared import stored

BLOCK = 4096
RANGE_PREFIX = 32  # characters of role and text that bounds of range partitions are made of
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: What a row of this initial does to each state; the other pairs have no way on.
AFTER = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The one role that can be inserted, or given to a row, in each state.
FREE = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
FAR = 1 << 40
_SPACE = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}
Vector = tuple[int, int, int, int]


def _inserts(v: list[int]) -> list[int]:
    """Costs from each state when rows may be inserted first."""
    for _ in range(3):  # a way through all states has three arcs
        v = [min(c, INSERT + v[FREE[q]]) for q, c in enumerate(v)]
    return v


def _normal(v: list[int]) -> tuple[Vector, int]:
    least = min(v)
    return tuple(min(c - least, FAR) for c in v), least  # type: ignore[return-value]


END: Vector = tuple(_inserts([0, FAR, FAR, 0]))  # type: ignore[assignment]


def arcs(symbol: str, q: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of one row in a state, by letter. Lower-case r and i make a user row, upper-case ones an assistant's."""
    out = [("D", DELETE, q)]
    if symbol != "x":
        more = TRUNCATED * symbol.isupper()
        to = AFTER.get(symbol.lower(), {}).get(q)
        if to is not None:
            out.append(("K", KEEP + more, to))
        out.append(("r" if FREE[q] == USER else "R", REROLE + more, FREE[q]))
    return out


class Automaton:
    """Vectors met so far, and the transitions and traces between them."""

    def __init__(self) -> None:
        self.vectors: list[Vector] = []
        self.ids: dict[Vector, int] = {}
        self.steps: list[dict[str, tuple[int, int]]] = []
        self.traced: dict[tuple[int, str, int], tuple[str, int]] = {}

    def state(self, v: Vector) -> int:
        if v not in self.ids:
            self.ids[v] = len(self.vectors)
            self.vectors.append(v)
            self.steps.append({})
        return self.ids[v]

    def step(self, k: int, symbol: str) -> tuple[int, int]:
        """The state before a row, and what its vector is less than the true costs by."""
        got = self.steps[k].get(symbol)
        if got is None:
            after = self.vectors[k]
            v, least = _normal(_inserts([min(cost + after[to] for _, cost, to in arcs(symbol, q)) for q in range(4)]))
            got = self.steps[k][symbol] = self.state(v), least
        return got

    def scan(self, symbols: str, last: Vector) -> tuple[list[int], int]:
        """States at each place, from the last to the first, and the sum of what was taken off."""
        k, total = self.state(last), 0
        out = [k]
        for symbol in reversed(symbols):
            k, least = self.step(k, symbol)
            total += least
            out.append(k)
        return out, total

    def token(self, k: int, symbol: str, q: int) -> tuple[str, int]:
        """Letters of one row from state q on the least tight way, inserts first, and the state after it; k: the vector after the row."""
        got = self.traced.get((k, symbol, q))
        if got is None:
            before, least = self.step(k, symbol)
            now, after, text, at = self.vectors[before], self.vectors[k], "", q
            while got is None:
                tight = [(letter, to) for letter, cost, to in arcs(symbol, at) if cost + after[to] == now[at] + least]
                if INSERT + now[FREE[at]] == now[at]:
                    tight.append(("i" if FREE[at] == USER else "I", -1))
                letter, to = min(tight, key=lambda x: x[0].upper())
                text += letter
                if to < 0:
                    at = FREE[at]
                else:
                    got = text, to
            self.traced[k, symbol, q] = got
        return got

    def trace(self, symbols: str, states: list[int], q: int) -> tuple[list[str], int]:
        """Tokens of all rows from state q, and the state after them."""
        out = []
        for i, symbol in enumerate(symbols):
            text, q = self.token(states[len(symbols) - 1 - i], symbol, q)
            out.append(text)
        return out, q


def trailing(q: int) -> str:
    """Inserts after the last row."""
    out = ""
    while END[q]:
        out += "i" if FREE[q] == USER else "I"
        q = FREE[q]
    return out


def _mapped(df: DataFrame, schema: str, add: Callable[[], Callable[[dict], dict]]) -> DataFrame:
    """df with columns that a function of one row adds, by batches; `add` makes the function once in each task."""
    full = StructType([*df.schema, *StructType.fromDDL(schema)])
    added = list(to_arrow_schema(full))[len(df.columns) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, kinds = add(), None
        for batch in batches:
            rows = [f(r) for r in batch.to_pylist()]
            if kinds is None:
                kinds = pa.schema([*batch.schema, *added])
            yield pa.RecordBatch.from_pylist(rows, kinds)

    return df.mapInArrow(run, full)


def _within() -> Callable[[dict], dict]:
    """Costs of a block from each state to each state."""
    machine = Automaton()
    units = [tuple(0 if q == e else FAR for q in range(4)) for e in range(4)]

    def add(r: dict) -> dict:
        costs = []
        for unit in units:
            states, total = machine.scan(r["symbols"], unit)
            costs += [min(c + total, FAR) for c in machine.vectors[states[-1]]]
        return r | {"costs": costs}

    return add


def _chained_costs() -> Callable[[dict], dict]:
    """What is to pay after each block, from the last block of a conversation to its first; `cost` is what is to pay before it."""
    held: dict = {"conv": object(), "v": END, "total": 0}

    def add(r: dict) -> dict:
        if r["conv_id"] != held["conv"]:
            held.update(conv=r["conv_id"], v=END, total=0)
        after = held["v"]
        v, least = _normal([min(r["costs"][4 * e + q] + after[e] for e in range(4)) for q in range(4)])
        held["cost"] = held["total"] + least + v[NOTHING]
        held.update(v=v, total=held["total"] + least)
        return r | {"after": list(after), "cost": held["cost"]}

    return add


def _traced() -> Callable[[dict], dict]:
    """Tokens of a block from each state it may begin in, and the state that it ends in."""
    machine = Automaton()

    def add(r: dict) -> dict:
        states, _ = machine.scan(r["symbols"], tuple(r["after"]))
        got = [machine.trace(r["symbols"], states, q) for q in range(4)]
        return r | {"ways": [" ".join(tokens) for tokens, _ in got], "ends": [q for _, q in got]}

    return add


def _chosen() -> Callable[[dict], dict]:
    """The tokens of each block, from the first block of a conversation to its last."""
    held: dict = {"conv": object(), "q": NOTHING}

    def add(r: dict) -> dict:
        first = r["conv_id"] != held["conv"]
        q = NOTHING if first else held["q"]
        held.update(conv=r["conv_id"], q=r["ends"][q])
        return r | {"way": r["ways"][q], "end": held["q"], "opening": first}

    return add


def faults(rows: DataFrame) -> DataFrame:
    """Rows in order: conv_id, turn, role, text, `fault` (blank, duplicate, truncated or null), with their places `_part` and `_idx`. Stored."""
    spark = rows.sparkSession
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    plain = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    keys: list[str | Column] = ["conv_id", F.col("turn").asc_nulls_first(), F.left("role", F.lit(RANGE_PREFIX)), F.when(F.length("role") <= RANGE_PREFIX, F.left("text", F.lit(RANGE_PREFIX))).asc_nulls_last()]
    # the bounds of a range partition are short keys; the rest of the order holds inside one. Equal rows are dealt out, as any order of them is right.
    spread = plain.withColumn("_deal", F.rand(7))
    first = spread.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, "_deal")
    row = F.col("_row")
    held = first.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text").withColumn("_row", F.monotonically_increasing_id())
    held = held.withColumns({"_part": F.shiftright(row, 33).cast("int"), "_idx": row.bitwiseAND((1 << 33) - 1)}).drop("_row", "_deal")
    stripped = F.rtrim("text", F.lit(_SPACE))
    held = stored(held.withColumns({"_blank": stripped == "", "_cut": ~F.right(stripped, F.lit(1)).isin(".", "!", "?")}), "turns")
    same = F.md5(F.concat_ws(":", F.length("role"), "role", "text"))
    seen = held.where("not _blank").groupBy("conv_id", same.alias("_same")).agg(F.min(F.struct("_part", "_idx")).alias("_at"))
    seen = seen.select("_at._part", "_at._idx", F.lit(True).alias("_first"))
    fault = F.when(F.col("_blank"), "blank").when(F.col("_first").isNull(), "duplicate").when(F.col("_cut"), "truncated")
    return held.join(seen, ["_part", "_idx"], "left").select("conv_id", "turn", "role", "text", "_part", "_idx", fault.alias("fault"))


def repair(rows: DataFrame) -> DataFrame:
    """Each row with its edits: conv_id, turn, role, text, fault, `audit` (letters of the row, inserts before it and after the last included), `messages` (what it becomes: structs of role and text), `cost` of its conversation on the first row, `_part`, `_idx`."""
    bounded_batches(rows.sparkSession)
    marked = stored(faults(rows), "faults")
    initial = F.left("role", F.lit(1))
    symbol = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(symbol)).otherwise(symbol)
    cut = marked.select("conv_id", "_part", "_idx", F.floor(F.col("_idx") / BLOCK).alias("_block"), symbol.alias("_symbol"))
    listed = F.array_sort(F.collect_list(F.struct("_idx", "_symbol")))
    blocks = cut.groupBy("conv_id", "_part", "_block").agg(listed.alias("_rows"))
    blocks = blocks.select("conv_id", "_part", "_block", F.col("_rows")[0]["_idx"].alias("_from"), F.array_join("_rows._symbol", "").alias("symbols"))
    costs = _mapped(blocks, "costs array<long>", _within)
    back = costs.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("_part"), F.desc("_block"))
    back = stored(_mapped(back, "after array<long>, cost long", _chained_costs).drop("costs"), "blocks")
    ways = _mapped(back, "ways array<string>, ends array<int>", _traced)
    on = _mapped(ways.repartition("conv_id").sortWithinPartitions("conv_id", "_part", "_block"), "way string, end int, opening boolean", _chosen)
    tokens = on.select("_part", "_from", F.when(F.col("opening"), F.col("cost")).alias("_cost"), "end", F.posexplode(F.split("way", " ")).alias("_at", "audit"))
    tokens = tokens.select("_part", (F.col("_from") + F.col("_at")).alias("_idx"), "audit", F.when(F.col("_at") == 0, F.col("_cost")).alias("cost"), "end")
    last = marked.groupBy("conv_id").agg(F.max(F.struct("_part", "_idx")).alias("_at")).select("_at._part", "_at._idx", F.lit(True).alias("_last"))
    tail = F.element_at(F.array(*(F.lit(trailing(q)) for q in range(4))), F.col("end") + 1)
    tokens = tokens.join(last, ["_part", "_idx"], "left").withColumn("_tail", F.when(F.col("_last"), tail).otherwise(""))
    got = marked.join(tokens, ["_part", "_idx"])

    def added(letters: Column) -> Column:
        return F.transform(F.filter(F.split(letters, ""), lambda x: x.isin("i", "I")), lambda x: F.struct(F.when(x == "i", "user").otherwise("assistant").alias("role"), F.lit("").alias("text")))

    letter = F.right("audit", F.lit(1))
    own = F.struct(F.when(letter == "r", "user").when(letter == "R", "assistant").otherwise(F.col("role")).alias("role"), F.col("text").alias("text"))
    messages = F.concat(added(F.col("audit")), F.filter(F.array(own), lambda _: letter != "D"), added(F.col("_tail")))
    return got.select("conv_id", "turn", "role", "text", "fault", F.upper(F.concat("audit", "_tail")).alias("audit"), messages.alias("messages"), "cost", "_part", "_idx")


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_COUNTS = ("blank", "duplicate", "truncated")


def report(repaired: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, counts of faults, gaps in the turns, illegal neighbours, cost, audit and digest of the repaired text."""
    lines = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    lines = F.when(F.size("messages") > 0, lines)
    source = repaired.select("conv_id", F.col("turn").cast("long").alias("turn"), F.left("role", F.lit(1)).alias("initial"), "fault", "cost", "audit", lines.alias("lines"), "_part", "_idx")
    source = source.repartition("conv_id").sortWithinPartitions("conv_id", "_part", "_idx").drop("_part", "_idx")
    schema = StructType([*source.select("conv_id").schema, *StructType.fromDDL(REPORT)])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None

        def ended() -> dict:
            assert now is not None
            gaps = now["turn"] - now["least"] + 1 - now["turns"] if now["turns"] else 0
            counts = {c: now[c] for c in (*_COUNTS, "illegal", "cost", "conv_id")}
            return counts | {"gaps": gaps, "audit": "".join(now["audit"]), "repaired_sha256": now["sha"].hexdigest()}

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if now is None or r["conv_id"] != now["conv_id"]:
                    if now is not None:
                        out.append(ended())
                    now = dict.fromkeys((*_COUNTS, "illegal", "turns"), 0) | {"conv_id": r["conv_id"], "turn": None, "least": r["turn"], "cost": r["cost"], "audit": [], "sha": hashlib.sha256(), "any": False, "initial": None}
                if r["turn"] is not None and r["turn"] != now["turn"]:
                    now["least"] = r["turn"] if now["least"] is None else now["least"]
                    now["turns"] += 1
                    now["turn"] = r["turn"]
                if r["fault"]:
                    now[r["fault"]] += 1
                if now["initial"] is not None and now["initial"] + r["initial"] not in LEGAL:
                    now["illegal"] += 1
                now["initial"] = r["initial"]
                now["audit"].append(r["audit"])
                if r["lines"] is not None:
                    now["sha"].update((("\n" if now["any"] else "") + r["lines"]).encode())
                    now["any"] = True
            if out:
                yield pa.RecordBatch.from_pylist(out, kinds)
        if now is not None:
            yield pa.RecordBatch.from_pylist([ended()], kinds)

    return source.mapInArrow(run, schema)
