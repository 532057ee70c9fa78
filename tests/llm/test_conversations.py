"""Conversation repair against a search over all lists of edits, with rows cut into blocks of any size."""

import hashlib
import heapq
import random
import re

import pytest

from tessera.llm import conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def _cheapest(rows):
    """Edits of (role, text, fault) rows by a search in order of (cost, audit): the first complete list is the answer."""
    heap = [(0, "", 0, "", ())]
    done = set()
    while heap:
        cost, audit, at, roles, out = heapq.heappop(heap)
        if at == len(rows) and LEGAL.fullmatch(roles):
            return cost, audit, out
        # all that matters of what was written is its end
        if (at, roles[-1:]) in done or not (roles == "" or any(LEGAL.fullmatch(roles + end) for end in ("", "a", "ua"))):
            continue
        done.add((at, roles[-1:]))
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 5, audit + "I", at, roles + role[0], (*out, f"{role}:")))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, roles, out))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if role[:1]:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, roles + role[:1], (*out, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + more + 1, audit + "R", at + 1, roles + new[0], (*out, f"{new}:{text}")))


def _plain(rows):
    """{conv_id: report} of (conv_id, turn, role, text) rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((-1 << 60) if t is None else t, " " if role is None else role, " " if x is None else x) for c, t, role, x in rows if c == conv)
        marked, seen = [], set()
        for _, role, text in own:
            stripped = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else None
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [t for t, _, _ in own if t != -1 << 60]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, lines = _cheapest(marked)
        initials = [r[:1] for r, _, _ in marked]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        count = [sum(f == k for _, _, f in marked) for k in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def _got(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in conversations.report(conversations.repair(df)).collect()}


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_against_search(spark, monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK", block)
    rng = random.Random(block)
    texts = ["a.", "b!", "c?", "d", "", " \t", "e. ", "f.\n", None, "é", "g."]
    rows = []
    for conv in [None, *range(120)]:
        n = rng.randrange(1, 14)
        turns = sorted(rng.choice([None, 1, 2, 5, 9, 12, 13, 14]) or 0 for _ in range(n))
        for k in range(n):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "u", "said"])
            rows.append((conv, turns[k] or None, role, rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}."))
    assert _got(spark.createDataFrame(rows, SCHEMA)) == _plain(rows)


def test_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK", 64)
    rng = random.Random(5)
    rows = [(7, i, rng.choice(["user", "assistant", "system"]), f"text {i}" + rng.choice(["", ".", "!"])) for i in range(3000)]
    rows += [(7, 3000, "user", "the same row.")] * 500  # one group of copies
    assert _got(spark.createDataFrame(rows, SCHEMA)) == _plain(rows)


def test_edges(spark):
    schema = SCHEMA + ", cost long, _part string, audit string, Messages string"
    rows = [(1, 0, "user", "x" * 300_000 + ".", 1, "p", "z", "m"), (1, 1, "assistant", "ok.", 1, "p", "z", "m"), (2, None, None, None, None, None, None, None)]
    got = conversations.report(conversations.repair(spark.createDataFrame(rows, schema)))
    assert got.columns == ["conv_id", *(x.split(" ")[0] for x in conversations.REPORT.split(", "))]
    by = {r.conv_id: r for r in got.collect()}
    assert (by[1].audit, by[1].cost, by[2].audit, by[2].cost, by[2].blank, by[2].gaps) == ("KK", 0, "D", 2, 1, 0)
    assert _got(spark.createDataFrame([], SCHEMA)) == {}


def test_messages(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "assistant", "c.")]
    got = conversations.repair(spark.createDataFrame(rows, SCHEMA)).orderBy("turn").collect()
    assert "".join(r.audit for r in got) == "DKK"
    assert [(m.role, m.text) for r in got for m in r.messages] == [("user", "b."), ("assistant", "c.")]


def test_query(spark):
    got = queries.QUERIES["op11_conversation_repair"](spark, "/root/testdata/sf0.001")
    kinds = dict(got.dtypes)
    assert kinds["conv_id"] == "bigint" and all(kinds[c] == "bigint" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    rows = queries.damaged(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")).collect()
    want = _plain([tuple(r) for r in rows])
    found = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got.collect()}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found == {c: want.get(c, nothing) for c in found} and want.keys() <= found.keys()
