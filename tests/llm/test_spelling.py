"""Spelling variants against a comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from tessera.llm import queries, spelling

SCHEMA = "doc_id long, text string"


def _counts(docs):
    seen = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}


def _near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _plain(counts):
    form, out = {}, {}
    for w, n in counts.items():
        near = [v for v in counts if _near(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
        out[w] = [n, len(near), form[w] and counts[form[w]], form[w]]
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w].append(root)
    return {w: tuple(v) for w, v in out.items()}


def _got(df):
    return {r.word: (r.n, r.n_near, r.form_n, r.form, r.root) for r in df.collect()}


@pytest.mark.parametrize(("most", "letters"), [(20_000, "abé"), (7, "abé"), (40, "aÿ×")])
def test_against_pairs(spark, monkeypatch, most, letters):
    monkeypatch.setattr(spelling, "GROUP_WORDS", most)
    rng = random.Random(most)
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 9))) for _ in range(400)]
    docs = [(i, " ".join(rng.choice(words[: rng.randrange(2, 400)]) for _ in range(60))) for i in range(60)]
    docs += [(7, docs[0][1]), (7, docs[0][1]), (None, "Wordéä WORDéä wordÉä"), (None, None), (3, "")]
    assert _got(spelling.variants(spark.createDataFrame(docs, SCHEMA))) == _plain(_counts(docs))


def test_automaton():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(300)})
    a = spelling.Automaton(words)
    for w in words + ["zzz", "abcabc"]:
        for k in range(len(w)):
            assert {words[i] for i in a.one_error(w, k)} == {v for v in words if _near(w, v) and v.startswith(w[:k])}
    ends = ["x" + tail for tail in ("aa", "ab", "b")]
    shared = spelling.Automaton(sorted(ends + ["y" + e[1:] for e in ends]))
    assert len(shared.arcs) == 4  # minimal: both beginnings lead to one state


def test_long_words(spark):
    long = "a" * 30_000
    docs = [(i, f"{long} {long}b {'ab' * 5000} {'ab' * 5000}a") for i in range(4)]
    rows = _got(spelling.variants(spark.createDataFrame(docs, SCHEMA)))
    n = {w: v[0] for w, v in rows.items()}
    assert rows[long][1] == 1 + (long[1:] in n) and n == _counts(docs)


def test_edges(spark):
    empty = spelling.variants(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    docs = [(1, "hello " * 5, "w", 1), (2, "hellos", "w", 1)]
    rows = spelling.variants(spark.createDataFrame(docs, SCHEMA + ", word string, n long")).collect()
    assert [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows] == [("hello", None, "hello", 5, 0, None)]
    chain = [("aaaaa", "aaaab"), ("aaaab", "aaabb"), ("aaabb", "aabbb"), ("aabbb", "abbbb"), ("abbbb", "bbbbb")]
    roots = spelling.roots(spark.createDataFrame(chain, "word string, form string"))
    assert {tuple(r) for r in roots.collect()} == {(w, "bbbbb") for w, _ in chain}


def test_query(spark):
    got = queries.QUERIES["op12_spelling_variants"](spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes) == dict(word="string", form="string", root="string", n="bigint", n_near="bigint", form_n="bigint")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows, counts = _got(got), _counts(docs)
    assert {w: v[0] for w, v in rows.items()} == counts
    assert {w: rows[w] for w in rows if w[0] == "d"} == {w: v for w, v in _plain({w: n for w, n in counts.items()}).items() if w[0] == "d"}
