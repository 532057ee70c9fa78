"""Plain versions of the operators, for small fixtures."""

import hashlib
import re
from collections import Counter

from tessera.llm import secret_scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_az(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingle_set(text, width):
    words = WORD.findall(lower_az(text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def jaccard(docs, width, percent):
    """[(doc_id, set size, component id)]"""
    sets = [shingle_set(t, width) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(docs)]


def substring(docs, width):
    """[(doc_id, words, removed, kept text)]"""
    seen = Counter(tuple(w[i : i + width]) for _, t in docs for w in [WORD.findall(t or "")] for i in range(len(w) - width + 1))
    out = []
    for d, t in docs:
        w, gone = WORD.findall(t or ""), set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone |= set(range(i, i + width))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def secrets(text):
    """[(start, rank, kind, end)] of every rule."""
    out = []
    for rank, r in enumerate(secret_scan.RULES):
        pattern = r"[0-9a-f]+" if r.kind == "hex" else r.pattern
        out += [(m.start(), rank, r.kind, m.end()) for m in re.finditer(pattern, text or "", re.ASCII) if len(m[r.group]) >= r.least]
    return sorted(out)


def masked(text, mask="[SECRET]"):
    out, done = [], 0
    for start, _, _, end in secrets(text):
        if start >= done:
            out += [text[done:start], mask]
        done = max(done, end)
    return "".join(out) + text[done:]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
