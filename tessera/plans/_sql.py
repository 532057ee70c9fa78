"""Pieces of DuckDB SQL that the oracles share."""

from __future__ import annotations


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def count_of(column: str, tokens: tuple[str, ...]) -> str:
    return " + ".join(f"((length({column}) - length(replace({column}, {quoted(t)}, ''))) // {len(t)})" for t in tokens)


def has_any(column: str, tokens: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, {quoted(t)})" for t in tokens) + ")"


LINES = "CASE WHEN text = '' THEN [] ELSE string_split_regex(regexp_replace(text, '\\r?\\n$', ''), '\\r?\\n') END"
