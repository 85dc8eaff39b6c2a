"""What a piece of SQL does and which columns it names, without a database.

A small reader over tokens: verbs, tables with their aliases, and names that are neither
functions, keywords, aliases nor inside quotes. It never raises; text that isn't SQL has no
verb and no columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|[A-Za-z_]\w*|\d+(?:\.\d+)?|[^\s]", re.DOTALL)
_VERBS = {"select": "read", "with": "read", "insert": "write", "update": "write"}
_WORDS = frozenset(
    "all and as asc between by case cast cross current_timestamp default delete desc distinct else end except exists false fetch first for from full group having "
    "ilike in inner insert intersect into is join key last lateral left like limit natural next not null nulls offset on only or order outer over partition returning "
    "right row rows select set then true union unique update using values when where window with".split()
)


def _tokens(sql: str) -> list[str]:
    return [t for t in _TOKEN.findall(sql) if not t.startswith(("--", "/*"))]


def _name(token: str) -> str | None:
    """The name that a token is, lower case; None for anything else."""
    if token[:1] in "\"`" and len(token) > 2:
        return token[1:-1].lower()
    if re.fullmatch(r"[A-Za-z_]\w*", token) and token.lower() not in _WORDS:
        return token.lower()
    return None


def operation(sql: str | None) -> str | None:
    """``write`` for INSERT and UPDATE, ``read`` for SELECT, else None."""
    tokens = _tokens(sql or "")
    words = [t.lower() for t in tokens]
    if len(tokens) < 2 or words[0] not in _VERBS or any(t in "\"`'" for t in tokens):
        return None
    if words[0] == "with":
        return next((_VERBS[w] for w in words if w in ("insert", "update", "select")), None)
    if words[0] == "insert" and "into" not in words or words[0] == "update" and "set" not in words:
        return None
    return _VERBS[words[0]]


def columns(sql: str | None) -> list[str]:
    """``sql:table.column`` of every column named, aliases resolved; bare ones belong to the first table."""
    tokens = _tokens(sql or "")
    if operation(sql) is None and (not tokens or tokens[0].lower() != "delete"):
        return []
    words = [t.lower() for t in tokens]
    tables: list[str] = []
    alias: dict[str, str] = {}
    used: set[int] = set()
    i = 0
    while i < len(tokens):
        if words[i] in ("from", "into", "join", "update") or words[i] == "," and tables and _in_from(words, i):
            j = i + 1
            name = _name(tokens[j]) if j < len(tokens) else None
            if name is not None:
                used.add(j)
                while j + 2 < len(tokens) and tokens[j + 1] == "." and _name(tokens[j + 2]) is not None:
                    j += 2
                    used.add(j)
                    name = _name(tokens[j])
                tables.append(name)
                if j + 1 < len(tokens) and words[j + 1] == "as":
                    j += 1
                if j + 1 < len(tokens) and (other := _name(tokens[j + 1])) is not None:
                    alias[other] = name
                    used.add(j + 1)
                    j += 1
                i = j
        i += 1
    if not tables:
        return []
    found: set[str] = set()
    i = 0
    while i < len(tokens):
        name = _name(tokens[i])
        if name is None or i in used:
            i += 1
            continue
        after = tokens[i + 1] if i + 1 < len(tokens) else ""
        if after == "." and i + 2 < len(tokens) and _name(tokens[i + 2]) is not None:
            column = i + 2
            owner = name
            while column + 2 < len(tokens) and tokens[column + 1] == "." and _name(tokens[column + 2]) is not None:
                owner, column = _name(tokens[column]), column + 2
            if not (column + 1 < len(tokens) and tokens[column + 1] == "("):
                found.add(f"sql:{alias.get(owner, owner)}.{_name(tokens[column])}")
            i = column + 1
            continue
        named = i and (words[i - 1] == "as" or tokens[i - 1] in (".", ":", "@", "$"))
        if after not in ("(", ".") and not named:
            found.add(f"sql:{tables[0]}.{name}")
        i += 1
    return sorted(found)


def _in_from(words: list[str], i: int) -> bool:
    """Whether the comma stands in a list of tables."""
    depth = 0
    for w in reversed(words[:i]):
        depth += (w == ")") - (w == "(")
        if depth < 0:
            return False
        if depth == 0 and w in ("from", "where", "on", "set", "select", "by", "having", "values", "join", "into", "update"):
            return w == "from"
    return False


@F.pandas_udf(T.StringType())
def sql_operation(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known = lru_cache(4096)(operation)
    for texts in batches:
        yield texts.map(known)


@F.pandas_udf(T.ArrayType(T.StringType()))
def sql_columns(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known = lru_cache(4096)(columns)
    for texts in batches:
        yield texts.map(known)


#: Group 2 is the SQL between a pair of equal quotes.
_MARKS = "'\"`"
SELECT_LITERAL = rf"(?i)([{_MARKS}])(\s*select\b[^{_MARKS}]*?)\1"
