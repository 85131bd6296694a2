"""The little that is read from configured SQL text: markers and column lists."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.spec import MARKER


def with_predicate(query: str, predicate: str) -> str:
    """The query with its one marker replaced.  Text with a marker left in it must
    never run: Spark would take the bare WHERE for an alias and scan everything."""
    if (n := query.count(MARKER)) != 1:
        raise ValueError(f"a source query has exactly one {MARKER}; this has {n}")
    return query.replace(MARKER, f"({predicate})")


def select_columns(query: str) -> list[str] | None:
    """Names in the list between SELECT and FROM, or None.  Splits at every comma; the
    analysed schema is the better source once a session is there."""
    found = re.match(r"(?is)\s*SELECT\s+(.*?)\s+FROM\s", query)
    return [x.strip().split(".")[-1] for x in found[1].split(",")] if found else None


def insert_columns(insert: str) -> list[str] | None:
    """Names in ``INSERT [hint] INTO t (a, b) VALUES``, or None."""
    found = re.search(r"(?is)INSERT\s+(?:/\*\+.*?\*/\s*)?INTO\s+[\w.$\"]+\s*\(([^)]*)\)\s*VALUES", insert)
    return [x.strip() for x in found[1].split(",")] if found else None


def inserted_columns(insert: Column) -> Column:
    """``insert_columns`` of a column of texts: an array of names, null where there is no list."""
    listed = F.regexp_extract(insert, r"(?is)^\s*INSERT\s+(?:/\*\+.*?\*/\s*)?INTO\s+[\w.$\"]+\s*\(([^)]*)\)\s*VALUES", 1)
    return F.when(listed != "", F.transform(F.split(listed, ","), lambda name: F.trim(name)))


def without_hints(sql: str) -> str:
    """Text without optimizer hints of other databases, which Spark does not parse."""
    return re.sub(r"/\*\+.*?\*/\s*", "", sql, flags=re.S)


def placeholders(sql: str) -> int:
    """Question marks outside quotes and comments."""
    return len(re.findall(r"\?", re.sub(r"(?s)'[^']*'|\"[^\"]*\"|--[^\n]*|/\*.*?\*/", "", sql)))


def first_word(text: str) -> str:
    """The first word of a statement, in capitals; comments before it do not count."""
    found = re.match(r"(?s)(?:\s+|--[^\n]*(?:\n|$)|/\*.*?\*/)*(\w*)", text)
    return found[1].upper()


def statement(text: str) -> str:
    """A migration's text without the semicolon at its end, which only a block of statements keeps."""
    text = text.strip()
    return text if first_word(text) in ("BEGIN", "DECLARE") else text.removesuffix(";").rstrip()
