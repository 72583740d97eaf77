"""Column expressions on texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_EMPTY = "cast(array() as array<string>)"


def lines(text: Column) -> Column:
    """Lines without terminators; a final line end opens no further line; null stays null."""
    parts = F.split(F.regexp_replace(text, "\r?\n\\z", ""), "\r?\n", -1)
    return F.when(text == "", F.expr(_EMPTY)).otherwise(parts)


def numbered(rows: Column) -> Column:
    """1, 2, ... for each element."""
    return F.when(F.size(rows) > 0, F.sequence(F.lit(1), F.size(rows))).otherwise(F.expr("cast(array() as array<int>)"))


def read_lines(text: Column, start: int, count: int) -> Column:
    """`count` lines from line `start` (from 1)."""
    return F.slice(lines(text), max(start, 1), count)


def set_difference(a: Column, b: Column) -> Column:
    """Elements of a not in b, sorted, each once; null arrays are empty."""
    empty = F.expr(_EMPTY)
    return F.array_sort(F.array_except(F.coalesce(a, empty), F.coalesce(b, empty)))
