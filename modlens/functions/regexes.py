"""Patterns: find semantics, checked on the driver, in the JVM's dialect.

The dialect accepted is that of linear-time engines: no look-around, no back-references.
Three things read otherwise in the JVM and are translated: case-insensitivity is Unicode-wide,
classes are Unicode classes, and `$` stands only at the very end.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


class BadPattern(ValueError):
    """Names the field and the owner of a pattern that does not compile."""


def to_java(pattern: str) -> str:
    if re.search(r"\(\?(?:[=!]|<[=!])", pattern):
        raise BadPattern(f"look-around is not supported: {pattern!r}")
    out, i, in_class, unicode_ = [], 0, False, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            if n.isdigit() and n != "0" and not in_class:
                raise BadPattern(f"back-references are not supported: {pattern!r}")
            unicode_ |= n in "wWdDsSbB"
            out.append("\\" + n)
            i += 2
            continue
        if c == "[":
            in_class = True
        elif c == "]":
            in_class = False
        if c == "$" and not in_class:
            out.append("\\z")
        elif pattern.startswith("(?i)", i):
            out.append("(?iu)")
            i += 4
            continue
        else:
            out.append(c)
        i += 1
    return ("(?U)" if unicode_ else "") + "".join(out)


def to_python(pattern: str) -> str:
    """The same dialect for Python's engine, which takes flags in the middle only around a group: (?i) holds up to
    the end of the group that it stands in, through later alternatives."""
    out, i, in_class, groups = [], 0, False, [False]  # for each open group whether (?i) holds in it
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append("\\Z" if pattern[i + 1] == "z" and not in_class else pattern[i : i + 2])
            i += 2
            continue
        if in_class:
            in_class = c != "]"
            out.append(c)
        elif pattern.startswith("(?i)", i):
            out.append("" if groups[-1] else "(?i:")
            groups[-1] = True
            i += 4
            continue
        elif c == "[":
            in_class = True
            out.append(c)
        elif c == "(":
            groups.append(False)
            out.append(c)
        elif c == ")":
            out.append("))" if groups.pop() else ")")
        elif c == "|" and groups[-1]:
            out.append(")|(?i:")
        else:
            out.append("\\Z" if c == "$" else c)
        i += 1
    return "".join(out) + ")" * sum(groups)


def compiled(pattern: str, field: str = "pattern", owner: str = "") -> str:
    """The pattern for rlike; raises BadPattern with the field's name."""
    try:
        re.compile(pattern.replace("(?i)", ""))
        re.compile(to_python(pattern))
        return to_java(pattern)
    except (re.error, IndexError, BadPattern) as e:
        raise BadPattern(f"{field}{f' of {owner}' if owner else ''}: {e}") from e


def any_of(patterns: list[str], field: str = "pattern", owner: str = "") -> str | None:
    """One alternation for a whole list, or None for an empty one."""
    java = [compiled(p, field, owner) for p in patterns]
    return "|".join(f"(?:{p})" for p in java) if java else None


def matches_any(col: Column, patterns: list[str], field: str = "pattern", owner: str = "") -> Column:
    p = any_of(patterns, field, owner)
    return F.lit(False) if p is None else col.rlike(p)


def first_index(col: Column, patterns: list[str], field: str = "pattern", owner: str = "") -> Column:
    """Index of the first pattern of the list that matches; null if none does."""
    if not patterns:
        return F.lit(None).cast("int")
    chain = None
    for i, p in enumerate(patterns):
        hit = col.rlike(compiled(p, field, owner))
        chain = F.when(hit, F.lit(i)) if chain is None else chain.when(hit, F.lit(i))
    return F.when(matches_any(col, patterns, field, owner), chain)
