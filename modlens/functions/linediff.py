"""Line differences of two texts, as an Arrow batch function."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from . import regexes

RESULT = "lines_added int, lines_removed int, similarity double, noise_only boolean, hunks string, hunks_omitted string"
TRUNCATED = "\n… [truncated: exceeded maxHunkBytes]\n"


def split_keep(text: str) -> list[str]:
    """Lines with their terminators: a missing last line end is a difference."""
    return re.findall(r"[^\n]*\n|[^\n]+", text)


def _prefix_lengths(x: list[int], y: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of x with each prefix of y, by bit-parallel rows of one integer."""
    where: dict[int, int] = {}
    for j, w in enumerate(y):
        where[w] = where.get(w, 0) | 1 << j
    full = (1 << len(y)) - 1
    v = full
    for w in x:
        if m := where.get(w):
            u = v & m
            v = (v + u | v - u) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _common(x: list[int], y: list[int], i: int, j: int, out: list[tuple[int, int]]) -> None:
    """Divide and conquer: memory follows the number of lines."""
    todo = [(x, y, i, j)]
    while todo:
        x, y, i, j = todo.pop()
        head = 0
        while head < min(len(x), len(y)) and x[head] == y[head]:
            head += 1
        out += [(i + t, j + t) for t in range(head)]
        x, y, i, j = x[head:], y[head:], i + head, j + head
        tail = 0
        while tail < min(len(x), len(y)) and x[-1 - tail] == y[-1 - tail]:
            tail += 1
        out += [(i + len(x) - t, j + len(y) - t) for t in range(1, tail + 1)]
        x, y = x[: len(x) - tail], y[: len(y) - tail]
        if not x or not y:
            continue
        if len(x) == 1 or len(y) == 1:
            one, many = (x[0], y) if len(x) == 1 else (y[0], x)
            if one in many:
                k = many.index(one)
                out.append((i, j + k) if len(x) == 1 else (i + k, j))
            continue
        mid = len(x) // 2
        sums = _prefix_lengths(x[:mid], y) + _prefix_lengths(x[mid:][::-1], y[::-1])[::-1]
        k = int(sums.argmax())
        todo += [(x[:mid], y[:k], i, j), (x[mid:], y[k:], i + mid, j + k)]


def matched(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence as pairs of places.  Lines that stand on one side only take no part."""
    number: dict[str, int] = {}
    x, y = ([number.setdefault(t, len(number)) for t in side] for side in (a, b))
    both = set(x) & set(y)
    at_x, at_y = ([k for k, w in enumerate(side) if w in both] for side in (x, y))
    pairs: list[tuple[int, int]] = []
    _common([x[k] for k in at_x], [y[k] for k in at_y], 0, 0, pairs)
    return sorted((at_x[i], at_y[j]) for i, j in pairs)


def hunks(a: list[str], b: list[str], pairs: list[tuple[int, int]], context: int) -> str:
    """Unified diff text with the headers old and new."""
    ops, i, j = [], 0, 0
    for p, q in [*pairs, (len(a), len(b))]:
        ops += [("-", i + t, j, a[i + t]) for t in range(p - i)]
        ops += [("+", p, j + t, b[j + t]) for t in range(q - j)]
        if p < len(a) and q < len(b):
            ops.append((" ", p, q, a[p]))
        i, j = p + 1, q + 1
    changed = [k for k, o in enumerate(ops) if o[0] != " "]
    out, k = ["--- old\n", "+++ new\n"], 0
    while k < len(changed):
        e = k
        while e + 1 < len(changed) and changed[e + 1] - changed[e] <= 2 * context + 1:
            e += 1
        part = ops[max(0, changed[k] - context) : changed[e] + context + 1]
        n_old, n_new = sum(o[0] != "+" for o in part), sum(o[0] != "-" for o in part)
        out.append(f"@@ -{part[0][1] + (n_old > 0)},{n_old} +{part[0][2] + (n_new > 0)},{n_new} @@\n")
        out += [o[0] + o[3] + ("" if o[3].endswith("\n") else "\n\\ No newline at end of file\n") for o in part]
        k = e + 1
    return "".join(out)


def compare(old: str, new: str, noise: re.Pattern | None, context: int | None = 3, most_bytes: int = 64 << 10):
    """(added, removed, similarity, noise_only, hunks, hunks_omitted); no hunks where context is None."""
    a, b = split_keep(old), split_keep(new)
    pairs = matched(a, b)
    in_a, in_b = {i for i, _ in pairs}, {j for _, j in pairs}
    gone, come = [x for i, x in enumerate(a) if i not in in_a], [x for j, x in enumerate(b) if j not in in_b]
    signal = sum(not (noise and noise.search(x.rstrip())) for x in gone + come)
    ratio = 2 * len(pairs) / (len(a) + len(b)) if a or b else 1.0
    text = omitted = None
    if signal and context is not None:
        text = hunks(a, b, pairs, context)
        if len(text.encode()) > most_bytes:
            text, omitted = text.encode()[:most_bytes].decode(errors="ignore") + TRUNCATED, "truncated to maxHunkBytes"
    return len(come), len(gone), ratio, signal == 0, text, omitted


def line_diff(old: Column, new: Column, noise_code: list[str], context: int | None = 3, most_bytes: int = 64 << 10) -> Column:
    noise = re.compile("|".join(f"(?:{regexes.to_python(p)})" for p in noise_code)) if noise_code else None

    @F.pandas_udf(RESULT)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [compare(x, y, noise, context, most_bytes) for x, y in zip(a, b, strict=True)]
        return pd.DataFrame(rows, columns=["lines_added", "lines_removed", "similarity", "noise_only", "hunks", "hunks_omitted"])

    return run(old, new)
