from __future__ import annotations

import difflib
import random

import pytest
from pyspark.sql import functions as F

from modlens.functions import linediff, regexes, text


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_patterns_are_translated(spark):
    cases = [("(?i)é", "É", True), ("a$", "a\n", False), (r"^\w$", "é", True), ("[$]", "a$b", True), (r"\$", "a$", True), ("b", "abc", True)]
    for p, s, want in cases:
        assert one(spark, F.lit(s).rlike(regexes.compiled(p))) is want, p


@pytest.mark.parametrize("p", ["(?=a)", "(?<!a)b", r"(a)\1", "(", "[a"])
def test_bad_patterns_name_their_field(p):
    with pytest.raises(regexes.BadPattern, match="include of mine"):
        regexes.compiled(p, "include", "mine")


def test_first_index(spark):
    df = spark.createDataFrame([("ab",), ("b",), ("z",)], "s string").select("s", regexes.first_index(F.col("s"), ["^a", "b"]).alias("i"))
    assert [tuple(r) for r in df.collect()] == [("ab", 0), ("b", 1), ("z", None)]
    assert spark.range(1).select(regexes.first_index(F.lit("a"), [])).first()[0] is None


@pytest.mark.parametrize(("s", "want"), [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\n\n", ["a", ""]), ("a\r\nb", ["a", "b"]), ("\n", [""])])
def test_lines(spark, s, want):
    assert one(spark, text.lines(F.lit(s))) == want
    assert one(spark, text.numbered(text.lines(F.lit(s)))) == list(range(1, len(want) + 1))


def test_read_lines_and_difference(spark):
    assert one(spark, text.read_lines(F.lit("a\nb\nc\n"), 2, 5)) == ["b", "c"]
    a, b = F.array(F.lit("z"), F.lit("a"), F.lit("z")), F.array(F.lit("b"))
    assert one(spark, text.set_difference(a, b)) == ["a", "z"]
    assert one(spark, text.set_difference(F.lit(None).cast("array<string>"), b)) == []


def test_matching_is_longest():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.choice("abc") + "\n" for _ in range(rng.randint(0, 9))] for _ in range(2))
        pairs = linediff.matched(a, b)
        p = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                p[i + 1][j + 1] = p[i][j] + 1 if a[i] == b[j] else max(p[i][j + 1], p[i + 1][j])
        assert len(pairs) == p[-1][-1] and all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))


def test_hunks_are_those_of_a_unified_diff():
    a, b = [f"l{i}\n" for i in range(20)], [f"l{i}\n" for i in range(20) if i not in (3, 15)] + ["new\n"]
    want = "".join(difflib.unified_diff(a, b, "old", "new", n=2)).replace("--- old\n", "--- old\n")
    assert linediff.hunks(a, b, linediff.matched(a, b), 2) == want


def test_compare():
    import re

    noise = re.compile("babelHelpers")
    assert linediff.compare("", "", None)[2] == 1.0
    assert linediff.compare("a\nbabelHelpers.extends(a)\n", "a\nbabelHelpers.extends(b)\n", noise)[:4] == (1, 1, 0.5, True)
    assert linediff.compare("a", "a\n", None)[:2] == (1, 1)
    cut = linediff.compare("", "é" * 100 + "\n", None, most_bytes=50)
    assert cut[4].endswith(linediff.TRUNCATED) and cut[5]


def test_flags_in_the_middle():
    """(?i) holds to the end of its group, through later alternatives, in both engines."""
    import re

    cases = [("a(?i)b|c", "aB", True), ("a(?i)b|c", "C", True), ("a(?i)b", "AB", False), ("(x(?i)y)z", "xYz", True), ("(x(?i)y)z", "xYZ", False), (r"[(?i)]$", "(", True), (r"a$", "a\n", False)]
    for p, s, want in cases:
        assert bool(re.search(regexes.to_python(p), s)) is want, p


def test_large_texts_take_little_memory():
    import tracemalloc

    a, b = [f"old {i}\n" for i in range(4000)], [f"new {i}\n" if i % 2 else f"old {i}\n" for i in range(4000)]
    tracemalloc.start()
    got = linediff.matched(a, b[::-1][:2000] + b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 2000 and peak < 40 << 20
