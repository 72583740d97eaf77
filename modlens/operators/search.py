"""Search over names, exports and source lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import regexes, text as X


def _pattern(p: str | None, field: str) -> str | None:
    return None if p is None else regexes.compiled(p, field)


def candidates(records: DataFrame, name: str | None = None, exports: str | None = None, kept: DataFrame | None = None) -> DataFrame:
    """Records that pass the filter, the name and the export pattern; reads no texts."""
    if kept is not None:
        records = records.join(kept.select("name"), "name", "left_semi")
    if p := _pattern(name, "name"):
        records = records.where(F.col("name").rlike(p))
    if p := _pattern(exports, "exports"):
        records = records.where(F.exists("exports", lambda e: e.rlike(p)))
    return records


def line_matches(texts: DataFrame, source: str, context: int = 0, most: int = 5) -> DataFrame:
    """texts (with name and text) to name, match_count and matches: matching lines from 1, with context lines
    clipped at the ends of the text.

    Lines, then matches, are columns of their own: an expression inside a lambda would be worked out anew for
    each element.
    """
    p = _pattern(source, "source")
    numbered = F.transform("lines", lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    found = F.filter(numbered, lambda m: m.text.rlike(p))
    rows = texts.select("name", X.lines(F.col("text")).alias("lines")).select("name", *["lines"] * (context > 0), found.alias("found"))
    if context:
        before = lambda m: F.slice("lines", F.greatest(m.line - context, F.lit(1)), F.least(m.line - 1, F.lit(context)))
        after = lambda m: F.slice("lines", m.line + 1, F.lit(context))
    else:
        before = after = lambda m: F.expr("cast(array() as array<string>)")
    one = lambda m: F.struct(m.line.alias("line"), m.text.alias("text"), before(m).alias("before"), after(m).alias("after"))
    return rows.where("size(found) > 0").select("name", F.size("found").alias("match_count"), F.transform(F.slice("found", 1, most), one).alias("matches"))


@dataclass
class Result:
    hits: DataFrame
    candidates: DataFrame
    matched: DataFrame
    limit: int
    unreadable: DataFrame | None = None

    def stats(self) -> dict:
        n, m = self.candidates.count(), self.matched.count()
        return {"candidates": n, "matched": m, "truncated": m > self.limit}


def search(records: DataFrame, sources: DataFrame | None = None, name: str | None = None, exports: str | None = None, source: str | None = None,
           kept: DataFrame | None = None, context: int = 0, most: int = 5, limit: int = 50) -> Result:
    """hits by name, limited; without a source pattern no text is read.  Texts are those of the primaries."""
    cand = candidates(records, name, exports, kept)
    if source is None:
        rows = cand.select("name", F.lit(0).alias("match_count"), F.lit(None).cast("array<struct<line:int,text:string,before:array<string>,after:array<string>>>").alias("matches"))
        return Result(rows.orderBy("name").limit(limit), cand, rows, limit)
    texts = cand.select("name", F.col("raw_sha256").alias("sha256")).join(sources.select("name", "sha256", "text"), ["name", "sha256"], "left")
    missing = texts.where("text is null").select("name").orderBy("name")
    rows = line_matches(texts.where("text is not null"), source, context, most)
    return Result(rows.orderBy("name").limit(limit), cand, rows, limit, missing)


def get(records: DataFrame, sources: DataFrame, name: str, start: int = 1, count: int = 1 << 30) -> DataFrame:
    """One record with lines of its text."""
    own = records.where(F.col("name") == name)
    return own.join(sources.select("name", F.col("sha256").alias("raw_sha256"), "text"), ["name", "raw_sha256"], "left").withColumn("lines", X.read_lines(F.col("text"), start, count)).drop("text")


def suggest(records: DataFrame, name: str, n: int = 10) -> DataFrame:
    """The first n names that contain the name or stand in it, upper and lower case alike."""
    low, own = F.lower(F.lit(name)), F.lower("name")
    return records.where(F.contains(own, low) | F.contains(low, own)).select("name").orderBy("name").limit(n)


def grep(records: DataFrame, sources: DataFrame, pattern: str, **options) -> Result:
    return search(records, sources, source=pattern, **options)
