"""Differences of two revisions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import regexes
from ..functions.linediff import line_diff
from ..functions.text import set_difference
from . import filters
from .index import fingerprint

_NONE = "cast(array() as array<string>)"


def kinds(old: DataFrame, new: DataFrame, spec: dict) -> DataFrame:
    """One row for each name that the filter keeps on either side: kind and both sides' facts.  A name that is
    kept on one side only counts as added or removed, present on the other or not."""

    def side(records: DataFrame, mark: str) -> DataFrame:
        own = records.join(filters.kept(records, spec), "name", "left_semi")
        shas = F.transform("variants", lambda v: v.sha256) if "variants" in records.columns else F.expr(_NONE)
        return own.select("name", *[F.col(c).alias(f"{mark}_{c}") for c in ("raw_sha256", "stored_len", "deps", "exports")], fingerprint(F.col("raw_sha256"), shas).alias(f"{mark}_print"))

    both = side(old, "old").join(side(new, "new"), "name", "full_outer")
    kind = F.when(F.col("old_print").isNull(), "added").when(F.col("new_print").isNull(), "removed").when(F.col("old_print") == F.col("new_print"), "unchanged").otherwise("modified")
    return both.withColumn("kind", kind)


def metadata(kinds_: DataFrame, spec: dict) -> DataFrame:
    """Changes with the differences of dependencies (noise left out) and exports; no text is read."""
    p = regexes.any_of(spec["noiseDeps"], "noiseDeps", spec["name"])
    signal = (lambda c: F.filter(c, lambda d: ~d.rlike(p))) if p else (lambda c: c)
    gone, come = set_difference(F.col("old_deps"), F.col("new_deps")), set_difference(F.col("new_deps"), F.col("old_deps"))
    out = kinds_.where("kind <> 'unchanged'").withColumns({
        "deps_added": signal(come), "deps_removed": signal(gone),
        "exports_added": set_difference(F.col("new_exports"), F.col("old_exports")), "exports_removed": set_difference(F.col("old_exports"), F.col("new_exports")),
        "_raw": F.size(come) + F.size(gone),
    })
    quiet = (F.col("kind") == "modified") & (F.col("_raw") > 0) & (F.size("deps_added") + F.size("deps_removed") == 0)
    return out.withColumn("deps_noise_only", quiet).drop("_raw")


def changes(old: DataFrame, new: DataFrame, old_sources: DataFrame, new_sources: DataFrame, spec: dict,
            max_diff_bytes: int = 1 << 20, context: int = 3, max_hunk_bytes: int = 64 << 10) -> DataFrame:
    """All changes.  Texts are compared only for modified records that are small enough on both sides; the
    larger ones take another branch, so the Python function never sees them.  A modified record without a stored
    text is an error that names it; one of unknown length counts as small."""
    return compared(kinds(old, new, spec), old_sources, new_sources, spec, max_diff_bytes, context, max_hunk_bytes)


def compared(kinds_: DataFrame, old_sources: DataFrame, new_sources: DataFrame, spec: dict,
             max_diff_bytes: int = 1 << 20, context: int = 3, max_hunk_bytes: int = 64 << 10) -> DataFrame:
    """changes() of kinds() worked out before; context None leaves the hunks out."""
    meta = metadata(kinds_, spec)
    large = F.coalesce(F.greatest("old_stored_len", "new_stored_len"), F.lit(0)) > max_diff_bytes
    modified = meta.where("kind = 'modified'")
    text = lambda s, m: s.select("name", F.col("sha256").alias(f"{m}_raw_sha256"), F.col("text").alias(f"{m}_text"))
    small = modified.where(~large).join(text(old_sources, "old"), ["name", "old_raw_sha256"], "left").join(text(new_sources, "new"), ["name", "new_raw_sha256"], "left")
    there = lambda m: F.coalesce(f"{m}_text", F.raise_error(F.concat(F.lit(f"no {m} text is stored for "), "name")))
    d = line_diff(there("old"), there("new"), spec["noiseCode"], context, max_hunk_bytes)
    cols = ["name", "kind", "deps_added", "deps_removed", "exports_added", "exports_removed", "deps_noise_only"]
    told = ["lines_added", "lines_removed", "similarity", "noise_only", "hunks", "hunks_omitted"]
    same = (F.col("old_raw_sha256") == F.col("new_raw_sha256")).alias("variant_only")
    one = small.withColumn("d", d).select(*cols, same, *[f"d.{c}" for c in told])
    types = dict(zip(told, ("int", "int", "double", "boolean", "string", "string"), strict=True))
    blank = lambda df, **given: df.select(*cols, F.lit(False).alias("variant_only"), *[F.lit(given.get(c)).cast(types[c]).alias(c) for c in told])
    two = blank(modified.where(large), noise_only=False, hunks_omitted=f"larger than maxDiffBytes ({max_diff_bytes})")
    return one.unionByName(two).unionByName(blank(meta.where("kind <> 'modified'"), noise_only=False))


def listed(changes_: DataFrame, include_noise: bool = False, limit: int | None = None) -> DataFrame:
    """Changes by name; those of noise only are left out unless asked for."""
    out = changes_ if include_noise else changes_.where("not noise_only")
    return out.orderBy("name").limit(limit) if limit is not None else out.orderBy("name")


@dataclass
class Page:
    """The first changes of a list, and whether they are all."""

    changes: DataFrame
    total: int
    truncated: bool


def page(changes_: DataFrame, include_noise: bool = False, limit: int | None = None) -> Page:
    """listed() that tells how many changes there are and whether the list was cut."""
    total = listed(changes_, include_noise).count()
    return Page(listed(changes_, include_noise, limit), total, limit is not None and total > limit)


def summary(kinds_: DataFrame, changes_: DataFrame | None = None, old: DataFrame | None = None, new: DataFrame | None = None) -> DataFrame:
    """One row of counters; with the records of both sides also how many there are before the filter."""
    n = lambda k: F.count_if(F.col("kind") == k).alias(k)
    out = kinds_.agg(n("added"), n("removed"), n("modified"), n("unchanged"), F.count_if(F.col("kind") != "added").alias("old_kept"), F.count_if(F.col("kind") != "removed").alias("new_kept"))
    more = [] if changes_ is None else [changes_.agg(F.count_if("noise_only").alias("noise_only"), F.count_if(F.col("lines_added").isNull() & (F.col("kind") == "modified")).alias("diffs_skipped"))]
    more += [df.agg(F.count("*").alias(c)) for df, c in ((old, "old_total"), (new, "new_total")) if df is not None]
    for one in more:
        out = out.crossJoin(one)  # one row each
    return out


def grouped(changes_: DataFrame, key, names: bool = False) -> DataFrame:
    """Changes by a key and kind: how many, and with names which, in order."""
    told = [F.count("*").alias("n")] + [F.array_sort(F.collect_list("name")).alias("names")] * names
    return changes_.groupBy(key.alias("key"), "kind").agg(*told)
