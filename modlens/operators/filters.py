"""Rule filters: verdicts with reasons, and exclusion along the dependency graph."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import regexes
from ..functions.builtin_filters import BUILTIN, blank
from ..functions.scratch import cut

FIELDS = {"name", "description", "hardExclude", "include", "exclude", "defaultVerdict", "excludeDependentsOfExcluded", "noiseDeps", "noiseCode", "builtin"}
PATCH = FIELDS - {"name", "builtin"}


def patched(base: dict, patch: dict) -> dict:
    """base with the given fields; unknown fields are refused."""
    if unknown := set(patch) - PATCH:
        raise ValueError(f"unknown fields: {', '.join(sorted(unknown))}")
    return base | patch


def check(spec: dict) -> dict:
    """Raises BadPattern naming field and filter if a pattern does not compile."""
    for field in ("hardExclude", "include", "exclude", "noiseDeps", "noiseCode"):
        for p in spec[field]:
            regexes.compiled(p, field, spec["name"])
    if spec["defaultVerdict"] not in ("keep", "drop"):
        raise ValueError(f"defaultVerdict of {spec['name']}: {spec['defaultVerdict']!r}")
    return spec


def verdict(name: Column, spec: dict) -> Column:
    """True to keep: hard exclusions, then inclusions, then exclusions, then the default."""
    hit = lambda field: regexes.matches_any(name, spec[field], field, spec["name"])
    return F.when(hit("hardExclude"), False).when(hit("include"), True).when(hit("exclude"), False).otherwise(spec["defaultVerdict"] == "keep")


def classify(names: DataFrame, spec: dict) -> DataFrame:
    """names with verdict, reason and pattern: the first matching pattern of the list that decided."""
    at = {f: regexes.first_index(F.col("name"), spec[f], f, spec["name"]) for f in ("hardExclude", "include", "exclude")}
    out = names.withColumns({f"_{f}": c for f, c in at.items()})
    pick = lambda f: F.get(F.array(*[F.lit(p) for p in spec[f]]) if spec[f] else F.expr("cast(array() as array<string>)"), F.col(f"_{f}"))
    hard, include, exclude = (F.col(f"_{f}").isNotNull() for f in ("hardExclude", "include", "exclude"))
    keep = spec["defaultVerdict"] == "keep"
    return out.withColumns({
        "verdict": F.when(hard, "drop").when(include, "keep").when(exclude, "drop").otherwise("keep" if keep else "drop"),
        "reason": F.when(hard, "hardExclude").when(include, "include").when(exclude, "exclude").otherwise("default"),
        "pattern": F.when(hard, pick("hardExclude")).when(include, pick("include")).when(exclude, pick("exclude")),
    }).drop("_hardExclude", "_include", "_exclude")


def apply(records: DataFrame, spec: dict, edges: DataFrame | None = None) -> DataFrame:
    """name, verdict, reason, pattern, module of every record (name, deps).

    With excludeDependentsOfExcluded, what depends on a dropped record is dropped too, level by level, but
    for records that an include pattern pins.  module is the dropped record that reached it first: within a
    level the order is that of the path from a dropped record, compared name by name, so no global ranking is
    needed.  Every level is written out; a level moves the edges into its own frontier only.
    """
    own = classify(records.select("name"), spec).withColumn("module", F.lit(None).cast("string"))
    if not spec["excludeDependentsOfExcluded"]:
        return own
    if edges is None:
        edges = records.select(F.col("name").alias("src"), F.explode("deps").alias("dst")).distinct()
    own = cut(own)
    free = own.where("verdict = 'keep' and reason <> 'include'").select(F.col("name").alias("src"))
    links = cut(edges.select("src", "dst").join(free, "src", "left_semi"))  # only these can still change
    frontier = own.where("verdict = 'drop'").select("name", F.col("name").alias("place"))
    levels = []
    while True:
        found = links.join(frontier.select(F.col("name").alias("dst"), "place"), "dst").groupBy(F.col("src").alias("name")).agg(F.min(F.struct("place", "dst")).alias("from"))
        for seen in levels:
            found = found.join(seen.select("name"), "name", "left_anti")
        # the path grows by one name a level; U+0001 parts names and is below all that stands in them
        new = cut(found.select("name", F.col("from.dst").alias("module"), F.concat("from.place", F.lit("\u0001"), "name").alias("place")))
        if new.isEmpty():
            break
        levels.append(new.select("name", "module"))
        if len(levels) > SEPARATE:
            levels = [cut(union(levels))]
        frontier = new.select("name", "place")
    if not levels:
        return own
    reached = union(levels)
    late = reached.select("name", F.col("module").alias("_module"))
    return own.join(late, "name", "left").select(
        "name", F.when(F.col("_module").isNotNull(), "drop").otherwise(F.col("verdict")).alias("verdict"),
        F.when(F.col("_module").isNotNull(), "dependsOnExcluded").otherwise(F.col("reason")).alias("reason"),
        F.when(F.col("_module").isNull(), F.col("pattern")).alias("pattern"), F.col("_module").alias("module"),
    )


SEPARATE = 8  # so many tables of reached names are joined one by one, then they are written as one


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def kept(records: DataFrame, spec: dict) -> DataFrame:
    """Names that the filter keeps, propagation included."""
    if not spec["excludeDependentsOfExcluded"]:
        return records.where(verdict(F.col("name"), spec)).select("name")
    return apply(records, spec).where("verdict = 'keep'").select("name")


def breakdown(decisions: DataFrame) -> DataFrame:
    """Dropped records by reason."""
    return decisions.where("verdict = 'drop'").groupBy("reason").agg(F.count("*").alias("n"))


def samples(decisions: DataFrame, n: int) -> DataFrame:
    """The first n kept and the first n dropped names."""
    part = lambda v: decisions.where(F.col("verdict") == v).select("verdict", "name", "reason").orderBy("name").limit(n)
    return part("keep").unionByName(part("drop"))


def is_noise_dep(name: Column, spec: dict) -> Column:
    return regexes.matches_any(name, spec["noiseDeps"], "noiseDeps", spec["name"])


def valid_name(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_-]+", name):
        raise ValueError(f"a filter's name has letters, digits, _ and - only: {name!r}")
    return name


__all__ = ["BUILTIN", "apply", "blank", "breakdown", "check", "classify", "is_noise_dep", "kept", "patched", "samples", "valid_name", "verdict"]
