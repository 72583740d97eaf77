"""From definitions to records: grouping, variants, reverse edges, file names, diagnostics.

A definition is one occurrence of a name in a chunk: (name, chunk, pos, deps, exports,
functions, raw_sha256, raw_len, stored_len, form); texts stay in a table of their own, so
that nothing here moves them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import set_difference

FACTS = ["deps", "exports", "functions", "raw_sha256", "raw_len", "stored_len", "form"]
STEM, TAG = 200, 10


def distinct_definitions(definitions: DataFrame) -> DataFrame:
    """One row for each (name, text hash): the occurrence of the smallest chunk, then position."""
    place = F.struct("chunk", "pos")
    row = F.struct("chunk", *FACTS)
    return definitions.groupBy("name", "raw_sha256").agg(F.min_by(row, place).alias("r"), F.count("*").alias("copies")).select("name", "r.*", "copies")


def _order(prefix: str = "") -> Column:
    return F.struct((-F.col(prefix + "raw_len")).alias("l"), F.col(prefix + "raw_sha256").alias("s"))


def primaries(distinct: DataFrame) -> DataFrame:
    """The longest definition of each name, of equal ones that of the smallest hash, and how many there are."""
    cols = [c for c in distinct.columns if c != "name"]
    return distinct.groupBy("name").agg(F.min_by(F.struct(*cols), _order()).alias("r"), F.count("*").alias("definitions")).select("name", "r.*", "definitions")


def variants(distinct: DataFrame, primary: DataFrame) -> DataFrame:
    """The other definitions with what they depend on more and less than the primary."""
    p = primary.select("name", F.col("raw_sha256").alias("p_sha"), F.col("deps").alias("p_deps"))
    return distinct.join(p, "name").where(F.col("raw_sha256") != F.col("p_sha")).select(
        "name", F.col("raw_sha256").alias("sha256"), "raw_len", "deps",
        set_difference(F.col("deps"), F.col("p_deps")).alias("deps_added"), set_difference(F.col("p_deps"), F.col("deps")).alias("deps_removed"),
    )


def edges(primary: DataFrame) -> DataFrame:
    """src, pos, dst: one row for each dependency in source order, repeats kept."""
    return primary.select(F.col("name").alias("src"), F.posexplode("deps").alias("pos", "dst"))


def dependents(primary: DataFrame) -> DataFrame:
    """name and the sorted, distinct names of the records that depend on it."""
    e = edges(primary).select("src", "dst").distinct()
    return e.join(primary.select(F.col("name").alias("dst")), "dst").groupBy(F.col("dst").alias("name")).agg(F.array_sort(F.collect_set("src")).alias("dependents"))


def dependent_edges(primary: DataFrame, reverse: DataFrame | None = None) -> DataFrame:
    """dst and src, each pair once, of dependencies that are defined: dependents() without gathering those of one
    name in a row, for names that a large part of all records depend on."""
    e = (edges(primary) if reverse is None else reverse).select("src", "dst").distinct()
    return e.join(primary.select(F.col("name").alias("dst")), "dst", "left_semi").select("dst", "src")


def dependent_counts(primary: DataFrame, reverse: DataFrame | None = None) -> DataFrame:
    """name, n, first and last of the dependents of each name, counted where they lie."""
    e = (edges(primary) if reverse is None else reverse).select("src", "dst").distinct()
    own = e.join(primary.select(F.col("name").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("name")).agg(F.count("*").alias("n"), F.min("src").alias("first"), F.max("src").alias("last"))
    return own.join(primary.select("name"), "name", "left_semi")


def unresolved(primary: DataFrame) -> DataFrame:
    """Distinct dependencies that no record defines."""
    return edges(primary).select(F.col("dst").alias("name")).distinct().join(primary.select("name"), "name", "left_anti")


def fingerprint(sha: Column, others: Column) -> Column:
    """The hash of the text, or all hashes of the name's texts sorted and joined by +."""
    return F.array_join(F.array_sort(F.concat(F.array(sha), others)), "+")


def _safe(name: Column) -> Column:
    return (F.octet_length(name) <= STEM) & name.rlike(r"^[A-Za-z0-9_\-@+$][A-Za-z0-9_\-.@+$]*\z")


def _tagged(name: Column) -> Column:
    clean = F.regexp_replace(name, r"[^A-Za-z0-9_\-.@+$]", "_")
    clean = F.when(clean == "", "_").when(F.startswith(clean, F.lit(".")), F.concat(F.lit("_"), clean)).otherwise(clean)
    return F.concat(F.substring(clean, 1, STEM), F.lit("~"), F.substring(F.sha2(name, 256), 1, TAG))


def file_names(names: DataFrame) -> DataFrame:
    """name, file and renamed: names that are safe file names keep theirs, unless an earlier name differs in case only."""
    from pyspark.sql import Window

    name = F.col("name")
    first = F.when(_safe(name), name).otherwise(_tagged(name))
    rank = F.row_number().over(Window.partitionBy("_low").orderBy("name"))
    out = names.select("name").distinct().withColumn("_stem", first).withColumn("_low", F.lower("_stem")).withColumn("_rank", rank)
    taken = F.col("_rank") > 1
    return out.select("name", F.concat(F.when(taken, _tagged(name)).otherwise(F.col("_stem")), F.lit(".js")).alias("file"), (taken | ~_safe(name)).alias("renamed"))


def variant_file(file: Column, sha: Column) -> Column:
    return F.concat(F.regexp_replace(file, r"\.js\z", ""), F.lit("~alt-"), F.substring(sha, 1, 16), F.lit(".js"))


def build(definitions: DataFrame) -> DataFrame:
    """The records: facts of the primary, dependents, file and variants, one row for each name."""
    distinct = distinct_definitions(definitions)
    primary = primaries(distinct)
    files = file_names(primary)
    other = variants(distinct, primary).join(files.select("name", "file"), "name").groupBy("name").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("raw_len")).alias("o"), F.col("sha256"), variant_file(F.col("file"), F.col("sha256")).alias("file"), "raw_len", "deps_added", "deps_removed"))).alias("v")
    )
    none = F.expr("cast(array() as array<string>)")
    flat = F.transform("v", lambda x: F.struct(x.sha256.alias("sha256"), x.file.alias("file"), x.raw_len.alias("raw_len"), x.deps_added.alias("deps_added"), x.deps_removed.alias("deps_removed")))
    empty = F.expr("cast(array() as array<struct<sha256:string,file:string,raw_len:bigint,deps_added:array<string>,deps_removed:array<string>>>)")
    return (
        primary.drop("copies").join(files.select("name", "file"), "name").join(dependents(primary), "name", "left").join(other, "name", "left")
        .withColumn("dependents", F.coalesce("dependents", none)).withColumn("variants", F.coalesce(flat, empty)).drop("v", "definitions")
    )


def fingerprints(definitions: DataFrame) -> DataFrame:
    """name and fingerprint straight from the definitions: nothing but names and hashes moves."""
    return definitions.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("raw_sha256")), "+").alias("fingerprint"))


def variant_counts(distinct: DataFrame) -> DataFrame:
    """name and how many definitions it has, of names with more than one."""
    return distinct.groupBy("name").agg(F.count("*").alias("definitions")).where("definitions > 1")


def has_variants(records: DataFrame):
    """The records of build() with a second definition."""
    return records.where(F.size("variants") > 0)


def with_fingerprint(records: DataFrame) -> DataFrame:
    return records.withColumn("fingerprint", fingerprint(F.col("raw_sha256"), F.transform("variants", lambda v: v.sha256)))


def diagnostics(definitions: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """One row of counters.  chunks, if given, has path and the columns skipped and failed."""
    distinct = distinct_definitions(definitions)
    primary = primaries(distinct)
    counts = primary.agg(
        F.count("*").alias("modules"), F.sum("stored_len").alias("modules_bytes"), F.count_if(F.col("definitions") > 1).alias("modules_with_variants"),
        F.sum(F.col("definitions") - 1).alias("variants"), F.count_if(F.col("form") == "raw").alias("codegen_failures"),
    )
    out = counts.crossJoin(unresolved(primary).agg(F.count("*").alias("unresolved_total"))).crossJoin(file_names(primary).agg(F.count_if("renamed").alias("renamed_files")))  # one row each
    if chunks is not None:
        told = [F.count_if(~F.col("skipped")).alias("chunks_read"), F.count_if("skipped").alias("chunks_skipped"), F.count_if("failed").alias("chunk_parse_failures")]
        told += [F.coalesce(F.sum("nameless"), F.lit(0)).alias("nameless_calls")] * ("nameless" in chunks.columns)
        out = out.crossJoin(chunks.agg(*told))
    return out
