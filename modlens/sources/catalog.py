"""Stored revisions (bundles) and filter documents.

A bundle is a partition of the tables in a store folder; it exists once its manifest row is
written, which is the last thing ingestion does.
"""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import filters as _filters

# The platforms in their order, which is the order of bundles, and their short names.
PLATFORMS = ("whatsapp", "messenger", "facebook", "instagram")
ALIASES = {"wa": "whatsapp", "msgr": "messenger", "fb": "facebook", "ig": "instagram"}
MOST = (1 << 63) - 1


def platform(name: str) -> str:
    low = name.lower()
    low = ALIASES.get(low, low)
    if low not in PLATFORMS:
        raise ValueError(f"unknown platform: {name!r}")
    return low


def parse_id(spec: str) -> tuple[str, int]:
    """`platform-revision`, parted at the last -; a bare number is one of the first platform."""
    head, dash, tail = spec.rpartition("-")
    if not re.fullmatch(r"\d+", tail) or int(tail) > MOST:
        raise ValueError(f"not a bundle: {spec!r}")
    return (platform(head) if dash else PLATFORMS[0]), int(tail)


def _ord():
    return F.array_position(F.array(*[F.lit(p) for p in PLATFORMS]), F.col("platform")).cast("int") - 1


def listed(bundles: DataFrame) -> DataFrame:
    """bundle and platform_ord added, in order."""
    out = bundles.withColumn("bundle", F.concat("platform", F.lit("-"), F.col("revision").cast("string"))).withColumn("platform_ord", _ord())
    return out.orderBy("platform_ord", "revision")


def latest(bundles: DataFrame) -> DataFrame:
    """The newest revision of each platform."""
    top = bundles.groupBy("platform").agg(F.max("revision").alias("revision"))
    return top.select("platform", F.concat("platform", F.lit("-"), F.col("revision").cast("string")).alias("bundle"), "revision")


def latest_pairs(bundles: DataFrame) -> DataFrame:
    """platform, older, newer of the platforms with two revisions at least."""
    rank = F.row_number().over(Window.partitionBy("platform").orderBy(F.desc("revision")))
    two = bundles.select("platform", "revision").distinct().withColumn("k", rank).where("k <= 2")
    return two.groupBy("platform").agg(F.min("revision").alias("older"), F.max("revision").alias("newer"), F.count("*").alias("n")).where("n = 2").drop("n")


def archive_urls(bundles: DataFrame, base: str) -> DataFrame:
    """bundle and the address of its archive below `base`, by revision, then platform: where a record came from."""
    return listed(bundles).select("bundle", F.format_string("%s/%d/%s", F.lit(base.rstrip("/")), "revision", "platform").alias("url"))


class Store:
    """Tables in a folder: modules, sources, bundles and where asked for chunks, each partitioned by bundle."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def bundles(self) -> DataFrame | None:
        try:
            return self._table("bundles")
        except Exception as e:  # Spark's own class for this differs between its front ends
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def has(self, bundle: str) -> bool:
        b = self.bundles()
        return b is not None and not b.where(F.col("bundle") == bundle).isEmpty()

    def resolve(self, spec: str) -> str:
        """`latest`, `<platform>-latest`, an id or a bare revision; it must be stored."""
        b = self.bundles()
        if b is None:
            raise LookupError("nothing is stored")
        m = re.fullmatch(r"(?:(.+)-)?latest", spec)
        if m:
            row = latest(b.where(F.col("platform") == platform(m[1] or PLATFORMS[0]))).first()
            if row is None:
                raise LookupError(f"nothing is stored for {spec!r}")
            return row["bundle"]
        name = "{}-{}".format(*parse_id(spec))
        if not self.has(name):
            raise LookupError(f"{name} is not stored")
        return name

    def latest_pair(self, platform_: str) -> tuple[str, str]:
        b = self.bundles()
        row = None if b is None else latest_pairs(b.where(F.col("platform") == platform(platform_))).first()
        if row is None:
            raise LookupError(f"two revisions of {platform_} are needed")
        return f"{platform_}-{row['older']}", f"{platform_}-{row['newer']}"

    def operands(self, old: str | None = None, new: str | None = None) -> tuple[str, str]:
        """None: the latest pair; one: that against the latest of its platform; the same twice is refused."""
        if old is None and new is None:
            return self.latest_pair(PLATFORMS[0])
        a = self.resolve(old or new)
        b = self.resolve(new) if old and new else self.resolve(f"{a.rpartition('-')[0]}-latest")
        if a == b:
            raise ValueError(f"{a} against itself")
        return a, b

    def add(self, bundle: str, modules: DataFrame, sources: DataFrame, manifest: dict, force: bool = False) -> None:
        """Writes the tables, then the manifest row."""
        name, revision = parse_id(bundle)
        if self.has(bundle):
            if not force:
                raise FileExistsError(f"{bundle} is stored")
            self._delete(bundle, "bundles")  # not seen while its tables change
        mode = "overwrite"
        sources.write.mode(mode).option("compression", "zstd").parquet(f"{self.path}/sources/bundle={bundle}")
        modules.sortWithinPartitions("name").write.mode(mode).parquet(f"{self.path}/modules/bundle={bundle}")
        row = self.spark.createDataFrame([(name, revision, json.dumps(manifest, sort_keys=True))], "platform string, revision long, manifest string")
        row.coalesce(1).write.mode(mode).parquet(f"{self.path}/bundles/bundle={bundle}")

    def modules(self, bundle: str) -> DataFrame:
        return self._table("modules").where(F.col("bundle") == bundle).drop("bundle")

    def sources(self, bundle: str) -> DataFrame:
        return self._table("sources").where(F.col("bundle") == bundle).drop("bundle")

    def manifest(self, bundle: str) -> dict:
        row = self.bundles().where(F.col("bundle") == bundle).first()
        if row is None:
            raise LookupError(f"{bundle} is not stored")
        return json.loads(row["manifest"])

    def remove(self, bundle: str) -> None:
        """The manifest goes first, so a bundle half removed is not seen."""
        if not self.has(bundle):
            raise LookupError(f"{bundle} is not stored")
        self._delete(bundle, "bundles", "modules", "sources", "chunks")

    def _delete(self, bundle: str, *tables: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{t}/bundle={bundle}")
            p.getFileSystem(conf).delete(p, True)

    def chunks(self, bundle: str) -> DataFrame:
        """The raw chunks, where they were kept."""
        if not self.manifest(bundle).get("chunks_kept"):
            raise LookupError(f"the chunks of {bundle} were not kept")
        return self._table("chunks").where(F.col("bundle") == bundle).drop("bundle")

    def keep_chunks(self, bundle: str, chunks: DataFrame) -> None:
        chunks.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/chunks/bundle={bundle}")

    def info(self, bundle: str) -> dict:
        """The manifest of a bundle, with its name, platform and revision."""
        name = self.resolve(bundle)
        platform_, revision = parse_id(name)
        return {"bundle": name, "platform": platform_, "revision": revision} | self.manifest(name)


class Filters:
    """Filter documents in a folder of the driver; one of a built-in's name stands in for it."""

    def __init__(self, path: str):
        self.path = path

    def _file(self, name: str) -> str:
        return os.path.join(self.path, f"{_filters.valid_name(name)}.json")

    def get(self, name: str) -> dict:
        file = self._file(name)
        if os.path.exists(file):
            with open(file, encoding="utf-8") as f:
                return json.load(f)
        if name in _filters.BUILTIN:
            return dict(_filters.BUILTIN[name])
        raise LookupError(f"no filter {name!r}")

    def list(self) -> list[dict]:
        own = [f[:-5] for f in os.listdir(self.path) if f.endswith(".json")] if os.path.isdir(self.path) else []
        return [self.get(n) for n in sorted({*own, *_filters.BUILTIN})]

    def put(self, spec: dict) -> dict:
        _filters.check(spec)
        file = self._file(spec["name"])
        os.makedirs(self.path, exist_ok=True)
        with open(f"{file}.tmp", "w", encoding="utf-8") as f:
            json.dump(spec | {"builtin": False}, f, indent=2)
            f.flush()
            os.fsync(f.fileno())
        os.replace(f"{file}.tmp", file)
        return self.get(spec["name"])

    def patch(self, name: str, change: dict) -> dict:
        return self.put(_filters.patched(self.get(name), change))

    def fork(self, name: str, new: str) -> dict:
        return self.put(self.get(name) | {"name": new})

    def delete(self, name: str) -> None:
        file = self._file(name)
        if not os.path.exists(file):
            raise LookupError(f"no filter of that name to delete: {name!r}")
        os.remove(file)
