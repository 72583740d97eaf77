"""The whole engine behind one object: bundles, filters, search, diff and graph of one store."""

from __future__ import annotations

import datetime
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import diff, filters, graph, search
from .sources import archive, catalog


def expand_home(path: str) -> str:
    """`~` and `~/...` with the home folder, which shells leave alone inside quotes; all else as it is."""
    home = os.environ.get("HOME")
    return home + path[1:] if home and (path == "~" or path.startswith("~/")) else path


def read_json_arg(path: str, stdin=None) -> dict:
    """A JSON document from a file, or from standard input for `-`."""
    if path == "-":
        return json.loads((stdin or sys.stdin).read())
    with open(expand_home(path), encoding="utf-8") as f:
        return json.load(f)


class Session:
    def __init__(self, spark: SparkSession, store: str, filter_folder: str, cached: int = 2):
        self.spark, self.store, self.filters = spark, catalog.Store(spark, expand_home(store)), catalog.Filters(expand_home(filter_folder))
        self._cached, self._most = {}, cached

    def _drop(self, bundle: str) -> None:
        if bundle in self._cached:
            self._cached.pop(bundle).unpersist()

    def records(self, bundle: str) -> DataFrame:
        """The records of a bundle; those of the last few bundles stay cached by Spark."""
        name = self.store.resolve(bundle)
        if name in self._cached:
            self._cached[name] = self._cached.pop(name)  # the latest is last
        else:
            self._cached[name] = self.store.modules(name).persist()
            while len(self._cached) > self._most:
                self._drop(next(iter(self._cached)))
        return self._cached[name]

    # --- bundles

    def bundle_list(self) -> DataFrame:
        found = self.store.bundles()
        if found is None:
            found = self.spark.createDataFrame([], "platform string, revision long, manifest string")
        return catalog.listed(found.drop("bundle")).select("bundle", "platform", "revision")

    def bundle_info(self, bundle: str) -> dict:
        return self.store.info(bundle)

    def bundle_add(self, bundle: str, source: str, pretty: bool = True, force: bool = False, keep_chunks: bool = False) -> dict:
        """Reads a folder or a zip file of chunks and stores its records."""
        name = "{}-{}".format(*catalog.parse_id(bundle))
        source = expand_home(source)
        if f"{source.rstrip('/')}/".startswith(f"{self.store.path}/"):
            raise ValueError(f"{source} lies in the store: use reindex")
        if self.store.has(name) and not force:
            raise FileExistsError(f"{name} is stored")
        found = archive.unzipped(self.spark, source) if source.endswith(".zip") else archive.chunks(self.spark, source)
        return self._index(name, found, {"source": source, "pretty": pretty, "chunks_kept": keep_chunks}, pretty)

    def bundle_reindex(self, bundle: str, pretty: bool | None = None) -> dict:
        """Records made again from the chunks that were kept; where they came from stays as it was."""
        name = self.store.resolve(bundle)
        before = self.store.manifest(name)
        chunks = self.store.chunks(name)
        pretty = before.get("pretty", True) if pretty is None else pretty
        return self._index(name, chunks, {"source": before.get("source"), "added_at": before.get("added_at"), "pretty": pretty, "chunks_kept": True}, pretty, kept=True)

    def _index(self, name: str, chunks: DataFrame, head: dict, pretty: bool, kept: bool = False) -> dict:
        records, sources, told = archive.ingest(archive.definitions(chunks, pretty))
        if head["chunks_kept"] and not kept:
            self.store.keep_chunks(name, chunks)
        now = datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")
        manifest = head | {"added_at": head.get("added_at") or now, "indexed_at": now} | told.first().asDict()
        self.store.add(name, records, sources, manifest, force=True)
        self._drop(name)
        return {"bundle": name} | manifest

    def bundle_remove(self, bundle: str) -> dict:
        name = self.store.resolve(bundle)
        self._drop(name)
        self.store.remove(name)
        return {"removed": name}

    # --- filters

    def filter_test(self, bundle: str, name: str, n: int = 20) -> dict:
        """Counts by reason, and the first kept and dropped names."""
        told = filters.apply(self.records(bundle), self.filters.get(name)).cache()
        try:
            reasons = {r["reason"]: r["n"] for r in filters.breakdown(told).collect()}
            counts = {r["verdict"]: r["count"] for r in told.groupBy("verdict").count().collect()}
            first = [r.asDict() for r in filters.samples(told, n).collect()]
        finally:
            told.unpersist()
        return {"filter": name, "kept": counts.get("keep", 0), "dropped": counts.get("drop", 0), "reasons": reasons, "samples": first}

    def _kept(self, records: DataFrame, name: str | None) -> DataFrame | None:
        return None if name is None else filters.kept(records, self.filters.get(name))

    # --- modules

    def module_search(self, bundle: str, name: str | None = None, exports: str | None = None, source: str | None = None, filter: str | None = None, **options) -> search.Result:
        """Search by at least one pattern."""
        if name is None and exports is None and source is None:
            raise ValueError("a pattern is needed: name, exports or source")
        records = self.records(bundle)
        return search.search(records, self.store.sources(self.store.resolve(bundle)), name, exports, source, self._kept(records, filter), **options)

    def grep(self, bundle: str, pattern: str, **options) -> search.Result:
        return self.module_search(bundle, source=pattern, **options)

    def module_get(self, bundle: str, name: str, start: int = 1, count: int = 1 << 30) -> dict:
        """A record with lines of its text; an unknown name is an error that suggests others."""
        records = self.records(bundle)
        row = search.get(records, self.store.sources(self.store.resolve(bundle)), name, start, count).first()
        if row is None:
            near = [r["name"] for r in search.suggest(records, name).collect()]
            raise LookupError(f"no module {name!r}" + (f"; near it: {', '.join(near)}" if near else ""))
        return row.asDict(recursive=True)

    # --- diff and graph

    def diff(self, old: str | None = None, new: str | None = None, filter: str = "default", include_noise: bool = False, limit: int | None = None, **options) -> dict:
        """Counters and the changes, which may be cut by a limit: truncated and total then say so."""
        a, b = self.store.operands(old, new)
        spec, left, right = self.filters.get(filter), self.records(a), self.records(b)
        kinds = diff.kinds(left, right, spec).cache()
        changes = diff.compared(kinds, self.store.sources(a), self.store.sources(b), spec, **options).cache()
        try:
            told = diff.summary(kinds, changes, left, right).first().asDict()
            page = diff.page(changes, include_noise, limit)
            rows = [r.asDict() for r in page.changes.collect()]
        finally:
            changes.unpersist()
            kinds.unpersist()
        return {"old": a, "new": b, "filter": filter, "summary": told, "changes": rows, "changes_total": page.total, "changes_truncated": page.truncated}

    def graph(self, bundle: str, roots: list[str] = (), match: str | None = None, filter: str | None = None, **options) -> graph.Graph:
        return graph.graph(self.records(bundle), names=list(roots), pattern=match, spec=None if filter is None else self.filters.get(filter), **options)


def plain(value) -> object:
    """What a tool returns, as JSON has it."""
    if isinstance(value, DataFrame):
        return [json.loads(x) for x in value.toJSON().toLocalIterator()]
    if isinstance(value, search.Result):
        return value.stats() | {"hits": plain(value.hits), "unreadable": plain(value.unreadable) if value.unreadable is not None else []}
    if isinstance(value, graph.Graph):
        return {"nodes": plain(value.nodes.orderBy("depth", "name")), "edges": plain(value.edges.orderBy("src", "dst")), "missing": plain(value.missing), "truncated": value.truncated, "cycles": value.cycles}
    return value


def counter_map(row: DataFrame) -> DataFrame:
    """One row of counters as a map from name to number."""
    return row.select(F.map_from_arrays(F.array(*[F.lit(c) for c in row.columns]), F.array(*[F.col(c).cast("long") for c in row.columns])).alias("counters"))
