"""Sinks: JSON, newline-delimited JSON, Markdown and plain text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F


def rows_json(df: DataFrame) -> str:
    """A small result as a JSON array."""
    return json.dumps([json.loads(x) for x in df.toJSON().toLocalIterator()], ensure_ascii=False, indent=2)


def ndjson(changes: DataFrame, head: dict) -> DataFrame:
    """One column `value`: a head line with empty changes, then a line for each change by name."""
    spark = changes.sparkSession
    first = spark.createDataFrame([("", 0, json.dumps(head | {"changes": []}, sort_keys=True))], "name string, n int, value string")
    rows = changes.select("name", F.lit(1).alias("n"), F.to_json(F.struct(*changes.columns)).alias("value"))
    return first.unionByName(rows).orderBy("n", "name").select("value")


def _some(df: DataFrame, limit: int | None):
    """Rows as they stream to the driver, and how many a limit leaves out."""
    return (df if limit is None else df.limit(limit)).toLocalIterator(), 0 if limit is None else max(df.count() - limit, 0)


def markdown(old: str, new: str, summary: dict, changes: DataFrame, limit: int | None = None, filter_name: str | None = None) -> str:
    """A report of all changes by kind, then name; with a limit of the first ones, and it says how many are left out."""
    out = [f"# {old} → {new}", ""] + [f"Filter: `{filter_name}`", ""] * (filter_name is not None) + ["| metric | count |", "| --- | --- |"]
    told = (("Added", "added"), ("Removed", "removed"), ("Modified", "modified"), ("Unchanged", "unchanged"), ("Noise only (left out)", "noise_only"), ("Too large to compare", "diffs_skipped"))
    out += [f"| {label} | {summary[key]} |" for label, key in told if key in summary]
    sizes = {r["kind"]: r["count"] for r in changes.groupBy("kind").count().collect()}
    order = F.array_position(F.array(F.lit("added"), F.lit("removed"), F.lit("modified")), F.col("kind"))
    rows, left = _some(changes.orderBy(order, "name"), limit)
    kind = None
    for r in rows:
        if r["kind"] != kind:
            kind = r["kind"]
            out += ["", f"## {kind} ({sizes[kind]})"]
        out += ["", f"### `{r['name']}`", ""]
        for label, col in (("deps added", "deps_added"), ("deps removed", "deps_removed"), ("exports added", "exports_added"), ("exports removed", "exports_removed")):
            if r[col]:
                out.append(f"- {label}: {', '.join(f'`{x}`' for x in r[col])}")
        if r["hunks"]:
            fence = "```"
            while fence in r["hunks"]:
                fence += "`"
            out += [f"{fence}diff", r["hunks"].rstrip("\n"), fence]
    return "\n".join(out + ["", f"{left} more changes are left out"] * (left > 0)) + "\n"


def size(n: int) -> str:
    """Bytes in binary units."""
    value, unit = float(n), "B"
    for unit in ("B", "KiB", "MiB", "GiB", "TiB"):
        if value < 1024 or unit == "TiB":
            break
        value /= 1024
    return f"{n} B" if unit == "B" else f"{value:.1f} {unit}"


def text(df: DataFrame, limit: int | None = None) -> str:
    """Columns under each other, for people; with a limit it says how many rows are left out."""
    some, left = _some(df, limit)
    rows = [df.columns, *[["" if v is None else ", ".join(map(str, v)) if isinstance(v, list) else str(v) for v in r] for r in some]]
    wide = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
    lines = ["  ".join(x.ljust(w) for x, w in zip(r, wide, strict=True)).rstrip() for r in rows]
    return "\n".join(lines + [f"{left} more rows"] * (left > 0)) + "\n"


def decisions(df: DataFrame, limit: int | None = None) -> str:
    """Filter decisions with their reasons in words."""
    why = F.when(F.col("module").isNotNull(), F.concat(F.lit("depends on "), "module")).when(F.col("pattern").isNotNull(), F.concat("reason", F.lit(" "), "pattern")).otherwise(F.col("reason"))
    return text(df.orderBy("name").select("name", "verdict", why.alias("why")), limit)


def counters(row: dict) -> str:
    """One row of counters, a line each."""
    wide = max(map(len, row), default=0)
    return "".join(f"{k.ljust(wide)}  {v}\n" for k, v in row.items())


def bundles(df: DataFrame) -> str:
    return text(df.select("bundle", "platform", "revision"))


def filters(specs: list[dict]) -> str:
    """One line for each filter document."""
    return "".join(f"{s['name']}{' (built in)' if s.get('builtin') else ''}  {s.get('description') or ''}".rstrip() + "\n" for s in specs)


def module(row: dict) -> str:
    """One record with the lines asked for."""
    lines = row.get("lines") or []
    head = {k: ", ".join(map(str, v)) if isinstance(v, list) else v for k, v in row.items() if k not in ("lines", "variants") and v is not None}
    return counters(head) + "".join(f"{x}\n" for x in lines)


def matches(hits: DataFrame) -> str:
    """Search hits with their lines."""
    out = []
    for r in hits.orderBy("name").toLocalIterator():
        out.append(f"{r['name']}" + (f"  ({r['match_count']} lines)" if r["match_count"] else ""))
        out += [f"  {m['line']}: {m['text']}" for m in r["matches"] or []]
    return "\n".join(out) + "\n"


def changes_text(summary: dict, changes: DataFrame, limit: int | None = None) -> str:
    """Counters, then a line for each change."""
    return counters(summary) + text(changes.orderBy("name").select("kind", "name", "lines_added", "lines_removed"), limit)


def graph_text(graph) -> str:
    """Sizes, then nodes by depth and name, then edges."""
    nodes, edges = graph.nodes.orderBy("depth", "name").collect(), graph.edges.orderBy("src", "dst").collect()
    out = [f"{len(nodes)} nodes, {len(edges)} edges"] + ["cut at max_nodes"] * graph.truncated
    out += [f"  {r['depth']}  {r['name']}{'' if r['present'] else '  (not in the bundle)'}" for r in nodes]
    out += [f"  {r['src']} -> {r['dst']}" for r in edges]
    out += [f"  cycle: {' -> '.join(c)}" for c in graph.cycles or []]
    return "\n".join(out) + "\n"
