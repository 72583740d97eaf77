"""Bounded neighbourhoods in the dependency graph, and cycles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.scratch import cut
from . import filters as _filters


SEPARATE = 8  # so many tables of visited nodes are joined one by one, then they are written as one


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    missing: DataFrame
    truncated: bool
    cycles: list[list[str]] | None = None


def roots_of(records: DataFrame, names: list[str] = (), pattern: str | None = None) -> DataFrame:
    """Named roots and those whose name a pattern matches."""
    from ..functions.regexes import compiled

    out = None
    if names:
        out = records.sparkSession.createDataFrame([(n,) for n in sorted(set(names))], "name string")
    if pattern is not None:
        found = records.where(F.col("name").rlike(compiled(pattern, "roots"))).select("name")
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("roots are needed")
    out = out.distinct()
    if not names and out.isEmpty():
        raise ValueError(f"no record's name matches {pattern!r}")
    return out


def steps(edges: DataFrame, direction: str) -> DataFrame:
    """at, other, pos, src, dst: what each node leads to, dependencies in their order, then dependents by name."""
    deps = edges.select(F.col("src").alias("at"), F.col("dst").alias("other"), F.struct(F.lit(0).alias("side"), F.col("pos").alias("n"), F.col("dst").alias("s")).alias("pos"), "src", "dst")
    back = edges.select("src", "dst").distinct().select(F.col("dst").alias("at"), F.col("src").alias("other"), F.struct(F.lit(1).alias("side"), F.lit(0).alias("n"), F.col("src").alias("s")).alias("pos"), "src", "dst")
    if direction not in ("deps", "dependents", "both"):
        raise ValueError(f"direction: {direction!r}")
    return deps if direction == "deps" else back if direction == "dependents" else deps.unionByName(back)


def neighbourhood(records: DataFrame, edges: DataFrame, roots: DataFrame, direction: str = "deps", depth: int = 1, max_nodes: int | None = 2000,
                  external: bool = True, spec: dict | None = None) -> Graph:
    """Breadth-first from the roots, depth 0 without bound.

    A node at the last depth is not expanded, so edges between two such nodes are not there.  max_nodes
    admits new nodes in breadth-first order, roots always; edges to others go.  A node's place in that order
    is its path of positions, compared level by level, so levels need no global numbering.
    """
    defined = records.select("name")
    missing = roots.join(defined, "name", "left_anti")
    lead = steps(edges, direction)
    if not external:
        lead = lead.join(defined.select(F.col("name").alias("other")), "other", "left_semi")
    lead = cut(lead)  # what the tables behind the edges cost is paid once, not for each level
    capped = max_nodes is not None
    path = [F.array(F.struct(F.lit(0).alias("side"), F.lit(0).alias("n"), F.col("name").alias("s"))).alias("path")] * capped
    longer = [F.concat("path", F.array("pos")).alias("path")] * capped  # the order matters under a cap only
    frontier = cut(roots.select("name", *path))
    levels, passed = [frontier.select("name", F.lit(0).alias("depth"))], []
    truncated, level = False, 0
    n = frontier.count() if capped else 0
    while depth == 0 or level < depth:
        level += 1
        out = cut(frontier.withColumnRenamed("name", "at").join(lead, "at").select("other", "src", "dst", *longer))
        passed.append(out.select("src", "dst"))
        new = out.select(F.col("other").alias("name"), *["path"] * capped)
        new = new.groupBy("name").agg(F.min("path").alias("path")) if capped else new.distinct()
        for seen in levels:  # tables of their own: nothing that was visited is written again
            new = new.join(seen.select("name"), "name", "left_anti")
        if capped:
            room = max(max_nodes - n, 0)
            some = cut(new.orderBy("path").limit(room + 1))  # one more tells that some are left out
            m = some.count()
            truncated |= m > room
            new = some.orderBy("path").limit(room) if m > room else some
            n += min(m, room)
            if m == 0 or room == 0:
                break
        new = cut(new)
        if not capped and new.isEmpty():
            break
        levels.append(new.select("name", F.lit(level).alias("depth")))
        if len(levels) > SEPARATE:
            levels = [cut(_union(levels))]
        frontier = new
    visited = _union(levels)
    kept = visited.select("name")
    found_edges = _union(passed).distinct() if passed else edges.select("src", "dst").limit(0)
    edge = found_edges
    if truncated:  # only then there are edges to nodes that were not admitted
        edge = edge.join(kept.withColumnRenamed("name", "src"), "src", "left_semi").join(kept.withColumnRenamed("name", "dst"), "dst", "left_semi").select("src", "dst")
    into = edges.select("src", "dst").join(kept.withColumnRenamed("name", "dst"), "dst", "left_semi").distinct()  # only those of the nodes found
    count = into.groupBy(F.col("dst").alias("name")).agg(F.count("*").alias("dependent_count"))
    file = [F.col("file") if "file" in records.columns else F.lit(None).cast("string").alias("file")]
    facts = records.select("name", F.lit(True).alias("present"), F.size("deps").alias("dep_count"), *file).join(kept, "name", "left_semi").join(count, "name", "left")
    nodes = visited.join(facts, "name", "left").select(
        "name", "depth", F.coalesce("present", F.lit(False)).alias("present"), F.coalesce("dep_count", F.lit(0)).alias("dep_count"),
        F.when(F.col("present"), F.coalesce("dependent_count", F.lit(0))).otherwise(F.lit(0)).alias("dependent_count"),
        (_filters.verdict(F.col("name"), spec) if spec else F.lit(True)).alias("in_filter"), "file",
    )
    return Graph(nodes, edge, missing, truncated)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def graph(records: DataFrame, edges: DataFrame | None = None, names: list[str] = (), pattern: str | None = None, detect_cycles: bool = False, **options) -> Graph:
    """Roots, neighbourhood and, where asked for, the cycles within it; cycles need a bound on its nodes."""
    if edges is None:
        edges = records.select(F.col("name").alias("src"), F.posexplode("deps").alias("pos", "dst"))
    if detect_cycles and options.get("max_nodes", 2000) is None:
        raise ValueError("cycles are looked for on the driver: max_nodes has to bound the graph (on_cycles() has no bound)")
    out = neighbourhood(records, edges, roots_of(records, names, pattern), **options)
    if detect_cycles:
        out.cycles = cycles([(r["src"], r["dst"]) for r in out.edges.collect()])
    return out


def cycles(edges: list[tuple[str, str]]) -> list[list[str]]:
    """One cycle for each back edge of a depth-first search in name order, turned so that the smallest name is
    first, which also ends it.  For neighbourhoods, whose size max_nodes bounds."""
    lead: dict[str, list[str]] = {}
    for a, b in sorted(set(edges)):
        lead.setdefault(a, []).append(b)
    state: dict[str, int] = {}
    found = set()
    for start in sorted(lead):
        if state.get(start):
            continue
        path, stack = [start], [iter(lead[start])]
        state[start] = 1
        while stack:
            other = next(stack[-1], None)
            if other is None:
                state[path.pop()] = 2
                stack.pop()
            elif state.get(other, 0) == 0:
                state[other] = 1
                path.append(other)
                stack.append(iter(lead.get(other, ())))
            elif state[other] == 1:
                ring = path[path.index(other) :]
                k = ring.index(min(ring))
                found.add((*ring[k:], *ring[:k], ring[k]))
    return [list(c) for c in sorted(found)]


def on_cycles(edges: DataFrame) -> DataFrame:
    """Names on a cycle of a graph in which each node leads to one other at most, of any size.

    Each round drops the sources without a way in, then doubles the length of the steps, so that a tail of
    any length is gone after as many rounds as its length has binary digits.  When every source has a way
    in, the steps are one to one, and all that is left lies on cycles.
    """
    step = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    n = step.count()
    if step.select("src").distinct().count() != n:
        raise ValueError("a node leads to more than one other")
    while True:
        kept = cut(step.join(step.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"))
        if kept.count() == n:
            return kept.select(F.col("src").alias("name"))
        step = cut(kept.withColumnRenamed("dst", "via").join(kept.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst"))
        n = step.count()


def dot(graph: Graph) -> str:
    """Graphviz."""
    quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    rows = [f"  {quote(r['name'])}{'' if r['present'] else ' [style=dashed]'};" for r in graph.nodes.orderBy("name").collect()]
    rows += [f"  {quote(r['src'])} -> {quote(r['dst'])};" for r in graph.edges.orderBy("src", "dst").collect()]
    return "\n".join(["digraph modules {", "  rankdir=LR;", *rows, "}"]) + "\n"


def mermaid(graph: Graph) -> str:
    """Mermaid, with ids by place in name order."""
    names = [r["name"] for r in graph.nodes.orderBy("name").collect()]
    at = {n: f"n{i}" for i, n in enumerate(names)}
    rows = [f'  {at[n]}["{n.replace(chr(34), "#quot;")}"]' for n in names]
    rows += [f"  {at[r['src']]} --> {at[r['dst']]}" for r in graph.edges.orderBy("src", "dst").collect()]
    return "\n".join(["graph LR", *rows]) + "\n"
