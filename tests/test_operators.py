from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from modlens.operators import diff, filters, graph, index, render, search

DEF = "name string, chunk string, pos int, deps array<string>, exports array<string>, functions array<string>, raw_sha256 string, raw_len long, stored_len long, form string"


def definitions(spark, rows):
    return spark.createDataFrame([(n, c, 0, d, [], [], s, size, size, "raw") for n, c, d, s, size in rows], DEF)


def records(spark, deps: dict):
    return spark.createDataFrame([(n, d) for n, d in deps.items()], "name string, deps array<string>")


def edges(df):
    return df.select(F.col("name").alias("src"), F.posexplode("deps").alias("pos", "dst"))


# --- index


def test_variants_and_copies(spark):
    defs = definitions(spark, [("Dup", "b.js", ["X"], "s2", 10), ("Dup", "a.js", ["X", "Extra", "Extra"], "s1", 5), ("Dup", "c.js", ["X"], "s2", 10), ("Tie", "a.js", [], "s9", 3), ("Tie", "b.js", [], "s8", 3), ("Solo", "a.js", ["Dup", "LivesElsewhere"], "s3", 1)])
    built = {r["name"]: r for r in index.with_fingerprint(index.build(defs)).collect()}
    assert built["Dup"]["raw_sha256"] == "s2" and built["Dup"]["chunk"] == "b.js" and built["Dup"]["dependents"] == ["Solo"]
    v = built["Dup"]["variants"][0]
    assert (v["sha256"], v["deps_added"], v["deps_removed"], v["file"]) == ("s1", ["Extra"], [], "Dup~alt-s1.js")
    assert built["Tie"]["raw_sha256"] == "s8" and built["Dup"]["fingerprint"] == "s1+s2" and built["Solo"]["fingerprint"] == "s3"
    d = index.diagnostics(defs).first()
    assert (d["modules"], d["modules_with_variants"], d["variants"], d["unresolved_total"]) == (3, 2, 2, 2)


def test_file_names(spark):
    names = ["WAWebFoo", "WAWebfoo", "fbjs/lib/invariant", "x" * 401, ".hidden", "", "é", "a b", "..", "plain$@+-_."]
    got = {r["name"]: (r["file"], r["renamed"]) for r in index.file_names(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got["WAWebFoo"] == ("WAWebFoo.js", False) and got["WAWebfoo"][1] and got["plain$@+-_."] == ("plain$@+-_..js", False)
    files = [f for f, _ in got.values()]
    assert len({f.lower() for f in files}) == len(names)
    assert all("/" not in f and len(f.encode()) <= 255 and not f.startswith(".") for f in files)


# --- filters


def spec(**own):
    return filters.blank("mine") | own


def verdicts(df):
    return {r["name"]: r["verdict"] for r in df.collect()}


def test_precedence(spark):
    names = spark.createDataFrame([(n,) for n in ("WAWebSendAction", "RandomAction", "WAWebFoo.pb")], "name string")
    s = spec(hardExclude=[r"\.pb$"], include=["^WAWeb"], exclude=["Action$"])
    assert verdicts(filters.classify(names, s)) == {"WAWebSendAction": "keep", "RandomAction": "drop", "WAWebFoo.pb": "drop"}


def test_allow_list(spark):
    names = spark.createDataFrame([("WASignalCipher",), ("SomethingElse",)], "name string")
    assert verdicts(filters.classify(names, spec(include=["^WASignal"], defaultVerdict="drop"))) == {"WASignalCipher": "keep", "SomethingElse": "drop"}


@pytest.mark.parametrize(
    ("deps", "own", "kept"),
    [
        ({"UiThing": [], "Mid": ["UiThing"], "Top": ["Mid"], "Unrelated": []}, {}, {"Unrelated"}),
        ({"UiThing": [], "WAWebCore": ["UiThing"]}, {"include": ["^WAWeb"]}, {"WAWebCore"}),
        ({"A": ["B", "UiThing"], "B": ["A"], "UiThing": []}, {}, set()),
    ],
)
def test_propagation(spark, deps, own, kept):
    s = spec(exclude=["^Ui"], excludeDependentsOfExcluded=True, **own)
    out = filters.apply(records(spark, deps), s)
    assert {r["name"] for r in out.where("verdict = 'keep'").collect()} == kept
    assert {r["name"] for r in filters.kept(records(spark, deps), s).collect()} == kept


def test_propagation_reason_is_the_first_to_reach(spark):
    deps = {"Ui2": [], "Ui1": [], "B": ["Ui2", "Ui1"], "A": ["Ui2"], "C": ["B", "A"]}
    got = {r["name"]: r["module"] for r in filters.apply(records(spark, deps), spec(exclude=["^Ui"], excludeDependentsOfExcluded=True)).where("module is not null").collect()}
    assert got == {"B": "Ui1", "A": "Ui2", "C": "B"}


def test_builtins(spark):
    want = {"WAWebSendMsgStanza": "keep", "WAWebWid": "keep", "WAWebWidget": "keep", "CometButton": "drop", "useThing": "drop", "Foo.react": "drop", "WAWebFoo.pb": "drop", "FBSomething": "drop"}
    names = spark.createDataFrame([(n,) for n in want], "name string")
    assert verdicts(filters.classify(names, filters.BUILTIN["default"])) == want
    assert verdicts(filters.classify(names, filters.BUILTIN["schemas"]))["WAWebFoo.pb"] == "keep"
    assert [len(filters.BUILTIN["default"][k]) for k in ("hardExclude", "include", "exclude", "noiseDeps", "noiseCode")] == [6, 93, 94, 16, 12]
    assert set(filters.BUILTIN) == {"all", "default", "protocol", "schemas", "wam"}


def test_patches_refuse_unknown_fields():
    assert filters.patched(spec(), {"include": ["x"]})["include"] == ["x"]
    with pytest.raises(ValueError, match="nonsense"):
        filters.patched(spec(), {"nonsense": 1})
    with pytest.raises(ValueError, match="exclude of mine"):
        filters.check(spec(exclude=["("]))


# --- search


@pytest.fixture(scope="module")
def searchable(spark):
    rows = [("WAWebSendMsgStanza", [], ["send"], "s1", "alpha\nsendStanza(1)\nomega"), ("WAWebReceipt", [], ["receipt"], "s2", "a\nsendStanza(2)\nsendStanza(3)"), ("CometButton", [], [], "s3", "x\n"), ("Lost", [], [], "s4", None)]
    full = spark.createDataFrame(rows, "name string, deps array<string>, exports array<string>, raw_sha256 string, text string")
    return full.drop("text"), full.where("text is not null").select("name", F.col("raw_sha256").alias("sha256"), "text")


def test_search(searchable):
    recs, texts = searchable
    r = search.search(recs, texts, source="sendStanza", context=1, most=1)
    hits = r.hits.collect()
    assert [(h["name"], h["match_count"]) for h in hits] == [("WAWebReceipt", 2), ("WAWebSendMsgStanza", 1)]
    m = hits[0]["matches"]
    assert len(m) == 1 and (m[0]["line"], m[0]["before"], m[0]["after"]) == (2, ["a"], ["sendStanza(3)"])
    assert r.stats() == {"candidates": 4, "matched": 2, "truncated": False}
    assert [x["name"] for x in r.unreadable.collect()] == ["Lost"]
    assert [x["name"] for x in search.search(recs, name="^WAWeb", limit=1).hits.collect()] == ["WAWebReceipt"]
    assert search.search(recs, name="^WAWeb", limit=1).stats()["truncated"]
    assert [x["name"] for x in search.search(recs, exports="^rec").hits.collect()] == ["WAWebReceipt"]
    assert search.get(recs, texts, "WAWebReceipt", 2, 1).first()["lines"] == ["sendStanza(2)"]
    assert [x["name"] for x in search.suggest(recs, "SendMsg").collect()] == ["WAWebSendMsgStanza"]
    assert [x["name"] for x in search.suggest(recs, "WAWebReceiptBatcherExtra").collect()] == ["WAWebReceipt"]
    assert search.suggest(recs, "zzz").count() == 0


def test_name_search_reads_no_texts(searchable, capsys):
    search.search(searchable[0], name="WA").hits.explain()
    assert "Join" not in capsys.readouterr().out


# --- diff


def side(spark, rows):
    full = spark.createDataFrame([(n, d, e, s, size, [(v,) for v in vs], t) for n, d, e, s, size, vs, t in rows], "name string, deps array<string>, exports array<string>, raw_sha256 string, stored_len long, variants array<struct<sha256:string>>, text string")
    return full.drop("text"), full.select("name", F.col("raw_sha256").alias("sha256"), "text")


def run(spark, old, new, **options):
    (a, x), (b, y) = side(spark, old), side(spark, new)
    s = spec()
    k = diff.kinds(a, b, s)
    return k, diff.changes(a, b, x, y, s, **options)


def row(name, sha="s", text="t\n", deps=(), exports=(), size=1, variants=()):
    return (name, list(deps), list(exports), sha, size, list(variants), text)


def test_four_kinds(spark):
    k, c = run(spark, [row("Same", "aaa"), row("Gone", "bbb"), row("Changed", "ccc")], [row("Same", "aaa"), row("New", "ddd"), row("Changed", "eee", "u\n")])
    s = diff.summary(k, c).first()
    assert (s["added"], s["removed"], s["modified"], s["unchanged"]) == (1, 1, 1, 1)
    assert s["old_kept"] == s["removed"] + s["modified"] + s["unchanged"] and s["new_kept"] == s["added"] + s["modified"] + s["unchanged"]
    assert [r["name"] for r in diff.listed(c).collect()] == ["Changed", "Gone", "New"]


def test_noise(spark):
    k, c = run(spark, [row("A", "1", "babelHelpers.extends(a)\n")], [row("A", "2", "babelHelpers.extends(b)\n")])
    s = diff.summary(k, c).first()
    assert (s["modified"], s["noise_only"]) == (1, 1) and diff.listed(c).count() == 0 and diff.listed(c, include_noise=True).count() == 1
    _, c = run(spark, [row("A", "1", "babelHelpers.extends(a)\nsendStanza(1)\n")], [row("A", "2", "babelHelpers.extends(b)\nsendStanza(2)\n")])
    assert "sendStanza" in diff.listed(c).first()["hunks"]


def test_noise_dependency_and_variant_only(spark):
    _, c = run(spark, [row("A", "1", deps=["React"]), row("V", "1", variants=["x"])], [row("A", "2", deps=[]), row("V", "1", variants=["y"])])
    got = {r["name"]: r for r in c.collect()}
    assert got["A"]["deps_removed"] == [] and got["A"]["deps_noise_only"]
    assert got["V"]["variant_only"] and got["V"]["noise_only"] and got["V"]["kind"] == "modified"


def test_oversize(spark):
    k, c = run(spark, [row("A", "1", size=5_000_000)], [row("A", "2", "other\n", size=1)])
    assert diff.summary(k, c).first()["diffs_skipped"] == 1 and "maxDiffBytes" in c.first()["hunks_omitted"]


def test_sinks(spark):
    k, c = run(spark, [row("A", "1", "a\n```\n")], [row("A", "2", "b\n```\n"), row("B")])
    lines = [r["value"] for r in render.ndjson(c, {"old": "x"}).collect()]
    assert len(lines) == 3 and '"changes": []' in lines[0] and '"name":"A"' in lines[1]
    assert "````diff" in render.markdown("x", "y", diff.summary(k).first().asDict(), c)
    assert render.size(655 * 2**20) == "655.0 MiB" and render.size(5) == "5 B" and "kind" in render.text(c)
    assert '"name": "A"' in render.rows_json(c)


# --- graph


def near(spark, deps, roots, **options):
    r = records(spark, deps)
    return graph.neighbourhood(r, edges(r), graph.roots_of(r, roots), **options)


def names(g):
    return {r["name"]: r["depth"] for r in g.nodes.collect()}


CHAIN = {"A": ["B"], "B": ["C"], "C": []}


def test_depth(spark):
    assert names(near(spark, CHAIN, ["A"], depth=1)) == {"A": 0, "B": 1}
    assert names(near(spark, CHAIN, ["A"], depth=2)) == {"A": 0, "B": 1, "C": 2}
    assert names(near(spark, CHAIN, ["A"], depth=0)) == {"A": 0, "B": 1, "C": 2}


def test_dependents_and_frontier_edges(spark):
    g = near(spark, {"Core": [], "Caller": ["Core"], "Other": ["Core", "Caller"]}, ["Core"], direction="dependents")
    assert set(names(g)) == {"Core", "Caller", "Other"}
    assert {tuple(r) for r in g.edges.collect()} == {("Caller", "Core"), ("Other", "Core")}  # not the one between the last two


def test_external_and_missing(spark):
    g = near(spark, {"A": ["Elsewhere", "A2"], "A2": []}, ["A"])
    assert {r["name"]: r["present"] for r in g.nodes.collect()} == {"A": True, "A2": True, "Elsewhere": False}
    assert set(names(near(spark, {"A": ["Elsewhere"]}, ["A", "Ghost"], external=False))) == {"A", "Ghost"}
    assert [r["name"] for r in near(spark, {"Lonely": []}, ["Lonely", "Ghost"]).missing.collect()] == ["Ghost"]


def test_cap_admits_in_order(spark):
    g = near(spark, {"A": ["D", "B", "C"], "B": [], "C": [], "D": ["B"]}, ["A"], max_nodes=2)
    assert names(g) == {"A": 0, "D": 1} and g.truncated and {tuple(r) for r in g.edges.collect()} == {("A", "D")}
    assert not near(spark, CHAIN, ["A"], depth=0, max_nodes=3).truncated


def test_counts_keep_repeats(spark):
    got = {r["name"]: (r["dep_count"], r["dependent_count"]) for r in near(spark, {"A": ["B", "B"], "B": []}, ["A"]).nodes.collect()}
    assert got == {"A": (2, 0), "B": (0, 1)}


def test_cycles_of_any_size(spark, tmp_path):
    from modlens.plans import catalogue

    ring = lambda tag, n: [(f"{tag}{i}", f"{tag}{(i + 1) % n}") for i in range(n)]
    tail = [(f"t{i}", f"t{i + 1}") for i in range(40)] + [("t40", "b0")] + [(f"l{i}", "t0") for i in range(30)]
    edges = ring("a", 1) + ring("b", 3) + ring("c", 250) + tail + [("x", "y"), ("y", "none")]
    want = sorted({n for c in graph.cycles(edges) for n in c})
    assert len(want) == 254
    df = spark.createDataFrame([*edges, edges[0]], "src string, dst string")
    assert sorted(r["name"] for r in graph.on_cycles(df).collect()) == want
    assert graph.on_cycles(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        graph.on_cycles(spark.createDataFrame([("a", "b"), ("a", "c")], "src string, dst string"))
    # 7 and the row count have no common factor, so every document is on a ring
    spark.range(200_010).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    assert catalogue.QUERIES["graph_cycles"](spark, str(tmp_path)).distinct().count() == 200_010


def test_cycles_beyond_the_walks_of_the_sql(spark, tmp_path):
    """Rings of up to 200 are those of the SQL, whose walks end there; what comes besides is on longer rings, and nothing is missing."""
    import duckdb

    from modlens.plans import catalogue

    longer = {}
    for n in (2000, 5000, 50_000):
        folder = f"{tmp_path}/{n}"
        spark.range(n).withColumnRenamed("id", "doc_id").coalesce(1).write.parquet(f"{folder}/documents.parquet")
        ring = {}  # its length, by member; 7 has no factor in common with n, so all are on rings
        for a in range(n):
            if a not in ring:
                own, b = [a], (7 * a + 3) % n
                while b != a:
                    own.append(b)
                    b = (7 * b + 3) % n
                ring |= dict.fromkeys(own, len(own))
        c = duckdb.connect()
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        want = sorted(r[0] for r in c.execute(catalogue.ORACLES["graph_cycles"]).fetchall())
        got = sorted(r["name"] for r in catalogue.QUERIES["graph_cycles"](spark, folder).collect())
        assert got == sorted(f"doc:{a}" for a in range(n))
        assert want == sorted(f"doc:{a}" for a, k in ring.items() if k <= 200)
        longer[n] = len(got) - len(want)
    assert longer == {2000: 0, 5000: 0, 50_000: 40_000}


def test_cycles_and_renderers(spark):
    assert graph.cycles([("A", "B"), ("B", "C"), ("C", "A")]) == [["A", "B", "C", "A"]]
    assert graph.cycles([("b", "a"), ("a", "a"), ("a", "b")]) == [["a", "a"], ["a", "b", "a"]]
    assert graph.cycles([("A", "B")]) == []
    g = near(spark, {'A"q': ["B"], "B": []}, ['A"q'])
    assert '"A\\"q" -> "B";' in graph.dot(g) and "n0 --> n1" in graph.mermaid(g)


def test_missing_text_is_an_error(spark):
    (a, x), (b, y) = side(spark, [row("A", "1")]), side(spark, [row("A", "2", "u\n")])
    with pytest.raises(Exception, match="no old text is stored for A"):
        diff.changes(a, b, x.limit(0), y, spec()).collect()
    unknown = a.withColumn("stored_len", F.lit(None).cast("long"))
    assert diff.changes(unknown, b.withColumn("stored_len", F.lit(None).cast("long")), x, y, spec()).first()["lines_added"] == 1


def test_limits_tell_what_they_leave_out(spark):
    k, c = run(spark, [], [row(f"M{i:03}") for i in range(250)])
    told = diff.summary(k).first().asDict()
    whole = render.markdown("x", "y", told, c)
    assert whole.count("### ") == 250 and "left out" not in whole
    assert "247 more changes are left out" in render.markdown("x", "y", told, c, limit=3)
    assert len(render.text(c).splitlines()) == 251 and render.text(c, limit=4).endswith("246 more rows\n")
