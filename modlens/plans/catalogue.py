"""Every registered query, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as X
from ..functions.scratch import cut
from ..operators import diff, filters, graph, index, search
from ..sources import catalog, corpus

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- the corpora of sources/corpus.py in SQL -----------------------------------------------------

_DEFS = """d AS (SELECT lang || '.' || left(sha256(left(text, 24)), 8) AS name, printf('%012d', doc_id) AS chunk, sha256(text) AS sha, strlen(text)::BIGINT AS len,
  string_split(text, ' ')[1:6] AS deps, string_split(text, ' ')[7:14] AS ex FROM documents),
u AS (SELECT name, sha, min(chunk) AS chunk, any_value(len) AS len, any_value(deps) AS deps, count(*) AS copies FROM d GROUP BY name, sha),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY len DESC, sha) AS rank, count(*) OVER (PARTITION BY name) AS n FROM u),
p AS (SELECT * FROM r WHERE rank = 1)"""

_REV = """b AS (SELECT doc_id, source || '.' || lang || '.' || doc_id AS name, text || chr(10) AS text, string_split(text, ' ')[1:6] AS deps, list_sort(list_distinct(string_split(text, ' ')[7:14])) AS ex FROM documents),
o AS (SELECT *, sha256(text || '|' || array_to_string(deps, ' ') || '|' || array_to_string(ex, ' ')) AS sha FROM b WHERE doc_id % 10 <> 0),
n0 AS (SELECT doc_id, name, text || CASE WHEN doc_id % 14 = 0 THEN 'babelHelpers.extends(a)' || chr(10) WHEN doc_id % 7 = 0 THEN 'added line ' || doc_id || chr(10) || 'second added line' || chr(10) ELSE '' END AS text,
  list_concat(deps, CASE WHEN doc_id % 14 = 0 THEN ['React'] ELSE [] END, CASE WHEN doc_id % 21 = 0 THEN ['added_sym'] ELSE [] END) AS deps,
  list_sort(list_distinct(list_concat(ex, CASE WHEN doc_id % 21 = 0 THEN ['added_sym'] ELSE [] END))) AS ex FROM b WHERE doc_id % 10 <> 1),
n AS (SELECT *, sha256(text || '|' || array_to_string(deps, ' ') || '|' || array_to_string(ex, ' ')) AS sha FROM n0),
k AS (SELECT coalesce(o.name, n.name) AS name, coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed' WHEN o.sha = n.sha THEN 'unchanged' ELSE 'modified' END AS kind,
  coalesce(o.deps, []) AS od, coalesce(n.deps, []) AS nd, coalesce(o.ex, []) AS oe, coalesce(n.ex, []) AS ne, o.text AS ot, n.text AS nt FROM o FULL JOIN n ON o.name = n.name)"""

_ENT = """e AS (SELECT 'order:' || o_orderkey AS src, 0 AS pos, 'customer:' || o_custkey AS dst FROM orders
  UNION ALL SELECT src, min(pos), dst FROM (SELECT 'order:' || l_orderkey AS src, 2 * l_linenumber - 1 AS pos, 'part:' || l_partkey AS dst FROM lineitem UNION ALL SELECT 'order:' || l_orderkey, 2 * l_linenumber, 'supplier:' || l_suppkey FROM lineitem) GROUP BY src, dst
  UNION ALL SELECT 'customer:' || c_custkey, 0, 'nation:' || c_nationkey FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 0, 'nation:' || s_nationkey FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 0, 'region:' || n_regionkey FROM nation),
v AS (SELECT 'order:' || o_orderkey AS name FROM orders UNION ALL SELECT 'customer:' || c_custkey FROM customer UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier UNION ALL SELECT 'part:' || p_partkey FROM part UNION ALL SELECT 'nation:' || n_nationkey FROM nation)"""

RULES = filters.blank("rules") | {"hardExclude": [r"^es\."], "include": [r"^en\.[0-7]", r"^de\.[0-9]"], "exclude": [r"[0-3]$", r"\.[a-c]", r"^fr\.(?i)[D-F]"]}
_RULES = r"""CASE WHEN regexp_matches(name, '^es\.') THEN 'hardExclude' WHEN regexp_matches(name, '^en\.[0-7]|^de\.[0-9]') THEN 'include' WHEN regexp_matches(name, '[0-3]$|\.[a-c]|^fr\.(?i:[D-F])') THEN 'exclude' ELSE 'default' END"""
SPREAD = filters.blank("spread") | {"hardExclude": [r"^supplier:1$"], "include": [r"^order:\d*0$"], "exclude": [r"^nation:(?:3|7)$"], "excludeDependentsOfExcluded": True}
NOTHING = filters.blank("nothing")


# --- index -----------------------------------------------------------------------------------------


def _distinct(spark, folder):
    return index.distinct_definitions(corpus.definitions(spark, folder))


@query(f"WITH {_DEFS} SELECT name, chunk, sha AS raw_sha256, len AS raw_len, copies::BIGINT AS copies, n::BIGINT AS definitions FROM p")
def index_primary(spark, folder):
    return index.primaries(_distinct(spark, folder)).select("name", "chunk", "raw_sha256", "raw_len", "copies", "definitions")


@query(f"WITH {_DEFS} SELECT name, sha AS sha256, len AS raw_len FROM r WHERE rank > 1")
def index_variants(spark, folder):
    d = _distinct(spark, folder)
    return index.variants(d, index.primaries(d)).select("name", "sha256", "raw_len")


@query(f"""WITH {_DEFS}, x AS (SELECT r.name, r.sha, list_sort(list_distinct(list_filter(r.deps, lambda x: NOT list_contains(p.deps, x)))) AS a, list_sort(list_distinct(list_filter(p.deps, lambda x: NOT list_contains(r.deps, x)))) AS b FROM r JOIN p USING (name) WHERE r.rank > 1)
SELECT name, sha AS sha256, array_to_string(a, ' ') AS added, array_to_string(b, ' ') AS removed FROM x""")
def index_variant_dep_delta(spark, folder):
    d = _distinct(spark, folder)
    return index.variants(d, index.primaries(d)).select("name", "sha256", F.array_join("deps_added", " ").alias("added"), F.array_join("deps_removed", " ").alias("removed"))


@query(f"WITH {_DEFS} SELECT name, string_agg(sha, '+' ORDER BY sha) AS fingerprint FROM u GROUP BY name")
def index_fingerprint(spark, folder):
    return index.fingerprints(corpus.definitions(spark, folder))


@query(f"WITH {_ENT} SELECT dst AS name, count(DISTINCT src)::BIGINT AS n, min(src) AS first, max(src) AS last FROM e WHERE dst IN (SELECT name FROM v) AND src IN (SELECT name FROM v) GROUP BY dst")
def index_dependents(spark, folder):
    names, edges = corpus.entity_names(spark, folder), corpus.entity_edges(spark, folder)
    return index.dependent_counts(names, edges)


@query("""SELECT DISTINCT h AS name FROM (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM pages)""")
def index_unresolved(spark, folder):
    return index.unresolved(corpus.link_graph(spark, folder)[0])


@query(f"""WITH {_DEFS} SELECT count(*)::BIGINT AS modules, sum(len)::BIGINT AS modules_bytes, count(*) FILTER (WHERE n > 1)::BIGINT AS modules_with_variants, sum(n - 1)::BIGINT AS variants,
(SELECT count(DISTINCT x) FROM (SELECT unnest(deps) AS x FROM p) WHERE x NOT IN (SELECT name FROM p))::BIGINT AS unresolved_total FROM p""")
def index_diagnostics(spark, folder):
    d = index.diagnostics(corpus.definitions(spark, folder))
    return d.select("modules", F.col("modules_bytes").cast("long").alias("modules_bytes"), "modules_with_variants", F.col("variants").cast("long").alias("variants"), "unresolved_total")


def _urls(spark, folder) -> DataFrame:
    p = corpus.table(spark, folder, "pages")
    return p.select(F.explode(F.array(F.col("url"), F.concat(F.lit("P"), F.col("page_id").cast("string")), F.concat(F.lit("p"), F.col("page_id").cast("string")), F.concat(F.lit("."), F.col("page_id").cast("string")))).alias("name"))


@query(r"""WITH u AS (SELECT DISTINCT unnest([url, 'P' || page_id, 'p' || page_id, '.' || page_id]) AS name FROM pages),
s AS (SELECT name, strlen(name) <= 200 AND regexp_full_match(name, '[A-Za-z0-9_\-@+$][A-Za-z0-9_\-.@+$]*') AS safe,
  regexp_replace(regexp_replace(name, '[^A-Za-z0-9_\-.@+$]', '_', 'g'), '^\.', '_.') AS clean FROM u),
t AS (SELECT *, left(clean, 200) || '~' || left(sha256(name), 10) AS tagged, CASE WHEN safe THEN name ELSE left(clean, 200) || '~' || left(sha256(name), 10) END AS stem FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY lower(stem) ORDER BY name) AS r FROM t)
SELECT name, CASE WHEN r > 1 THEN tagged ELSE stem END || '.js' AS file, r > 1 OR NOT safe AS renamed FROM k""")
def file_names(spark, folder):
    return index.file_names(_urls(spark, folder))


@query(f"""WITH {_DEFS}, e AS (SELECT name, count(*) AS n_variants FROM r WHERE rank > 1 GROUP BY name)
SELECT name, name || '.js' AS file, coalesce(n_variants, 0)::BIGINT AS n_variants FROM p LEFT JOIN e USING (name)""")
def index_build(spark, folder):
    return index.build(corpus.definitions(spark, folder)).select("name", "file", F.size("variants").cast("long").alias("n_variants"))


# --- catalog -----------------------------------------------------------------------------------------


def _bundles(spark, folder):
    """Orders as revisions: their priority is the platform."""
    o = corpus.table(spark, folder, "orders")
    at = F.col("o_custkey") % 4
    return o.select(F.get(F.array(*[F.lit(p) for p in catalog.PLATFORMS]), at.cast("int")).alias("platform"), F.col("o_orderkey").alias("revision"))


_BUNDLES = "b AS (SELECT ['whatsapp', 'messenger', 'facebook', 'instagram'][o_custkey % 4 + 1] AS platform, o_orderkey AS revision FROM orders)"


@query(f"WITH {_BUNDLES} SELECT platform, platform || '-' || max(revision) AS bundle, max(revision) AS revision FROM b GROUP BY platform")
def catalog_latest(spark, folder):
    return catalog.latest(_bundles(spark, folder))


@query(f"WITH {_BUNDLES}, r AS (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY revision DESC) AS k FROM b) SELECT platform, max(revision) FILTER (WHERE k = 2) AS older, max(revision) FILTER (WHERE k = 1) AS newer FROM r WHERE k <= 2 GROUP BY platform HAVING count(*) = 2")
def catalog_latest_pair(spark, folder):
    return catalog.latest_pairs(_bundles(spark, folder))


@query(f"WITH {_BUNDLES} SELECT platform || '-' || revision AS bundle, list_position(['whatsapp', 'messenger', 'facebook', 'instagram'], platform)::INTEGER - 1 AS platform_ord, revision FROM b")
def catalog_list(spark, folder):
    return catalog.listed(_bundles(spark, folder)).select("bundle", "platform_ord", "revision")


# --- filter ------------------------------------------------------------------------------------------


def _names(spark, folder):
    return corpus.definitions(spark, folder).select("name").distinct()


@query(f"WITH {_DEFS} SELECT name, CASE WHEN {_RULES} IN ('include', 'default') THEN 'keep' ELSE 'drop' END AS verdict FROM p")
def filter_classify(spark, folder):
    return filters.classify(_names(spark, folder), RULES).select("name", "verdict")


@query(rf"""WITH {_DEFS}, x AS (SELECT name, {_RULES} AS reason FROM p)
SELECT name, reason, CASE reason WHEN 'hardExclude' THEN '^es\.' WHEN 'include' THEN CASE WHEN regexp_matches(name, '^en\.[0-7]') THEN '^en\.[0-7]' ELSE '^de\.[0-9]' END
 WHEN 'exclude' THEN CASE WHEN regexp_matches(name, '[0-3]$') THEN '[0-3]$' WHEN regexp_matches(name, '\.[a-c]') THEN '\.[a-c]' ELSE '^fr\.(?i)[D-F]' END END AS pattern FROM x""")
def filter_reason(spark, folder):
    return filters.classify(_names(spark, folder), RULES).select("name", "reason", "pattern")


_SPREAD = f"""{_ENT}, c AS (SELECT name, name = 'supplier:1' AS hard, regexp_matches(name, '^order:\\d*0$') AS pin, regexp_matches(name, '^nation:(3|7)$') AS ex FROM v),
g AS (SELECT name FROM c WHERE hard OR (ex AND NOT pin) UNION SELECT e.src FROM g JOIN e ON e.dst = g.name JOIN c ON c.name = e.src WHERE NOT c.pin),
a AS (SELECT c.name, CASE WHEN hard OR (ex AND NOT pin) OR g.name IS NOT NULL THEN 'drop' ELSE 'keep' END AS verdict,
  CASE WHEN hard THEN 'hardExclude' WHEN pin THEN 'include' WHEN ex THEN 'exclude' WHEN g.name IS NOT NULL THEN 'dependsOnExcluded' ELSE 'default' END AS reason FROM c LEFT JOIN g USING (name))"""


@query(f"WITH RECURSIVE {_SPREAD} SELECT name, verdict, reason FROM a")
def filter_propagate(spark, folder):
    return filters.apply(*_spread(spark, folder)).select("name", "verdict", "reason")


def _spread(spark, folder):
    records, edges = corpus.entity_graph(spark, folder)
    return records, SPREAD, edges


@query(f"""WITH {_ENT}, s AS (SELECT name FROM v WHERE name = 'supplier:1' OR regexp_matches(name, '^nation:(3|7)$')),
l1 AS (SELECT e.src AS name, min(e.dst) AS module FROM e JOIN s ON s.name = e.dst JOIN v ON v.name = e.src WHERE NOT regexp_matches(e.src, '^order:\\d*0$') AND e.src NOT IN (SELECT name FROM s) GROUP BY e.src),
l2 AS (SELECT e.src AS name, arg_min(l1.name, l1.module || chr(1) || l1.name) AS module FROM e JOIN l1 ON l1.name = e.dst JOIN v ON v.name = e.src WHERE NOT regexp_matches(e.src, '^order:\\d*0$') AND e.src NOT IN (SELECT name FROM s UNION SELECT name FROM l1) GROUP BY e.src)
SELECT * FROM l1 UNION ALL SELECT * FROM l2""")
def filter_propagate_reason(spark, folder):
    return filters.apply(*_spread(spark, folder)).where("reason = 'dependsOnExcluded'").select("name", "module")


@query(f"WITH RECURSIVE {_SPREAD} SELECT reason, count(*)::BIGINT AS n FROM a WHERE verdict = 'drop' GROUP BY reason")
def filter_breakdown(spark, folder):
    return filters.breakdown(filters.apply(*_spread(spark, folder)))


@query(f"""WITH {_DEFS}, x AS (SELECT name, {_RULES} AS reason FROM p), y AS (SELECT *, CASE WHEN reason IN ('include', 'default') THEN 'keep' ELSE 'drop' END AS verdict FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY verdict ORDER BY name) AS k FROM y) SELECT verdict, name, reason FROM z WHERE k <= 20""")
def filter_test_sample(spark, folder):
    return filters.samples(filters.classify(_names(spark, folder), RULES), 20)


@query("SELECT name, verdict FROM (VALUES ('WAWebSendMsgStanza', 'keep'), ('CometButton', 'drop'), ('Foo.react', 'drop'), ('WAWebFoo.pb', 'drop'), ('SomethingElse', 'keep'), ('WAWebWidget', 'keep'), ('useThing', 'drop')) t(name, verdict)")
def filter_builtin_default(spark, folder):
    names = ["WAWebSendMsgStanza", "CometButton", "Foo.react", "WAWebFoo.pb", "SomethingElse", "WAWebWidget", "useThing"]
    return filters.classify(spark.createDataFrame([(n,) for n in names], "name string"), filters.BUILTIN["default"]).select("name", "verdict")


# --- search ------------------------------------------------------------------------------------------


def _older(spark, folder):
    return corpus.revisions(spark, folder)[0]


_LINES = rf"""{_REV}, t AS (SELECT name, unnest(string_split(text, chr(10))[1:-2]) AS line, unnest(range(1, len(string_split(text, chr(10))))) AS no FROM o),
h AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY no) AS k, count(*) OVER (PARTITION BY name) AS c FROM t WHERE regexp_matches(line, '(?i)ation.*the|Licensed')),
top AS (SELECT name FROM (SELECT DISTINCT name FROM h) ORDER BY name LIMIT 50)"""
_SOURCE = r"(?i)ation.*the|Licensed"


@query(f"WITH {_REV} SELECT name FROM o WHERE regexp_matches(name, '^src1\\d?\\.(en|fr)') ORDER BY name LIMIT 200")
def search_name(spark, folder):
    return search.search(_older(spark, folder)[0], name=r"^src1\d?\.(en|fr)", limit=200).hits.select("name")


@query(f"WITH {_REV} SELECT name FROM o WHERE len(list_filter(ex, lambda x: regexp_matches(x, '^(?i:THE)$|eaux'))) > 0 ORDER BY name LIMIT 100")
def search_exports(spark, folder):
    return search.search(_older(spark, folder)[0], exports=r"(?i)^THE$|eaux", limit=100).hits.select("name")


def _hits(spark, folder, **options):
    records, sources = _older(spark, folder)
    return search.search(records, sources, source=_SOURCE, **options)


@query(f"WITH {_LINES} SELECT name, no::INTEGER AS line, line AS text FROM h WHERE k <= 5 AND name IN (FROM top)")
def search_source_lines(spark, folder):
    return _hits(spark, folder).hits.select("name", F.explode("matches").alias("m")).select("name", "m.line", "m.text")


@query(f"WITH {_LINES}, a AS (SELECT name, list(line ORDER BY no) AS ls FROM t GROUP BY name) SELECT h.name, no::INTEGER AS line, array_to_string(ls[greatest(no - 2, 1):no - 1], chr(10)) AS before, array_to_string(ls[no + 1:no + 2], chr(10)) AS after FROM h JOIN a USING (name) WHERE k <= 5 AND h.name IN (FROM top)")
def search_context(spark, folder):
    return _hits(spark, folder, context=2).hits.select("name", F.explode("matches").alias("m")).select("name", "m.line", F.array_join("m.before", "\n").alias("before"), F.array_join("m.after", "\n").alias("after"))


@query(f"WITH {_LINES} SELECT DISTINCT name, c::INTEGER AS match_count FROM h")
def search_counts(spark, folder):
    return _hits(spark, folder).matched.select("name", "match_count")


@query(f"WITH {_LINES} SELECT (SELECT count(*) FROM o)::BIGINT AS candidates, count(DISTINCT name)::BIGINT AS matched, count(DISTINCT name) > 50 AS truncated FROM h")
def search_stats(spark, folder):
    r = _hits(spark, folder)
    one = r.candidates.agg(F.count("*").alias("candidates")).crossJoin(r.matched.agg(F.count("*").alias("matched")))  # one row each
    return one.withColumn("truncated", F.col("matched") > r.limit)


@query(f"WITH {_LINES} SELECT DISTINCT name, c::INTEGER AS match_count FROM h ORDER BY name LIMIT 10")
def search_topk(spark, folder):
    return _hits(spark, folder, limit=10).hits.select("name", "match_count")


@query(rf"WITH {_LINES} SELECT DISTINCT name FROM h WHERE regexp_matches(name, '\.en\.') ORDER BY name LIMIT 50")
def search_filtered(spark, folder):
    records, sources = _older(spark, folder)
    spec = NOTHING | {"include": [r"\.en\."], "defaultVerdict": "drop"}
    return search.search(records, sources, source=_SOURCE, kept=filters.kept(records, spec)).hits.select("name")


@query(f"WITH {_REV} SELECT name FROM o WHERE contains(lower(name), 'en.1') OR contains('en.1', lower(name)) ORDER BY name LIMIT 10")
def module_suggest(spark, folder):
    return search.suggest(_older(spark, folder)[0], "EN.1")


@query(f"WITH {_REV} SELECT name, array_to_string(string_split(text, chr(10))[1:-2][2:4], chr(10)) AS lines FROM o")
def module_read_lines(spark, folder):
    return _older(spark, folder)[1].select("name", F.array_join(X.read_lines(F.col("text"), 2, 3), "\n").alias("lines"))


@query(f"WITH {_REV} SELECT name, sha AS raw_sha256, strlen(text)::BIGINT AS stored_len, array_to_string(string_split(text, chr(10))[1:-2][1:2], chr(10)) AS lines FROM o WHERE doc_id = 15")
def module_get(spark, folder):
    records, sources = _older(spark, folder)
    name = records.where("name like '%.15'").select("name").first()["name"]
    return search.get(records, sources, name, 1, 2).select("name", "raw_sha256", "stored_len", F.array_join("lines", "\n").alias("lines"))


# --- diff --------------------------------------------------------------------------------------------


def _kinds(spark, folder):
    (old, _), (new, _) = corpus.revisions(spark, folder)
    return diff.kinds(old, new, NOTHING)


def _changes(spark, folder, **options):
    (old, old_text), (new, new_text) = corpus.revisions(spark, folder)
    return diff.changes(old, new, old_text, new_text, NOTHING, **options)


@query(f"WITH {_REV} SELECT name, kind FROM k")
def diff_kind(spark, folder):
    return _kinds(spark, folder).select("name", "kind")


@query(f"""WITH {_REV} SELECT count(*) FILTER (WHERE kind = 'added')::BIGINT AS added, count(*) FILTER (WHERE kind = 'removed')::BIGINT AS removed, count(*) FILTER (WHERE kind = 'modified')::BIGINT AS modified,
count(*) FILTER (WHERE kind = 'unchanged')::BIGINT AS unchanged, count(*) FILTER (WHERE kind <> 'added')::BIGINT AS old_kept, count(*) FILTER (WHERE kind <> 'removed')::BIGINT AS new_kept,
count(*) FILTER (WHERE kind = 'modified' AND (doc_id % 14 = 0 OR doc_id % 7 <> 0))::BIGINT AS noise_only, 0::BIGINT AS diffs_skipped FROM k""")
def diff_summary(spark, folder):
    (_, old_text), (_, new_text) = corpus.revisions(spark, folder)
    kinds = cut(_kinds(spark, folder))
    return diff.summary(kinds, diff.compared(kinds, old_text, new_text, NOTHING, context=None))


_DELTA = "list_sort(list_distinct(list_filter({a}, lambda x: NOT list_contains({b}, x))))"
_SIGNAL = "list_filter(" + _DELTA + ", lambda x: NOT regexp_matches(x, '(?i)^(react|stylex|fbjs)|^(Promise|asyncToGeneratorRuntime|asyncGeneratorRuntime|fbt|once|invariant|nullthrows|emptyFunction|performanceNow|ExecutionEnvironment|classnames|shallowEqual|warning)$'))"


@query(f"""WITH {_REV}, x AS (SELECT name, kind, {_SIGNAL.format(a='nd', b='od')} AS a, {_SIGNAL.format(a='od', b='nd')} AS r, len({_DELTA.format(a='nd', b='od')}) + len({_DELTA.format(a='od', b='nd')}) AS raw FROM k WHERE kind <> 'unchanged')
SELECT name, array_to_string(a, ' ') AS added, array_to_string(r, ' ') AS removed, kind = 'modified' AND raw > 0 AND len(a) + len(r) = 0 AS deps_noise_only FROM x""")
def diff_deps_signal(spark, folder):
    m = diff.metadata(_kinds(spark, folder), NOTHING)
    return m.select("name", F.array_join("deps_added", " ").alias("added"), F.array_join("deps_removed", " ").alias("removed"), "deps_noise_only")


@query(f"WITH {_REV} SELECT name, array_to_string({_DELTA.format(a='ne', b='oe')}, ' ') AS added, array_to_string({_DELTA.format(a='oe', b='ne')}, ' ') AS removed FROM k WHERE kind <> 'unchanged'")
def diff_exports(spark, folder):
    m = diff.metadata(_kinds(spark, folder), NOTHING)
    return m.select("name", F.array_join("exports_added", " ").alias("added"), F.array_join("exports_removed", " ").alias("removed"))


_GREW = "CASE WHEN doc_id % 14 = 0 THEN 1 WHEN doc_id % 7 = 0 THEN 2 ELSE 0 END"


@query(f"WITH {_REV} SELECT name, {_GREW}::INTEGER AS lines_added, 0::INTEGER AS lines_removed FROM k WHERE kind = 'modified'")
def diff_line_counts(spark, folder):
    return _changes(spark, folder).where("kind = 'modified'").select("name", "lines_added", "lines_removed")


@query(f"WITH {_REV}, x AS (SELECT name, len(ot) - len(replace(ot, chr(10), '')) AS n, {_GREW} AS g FROM k WHERE kind = 'modified') SELECT name, round(2 * n / (2 * n + g), 6) AS similarity FROM x")
def diff_similarity(spark, folder):
    return _changes(spark, folder).where("kind = 'modified'").select("name", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_REV} SELECT name, doc_id % 14 = 0 OR doc_id % 7 <> 0 AS noise_only FROM k WHERE kind = 'modified'")
def diff_noise_only(spark, folder):
    return _changes(spark, folder).where("kind = 'modified'").select("name", "noise_only")


@query(f"WITH {_REV} SELECT name, greatest(strlen(ot), strlen(nt)) > 3000 AS omitted FROM k WHERE kind = 'modified'")
def diff_oversize(spark, folder):
    return _changes(spark, folder, max_diff_bytes=3000).where("kind = 'modified'").select("name", F.col("lines_added").isNull().alias("omitted"))


@query(f"WITH {_REV} SELECT name, kind FROM k WHERE kind IN ('added', 'removed') OR (kind = 'modified' AND doc_id % 7 = 0 AND doc_id % 14 <> 0) ORDER BY name LIMIT 40")
def diff_listed(spark, folder):
    return diff.listed(_changes(spark, folder), limit=40).select("name", "kind")


@query(f"WITH {_REV} SELECT split_part(name, '.', 1) AS key, kind, count(*)::BIGINT AS n FROM k WHERE kind <> 'unchanged' GROUP BY ALL")
def diff_group_by(spark, folder):
    return diff.grouped(diff.metadata(_kinds(spark, folder), NOTHING), F.split("name", r"\.")[0])


@query(f"""WITH {_REV} SELECT name, '--- old' || chr(10) || '+++ new' || chr(10) || '@@ -' || m || ',1 +' || m || ',3 @@' || chr(10) || ' ' || string_split(ot, chr(10))[-2] || chr(10) || '+added line ' || doc_id || chr(10) || '+second added line' || chr(10) AS hunks
FROM (SELECT *, len(ot) - len(replace(ot, chr(10), '')) AS m FROM k) WHERE kind = 'modified' AND doc_id % 7 = 0 AND doc_id % 14 <> 0""")
def diff_hunks(spark, folder):
    return _changes(spark, folder, context=1).where("hunks is not null").select("name", "hunks")


# --- graph -------------------------------------------------------------------------------------------


def _near(spark, folder, pattern, **options):
    records, edges = corpus.entity_graph(spark, folder)
    return graph.neighbourhood(records, edges, graph.roots_of(records, pattern=pattern), max_nodes=None, **options)


_ROOT = "regexp_matches(name, '^order:\\d*7$')"
_D1 = f"{_ENT}, r0 AS (SELECT name, 0 AS depth FROM v WHERE {_ROOT}), r1 AS (SELECT DISTINCT dst AS name, 1 AS depth FROM e JOIN r0 ON r0.name = e.src WHERE dst NOT IN (SELECT name FROM r0))"
_D2 = _D1 + ", r2 AS (SELECT DISTINCT dst AS name, 2 AS depth FROM e JOIN r1 ON r1.name = e.src WHERE dst NOT IN (SELECT name FROM r0 UNION SELECT name FROM r1))"


@query(f"WITH {_D1} SELECT x.name, depth FROM (FROM r0 UNION ALL FROM r1) x")
def graph_deps_d1(spark, folder):
    return _near(spark, folder, r"^order:\d*7$", depth=1).nodes.select("name", "depth")


@query(f"WITH {_D2} SELECT x.name, depth FROM (FROM r0 UNION ALL FROM r1 UNION ALL FROM r2) x")
def graph_deps_d2(spark, folder):
    return _near(spark, folder, r"^order:\d*7$", depth=2).nodes.select("name", "depth")


@query(f"WITH {_D1} SELECT DISTINCT src, dst FROM e JOIN r0 ON r0.name = e.src")
def graph_edges(spark, folder):
    return _near(spark, folder, r"^order:\d*7$", depth=1).edges.select("src", "dst")


@query(f"""WITH {_D1} SELECT x.name, depth, x.name IN (SELECT name FROM v) AS present, coalesce(d, 0)::INTEGER AS dep_count, CASE WHEN x.name IN (SELECT name FROM v) THEN coalesce(i, 0) ELSE 0 END::BIGINT AS dependent_count
FROM (FROM r0 UNION ALL FROM r1) x LEFT JOIN (SELECT src, count(*) AS d FROM e WHERE src IN (SELECT name FROM v) GROUP BY src) a ON a.src = x.name LEFT JOIN (SELECT dst, count(DISTINCT src) AS i FROM e GROUP BY dst) b ON b.dst = x.name""")
def graph_nodes(spark, folder):
    return _near(spark, folder, r"^order:\d*7$", depth=1).nodes.select("name", "depth", "present", "dep_count", "dependent_count")


@query(f"""WITH {_ENT}, r1 AS (SELECT DISTINCT src AS name FROM e WHERE dst = 'nation:3'), r2 AS (SELECT DISTINCT src AS name FROM e WHERE dst IN (SELECT name FROM r1) AND src NOT IN (SELECT name FROM r1))
SELECT 'nation:3' AS name, 0 AS depth UNION ALL SELECT name, 1 FROM r1 UNION ALL SELECT name, 2 FROM r2""")
def graph_dependents(spark, folder):
    return _near(spark, folder, r"^nation:3$", direction="dependents", depth=2).nodes.select("name", "depth")


@query(f"WITH {_ENT} SELECT 'customer:5' AS name, 0 AS depth UNION ALL SELECT DISTINCT dst, 1 FROM e WHERE src = 'customer:5' UNION ALL SELECT DISTINCT src, 1 FROM e WHERE dst = 'customer:5'")
def graph_both(spark, folder):
    return _near(spark, folder, r"^customer:5$", direction="both", depth=1).nodes.select("name", "depth")


@query(f"WITH RECURSIVE {_ENT}, g AS (SELECT name FROM v WHERE {_ROOT} UNION SELECT e.dst FROM g JOIN e ON e.src = g.name) SELECT name FROM g")
def graph_unbounded(spark, folder):
    return _near(spark, folder, r"^order:\d*7$", depth=0).nodes.select("name")


@query(f"WITH {_ENT} SELECT DISTINCT dst AS name, dst IN (SELECT name FROM v) AS present FROM e WHERE src LIKE 'nation:%' UNION SELECT name, true FROM v WHERE name LIKE 'nation:%'")
def graph_external(spark, folder):
    return _near(spark, folder, r"^nation:", depth=1).nodes.select("name", "present")


@query(f"WITH {_ENT} SELECT name FROM v WHERE name LIKE 'nation:%'")
def graph_no_external(spark, folder):
    return _near(spark, folder, r"^nation:", depth=1, external=False).nodes.select("name")


@query("SELECT * FROM (VALUES ('nation:999'), ('order:none')) t(name)")
def graph_missing_roots(spark, folder):
    records, edges = corpus.entity_graph(spark, folder)
    roots = graph.roots_of(records, ["nation:1", "nation:999", "order:none"])
    return graph.neighbourhood(records, edges, roots).missing


@query(f"""WITH {_D1}, c AS (SELECT dst AS name, min(r0.name || chr(1) || printf('%05d', pos) || chr(1) || dst) AS place FROM e JOIN r0 ON r0.name = e.src WHERE dst NOT IN (SELECT name FROM r0) GROUP BY dst)
SELECT name, 0 AS depth FROM r0 UNION ALL SELECT * FROM (SELECT name, 1 AS depth FROM c ORDER BY place LIMIT (SELECT greatest(2000 - count(*), 0) FROM r0))""")
def graph_truncated(spark, folder):
    records, edges = corpus.entity_graph(spark, folder)
    return graph.neighbourhood(records, edges, graph.roots_of(records, pattern=r"^order:\d*7$"), depth=1).nodes.select("name", "depth")


@query("""WITH RECURSIVE n AS (SELECT count(*) AS n FROM documents), e AS (SELECT doc_id AS a, (7 * doc_id + 3) % n AS b FROM documents, n),
w AS (SELECT a AS start, b AS cur, 1 AS len FROM e UNION ALL SELECT start, b, len + 1 FROM w JOIN e ON e.a = w.cur WHERE w.cur <> w.start AND len < 200)
SELECT 'doc:' || start AS name FROM w WHERE cur = start""")
def graph_cycles(spark, folder):
    _, edges = corpus.cyclic_graph(spark, folder)
    return graph.on_cycles(edges)


