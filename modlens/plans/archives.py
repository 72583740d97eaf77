"""Registered queries over chunk files, stored bundles, edited texts and renders, with their SQL."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scratch import cut, folder_of
from ..operators import diff, filters, graph, index, render, search
from ..session import counter_map
from ..sources import archive, catalog, corpus
from .catalogue import _BUNDLES, _ENT, _REV, _SPREAD, NOTHING, SPREAD, _bundles, _kinds, _older, query

# --- chunk files ---------------------------------------------------------------------------------

_CHUNKS = r"""x AS (SELECT doc_id AS k, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
c0 AS (SELECT k, lang, k || CASE WHEN k % 11 = 2 THEN '.txt' ELSE '.js' END AS base, k % 11 = 2 AS skipped, k % 11 <> 2 AND (k % 11 = 0 OR k % 13 = 0) AS failed,
  '__d("Doc' || k || '",["Doc' || (k % 97) || '","' || lang || '"],(function(t,n,r,o,a,i){function run' || (k % 7) || '(){return "' || sha256(t) || '"}' || chr(10) || 'var k=1' || chr(10) || 'function go' || (k % 4) || '(){}'
    || chr(10) || 'var f=()=>k' || chr(10) || 'i.make' || (k % 3) || '=run' || (k % 7) || ';a.exports.extra=2}),' || k || ')' AS own,
  '__d("Shared' || (k % 40) || '",["x' || (k % 3) || '"],function(){return "' || source || '"},1)' AS second FROM x),
c AS (SELECT *, encode(own || CASE WHEN k % 4 = 0 THEN chr(10) || ';' || second ELSE '' END || CASE WHEN k % 11 = 1 THEN ';__d(some,[],f,1)' ELSE '' END || CASE WHEN k % 11 = 0 THEN '(' ELSE ';' END)
  || CASE WHEN k % 13 = 0 THEN '\xFF\xFE'::BLOB ELSE ''::BLOB END AS content FROM c0),
d AS (SELECT 'Doc' || k AS name, 'c/' || base AS chunk, own AS raw, 'Doc' || (k % 97) || ' ' || lang AS deps, 'extra make' || (k % 3) AS exports, 'f go' || (k % 4) || ' run' || (k % 7) AS functions FROM c WHERE NOT skipped AND NOT failed
  UNION ALL SELECT 'Shared' || (k % 40), 'c/' || base, second, 'x' || (k % 3), '', '' FROM c WHERE NOT skipped AND NOT failed AND k % 4 = 0),
u AS (SELECT name, raw, any_value(deps) AS deps, any_value(exports) AS exports FROM d GROUP BY name, raw),
r AS (SELECT *, sha256(raw) AS sha, strlen(raw)::BIGINT AS len, row_number() OVER (PARTITION BY name ORDER BY strlen(raw) DESC, sha256(raw)) AS rank, count(*) OVER (PARTITION BY name) AS n FROM u)"""


def _zipped(batches):
    for pdf in batches:
        out = []
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            buf = io.BytesIO()
            with zipfile.ZipFile(buf, "w") as z:
                z.writestr(path, bytes(content))
            out.append(buf.getvalue())
        yield pd.DataFrame({"content": pd.Series(out, dtype="object")})


def _found(spark: SparkSession, folder: str) -> DataFrame:
    return archive.definitions(corpus.chunk_files(spark, folder))


@query(f"WITH {_CHUNKS} SELECT base AS path, sha256(content) AS sha256, octet_length(content)::BIGINT AS size, skipped FROM c")
def archive_members(spark, folder):
    zips = corpus.chunk_files(spark, folder).mapInPandas(_zipped, "content binary")
    return archive.members(zips).select("path", "sha256", "size", "skipped")


@query(f"WITH {_CHUNKS} SELECT name, chunk, deps, exports, functions, sha256(raw) AS raw_sha256, strlen(raw)::BIGINT AS raw_len, 'pretty' AS form FROM d")
def js_definitions(spark, folder):
    joined = [F.array_join(c, " ").alias(c) for c in ("deps", "exports", "functions")]
    return _found(spark, folder).where("name is not null").select("name", "chunk", *joined, "raw_sha256", "raw_len", "form")


@query(f"""WITH {_CHUNKS} SELECT 'Doc' || k AS name, '__d("Doc' || k || '",["Doc' || (k % 97) || '","' || lang || '"],(function(t,n,r,o,a,i){{' || chr(10) || '  function run' || (k % 7) || '(){{' || chr(10) || '    return "' || sha256(t) || '"' || chr(10) || '  }}' || chr(10)
|| '  var k=1' || chr(10) || '  function go' || (k % 4) || '(){{' || chr(10) || '  }}' || chr(10) || '  var f=()=>k' || chr(10) || '  i.make' || (k % 3) || '=run' || (k % 7) || ';' || chr(10) || '  a.exports.extra=2' || chr(10) || '}}),' || k || ')' || chr(10) AS text
FROM c JOIN x USING (k, lang) WHERE NOT skipped AND NOT failed""")
def js_printed_text(spark, folder):
    return _found(spark, folder).where("name like 'Doc%'").select("name", "text")


@query(f"WITH {_CHUNKS} SELECT name, raw AS text, strlen(raw)::BIGINT AS stored_len, 'raw' AS form FROM d WHERE name LIKE 'Shared%'")
def js_raw_text(spark, folder):
    return archive.definitions(corpus.chunk_files(spark, folder), pretty=False).where("name like 'Shared%'").select("name", "text", "stored_len", "form")


@query(f"WITH {_CHUNKS} SELECT 'c/' || base AS chunk, skipped, failed, CASE WHEN NOT skipped AND NOT failed AND k % 11 = 1 THEN 1 ELSE 0 END::INTEGER AS nameless FROM c")
def js_chunks(spark, folder):
    return _found(spark, folder).where("name is null").select("chunk", "skipped", "failed", "nameless")


@query(f"""WITH {_CHUNKS}, v AS (SELECT name, count(*) AS n, arg_min(sha, -len || '') AS x FROM r WHERE rank > 1 GROUP BY name), f AS (SELECT DISTINCT ON (name) name, name || '~alt-' || left(sha, 16) || '.js' AS variant_file FROM r WHERE rank = 2 ORDER BY name),
e AS (SELECT DISTINCT name AS src, unnest(string_split(deps, ' ')) AS dst FROM r WHERE rank = 1), b AS (SELECT dst AS name, count(*) AS n FROM e GROUP BY dst)
SELECT r.name, sha AS raw_sha256, r.name || '.js' AS file, coalesce(v.n, 0)::BIGINT AS n_variants, coalesce(b.n, 0)::BIGINT AS n_dependents, variant_file FROM r LEFT JOIN v USING (name) LEFT JOIN f USING (name) LEFT JOIN b USING (name) WHERE rank = 1""")
def ingest_records(spark, folder):
    records, _, _ = archive.ingest(_found(spark, folder))
    return records.select("name", "raw_sha256", "file", F.size("variants").cast("long").alias("n_variants"), F.size("dependents").cast("long").alias("n_dependents"), F.get("variants", F.lit(0)).file.alias("variant_file"))


@query(f"WITH {_CHUNKS} SELECT name, sha256(raw) AS sha256, max(strlen(raw))::BIGINT AS n FROM d GROUP BY ALL")
def ingest_sources(spark, folder):
    _, texts, _ = archive.ingest(archive.definitions(corpus.chunk_files(spark, folder), pretty=False))
    return texts.select("name", "sha256", F.octet_length("text").cast("long").alias("n"))


_COUNTERS = f"""WITH {_CHUNKS}, n AS (SELECT count(*) FILTER (WHERE NOT skipped) AS chunks_read, count(*) FILTER (WHERE skipped) AS chunks_skipped, count(*) FILTER (WHERE failed) AS chunk_parse_failures, count(*) FILTER (WHERE NOT skipped AND NOT failed AND k % 11 = 1) AS nameless_calls FROM c),
m AS (SELECT count(*) AS modules, count(*) FILTER (WHERE n > 1) AS modules_with_variants, sum(n - 1) AS variants FROM r WHERE rank = 1),
q AS (SELECT count(DISTINCT dst) AS unresolved_total FROM (SELECT unnest(string_split(deps, ' ')) AS dst FROM r WHERE rank = 1) WHERE dst NOT IN (SELECT name FROM r)) """


@query(_COUNTERS + "SELECT chunks_read::BIGINT AS chunks_read, chunks_skipped::BIGINT AS chunks_skipped, chunk_parse_failures::BIGINT AS chunk_parse_failures, nameless_calls::BIGINT AS nameless_calls, modules::BIGINT AS modules, modules_with_variants::BIGINT AS modules_with_variants, variants::BIGINT AS variants, unresolved_total::BIGINT AS unresolved_total, 0::BIGINT AS codegen_failures FROM n, m, q")
def ingest_diagnostics(spark, folder):
    _, _, told = archive.ingest(_found(spark, folder))
    return told.select("chunks_read", "chunks_skipped", "chunk_parse_failures", F.col("nameless_calls").cast("long").alias("nameless_calls"), "modules", "modules_with_variants", F.col("variants").cast("long").alias("variants"), "unresolved_total", "codegen_failures")


@query(_COUNTERS + "SELECT unnest(['chunks_read', 'modules', 'nameless_calls']) AS counter, unnest([chunks_read, modules, nameless_calls])::BIGINT AS n FROM n, m")
def ingest_counter_map(spark, folder):
    _, _, told = archive.ingest(_found(spark, folder))
    return counter_map(told.select("chunks_read", "modules", "nameless_calls")).select(F.explode("counters").alias("counter", "n"))


@query(f"WITH {_CHUNKS} SELECT name, n::BIGINT AS definitions FROM r WHERE rank = 1 AND n > 1")
def index_variant_counts(spark, folder):
    return index.variant_counts(index.distinct_definitions(_found(spark, folder).where("name is not null")))


@query(f"WITH {_CHUNKS} SELECT name FROM r WHERE rank = 1 AND n > 1")
def index_has_variants(spark, folder):
    return index.has_variants(archive.ingest(_found(spark, folder))[0]).select("name")


@query(f"WITH {_CHUNKS} SELECT name, '/' || name || '~alt-' || left(sha, 16) || '.js' AS file FROM r WHERE rank > 1")
def index_variant_files(spark, folder):
    records, _, _ = archive.ingest(_found(spark, folder))
    return records.select("name", F.explode("variants").alias("v")).select("name", F.concat(F.lit("/"), "v.file").alias("file"))


@query(f"WITH {_CHUNKS}, e AS (SELECT DISTINCT name AS src, unnest(string_split(deps, ' ')) AS dst FROM r WHERE rank = 1) SELECT dst, src FROM e WHERE dst IN (SELECT name FROM r)")
def index_dependent_edges(spark, folder):
    return index.dependent_edges(index.primaries(index.distinct_definitions(_found(spark, folder).where("name is not null"))))


# --- stored bundles --------------------------------------------------------------------------------


def _store(spark, folder) -> catalog.Store:
    """Three bundles of the two revisions, one of them written twice, and one removed again."""
    (old, old_text), (new, new_text) = corpus.revisions(spark, folder)
    store = catalog.Store(spark, f"{folder_of(spark)}/store-{uuid.uuid4().hex}")
    for name, records, texts in (("whatsapp-200", new, new_text), ("whatsapp-100", new, new_text), ("messenger-50", old, old_text), ("instagram-7", old, old_text)):
        store.add(name, records, texts, {"from": name})
    store.add("whatsapp-100", old, old_text, {"from": "again"}, force=True)
    store.remove("instagram-7")
    return store


@query("SELECT * FROM (VALUES ('whatsapp-100', 0, 100::BIGINT, 'again'), ('whatsapp-200', 0, 200::BIGINT, 'whatsapp-200'), ('messenger-50', 1, 50::BIGINT, 'messenger-50')) t(bundle, platform_ord, revision, source)")
def store_listing(spark, folder):
    rows = catalog.listed(_store(spark, folder).bundles().drop("bundle"))
    return rows.select("bundle", "platform_ord", "revision", F.get_json_object("manifest", "$.from").alias("source"))


@query("""SELECT * FROM (VALUES ('latest', 'whatsapp-200', true), ('msgr-latest', 'messenger-50', true), ('100', 'whatsapp-100', true), ('WA-100', 'whatsapp-100', true), ('messenger-50', 'messenger-50', true),
('instagram-7', NULL, false), ('ig-latest', NULL, false), ('300', NULL, false)) t(spec, bundle, stored)""")
def store_resolve(spark, folder):
    store = _store(spark, folder)

    def found(spec):
        try:
            return store.resolve(spec)
        except LookupError:
            return None

    names = [(s, found(s)) for s in ("latest", "msgr-latest", "100", "WA-100", "messenger-50", "instagram-7", "ig-latest", "300")]
    return spark.createDataFrame([(s, b, b is not None and store.has(b)) for s, b in names], "spec string, bundle string, stored boolean")


@query("""SELECT * FROM (VALUES ('', '', 'whatsapp-100', 'whatsapp-200'), ('100', '', 'whatsapp-100', 'whatsapp-200'), ('wa-latest', '100', 'whatsapp-200', 'whatsapp-100'), ('latest', 'msgr-latest', 'whatsapp-200', 'messenger-50')) t(a, b, old, new)""")
def store_operands(spark, folder):
    store = _store(spark, folder)
    asked = [("", ""), ("100", ""), ("wa-latest", "100"), ("latest", "msgr-latest")]
    return spark.createDataFrame([(a, b, *store.operands(a or None, b or None)) for a, b in asked], "a string, b string, old string, new string")


@query(f"WITH {_REV} SELECT name, sha AS raw_sha256, strlen(text)::BIGINT AS n FROM o")
def store_load(spark, folder):
    store = _store(spark, folder)
    texts = store.sources("whatsapp-100").select("name", F.col("sha256").alias("raw_sha256"), F.octet_length("text").cast("long").alias("n"))
    return store.modules("whatsapp-100").select("name", "raw_sha256").join(texts, ["name", "raw_sha256"])


@query(f"WITH {_BUNDLES} SELECT platform || '-' || revision AS bundle, 'https://archive.example/' || revision || '/' || platform AS url FROM b")
def archive_url(spark, folder):
    return catalog.archive_urls(_bundles(spark, folder), "https://archive.example/")


@query("SELECT strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS added_at, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def ingest_timestamps(spark, folder):
    return corpus.table(spark, folder, "events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("added_at")).groupBy("added_at").agg(F.count("*").alias("n"))


# --- filters -----------------------------------------------------------------------------------------

@query(f"WITH {_REV} SELECT dep, regexp_matches(dep, '^(la|das|el)$|(?i)^LE$') AS noise FROM (SELECT DISTINCT unnest(deps) AS dep FROM o)")
def filter_noise_dep(spark, folder):
    spec = NOTHING | {"noiseDeps": ["^(la|das|el)$", "(?i)^LE$"]}
    deps = _older(spark, folder)[0].select(F.explode("deps").alias("dep")).distinct()
    return deps.withColumn("noise", filters.is_noise_dep(F.col("dep"), spec))


@query("SELECT * FROM (VALUES ('all', 'keep', true), ('default', 'keep', true), ('protocol', 'drop', true), ('schemas', 'drop', true), ('wam', 'drop', true)) t(name, verdict, builtin)")
def filter_builtins(spark, folder):
    return spark.createDataFrame([(n, s["defaultVerdict"], bool(s["builtin"])) for n, s in sorted(filters.BUILTIN.items())], "name string, verdict string, builtin boolean")


@query(f"WITH {_REV} SELECT name, regexp_matches(name, '\\.fr\\.') AS keep FROM o")
def filter_patched(spark, folder):
    spec = filters.check(filters.patched(filters.blank("mine"), {"include": [r"\.fr\."], "defaultVerdict": "drop"}))
    return _older(spark, folder)[0].select("name", filters.verdict(F.col("name"), spec).alias("keep"))


# --- search ------------------------------------------------------------------------------------------


@query(f"WITH {_REV} SELECT name FROM o WHERE doc_id % 9 = 4")
def search_unreadable(spark, folder):
    records, sources = _older(spark, folder)
    return search.search(records, sources.where("not name rlike '[.][0-9]+$' or cast(substring_index(name, '.', -1) as bigint) % 9 <> 4"), source="e").unreadable


@query(f"WITH RECURSIVE {_SPREAD} SELECT name FROM a WHERE verdict = 'keep' AND (name LIKE 'order:1%' OR name LIKE 'customer:1%') ORDER BY name LIMIT 50")
def search_filter_propagation(spark, folder):
    records, _ = corpus.entity_graph(spark, folder)
    return search.search(records, name="^(order|customer):1", kept=filters.kept(records, SPREAD)).hits.select("name")


@query(f"WITH {_REV}, t AS (SELECT name, unnest(string_split(text, chr(10))[1:-2]) AS line FROM o) SELECT name, count(*)::INTEGER AS match_count FROM t WHERE regexp_matches(line, '^[A-Z].*\\.$') GROUP BY name ORDER BY name LIMIT 50")
def search_grep(spark, folder):
    return search.grep(*_older(spark, folder), r"^[A-Z].*\.$").hits.select("name", "match_count")


# --- diff --------------------------------------------------------------------------------------------

_EDITED = """l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents),
f AS (SELECT doc_id, i, i % 5 = doc_id % 5 AS gone, i % 5 <> doc_id % 5 AND i % 7 = doc_id % 7 AS changed, i % 11 = doc_id % 11 AS more FROM l),
z AS (SELECT doc_id, max(i) AS n, count(*) FILTER (WHERE NOT gone) + count(*) FILTER (WHERE more) AS m, count(*) FILTER (WHERE NOT gone AND NOT changed) AS same, max(i) FILTER (WHERE NOT gone OR more) AS last,
  max(i) FILTER (WHERE NOT gone AND NOT changed) AS last_same, max(i) FILTER (WHERE more) AS last_more FROM f GROUP BY doc_id),
e AS (SELECT doc_id, 'doc.' || doc_id AS name, n, m, same - CASE WHEN doc_id % 3 = 0 AND last_same = last AND coalesce(last_more, 0) < last THEN 1 ELSE 0 END AS same FROM z WHERE NOT (n = same AND m = n AND doc_id % 3 <> 0))"""


def _edits(spark, folder, **options):
    (old, old_text), (new, new_text) = corpus.edited(spark, folder)
    return diff.changes(old, new, old_text, new_text, NOTHING, **options)


@query(f"WITH {_EDITED} SELECT name, (m - same)::INTEGER AS lines_added, (n - same)::INTEGER AS lines_removed FROM e")
def diff_replaced_lines(spark, folder):
    return _edits(spark, folder).select("name", "lines_added", "lines_removed")


@query(f"WITH {_EDITED} SELECT name, round(2 * same / (n + m), 6) AS similarity FROM e")
def diff_edit_similarity(spark, folder):
    return _edits(spark, folder).select("name", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_EDITED} SELECT e.name, count(*) FILTER (WHERE gone OR changed)::BIGINT AS minus, count(*) FILTER (WHERE changed)::BIGINT + count(*) FILTER (WHERE more)::BIGINT AS plus FROM e JOIN f USING (doc_id) WHERE doc_id % 3 <> 0 GROUP BY e.name")
def diff_hunk_lines(spark, folder):
    """Every changed line stands in the hunks once; only texts that end in a line end have as many of them as lines."""
    marked = lambda p: F.regexp_count("hunks", F.lit(f"(?m)^[{p}]")).cast("long") - 1  # noqa: E731 less one for the header
    rows = _edits(spark, folder, max_hunk_bytes=1 << 30).where("cast(substring_index(name, '.', -1) as bigint) % 3 <> 0")
    return rows.select("name", marked("-").alias("minus"), marked("+").alias("plus"))


@query(f"WITH {_EDITED} SELECT name, n = same AND m = same AS noise_only FROM e")
def diff_noise_pattern(spark, folder):
    (old, old_text), (new, new_text) = corpus.edited(spark, folder)
    spec = NOTHING | {"noiseCode": ["^no such line$", "never(?i)this"]}
    return diff.changes(old, new, old_text, new_text, spec).select("name", "noise_only")


@query(f"WITH {_EDITED} SELECT name, true AS noise_only FROM e")
def diff_all_noise(spark, folder):
    (old, old_text), (new, new_text) = corpus.edited(spark, folder)
    spec = NOTHING | {"noiseCode": ["(?i)^NEW ", r"^\d+: "]}
    return diff.changes(old, new, old_text, new_text, spec).select("name", "noise_only")


@query(f"WITH {_REV} SELECT (SELECT count(*) FROM o)::BIGINT AS old_total, (SELECT count(*) FROM n)::BIGINT AS new_total, count(*) FILTER (WHERE kind <> 'added')::BIGINT AS old_kept, count(*) FILTER (WHERE kind <> 'removed')::BIGINT AS new_kept FROM k WHERE contains(name, '.en.')")
def diff_totals(spark, folder):
    (old, _), (new, _) = corpus.revisions(spark, folder)
    k = diff.kinds(old, new, NOTHING | {"include": [r"\.en\."], "defaultVerdict": "drop"})
    return diff.summary(k, old=old, new=new).select("old_total", "new_total", "old_kept", "new_kept")


@query(f"WITH {_REV}, c AS (SELECT count(*) AS n FROM k WHERE kind <> 'unchanged') SELECT n::BIGINT AS total, n > 25 AS truncated, least(n, 25)::BIGINT AS listed FROM c")
def diff_page(spark, folder):
    p = diff.page(diff.metadata(_kinds(spark, folder), NOTHING).withColumn("noise_only", F.lit(False)), limit=25)
    return spark.createDataFrame([(p.total, p.truncated, p.changes.count())], "total long, truncated boolean, listed long")


@query(f"WITH {_REV} SELECT split_part(name, '.', 2) AS key, kind, count(*)::BIGINT AS n, string_agg(name, ' ' ORDER BY name) AS names FROM k WHERE kind <> 'unchanged' GROUP BY ALL")
def diff_group_names(spark, folder):
    out = diff.grouped(diff.metadata(_kinds(spark, folder), NOTHING), F.split("name", r"\.")[1], names=True)
    return out.withColumn("names", F.array_join("names", " "))


# --- sinks -------------------------------------------------------------------------------------------


@query(f"""WITH {_REV} SELECT '{{"changes": [], "new": "b", "old": "a"}}' AS value UNION ALL SELECT '{{"name":"' || name || '","kind":"' || kind || '"}}' FROM k WHERE kind <> 'unchanged'""")
def render_ndjson(spark, folder):
    return render.ndjson(_kinds(spark, folder).where("kind <> 'unchanged'").select("name", "kind"), {"old": "a", "new": "b"})


def _nations(spark, folder):
    records, edges = corpus.entity_graph(spark, folder)
    return graph.graph(records, edges, pattern=r"^nation:", depth=1, max_nodes=None)


def _lines(spark, text: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(text.splitlines())), "line long, text string")


_NODES = f"{_ENT}, nodes AS (SELECT name, true AS present FROM v WHERE name LIKE 'nation:%' UNION SELECT dst, dst IN (SELECT name FROM v) FROM e WHERE src LIKE 'nation:%'), links AS (SELECT DISTINCT src, dst FROM e WHERE src LIKE 'nation:%')"


@query(f"""WITH {_NODES}, t AS (SELECT 0 AS a, '' AS b, '' AS c, 'digraph modules {{' AS text UNION ALL SELECT 1, '', '', '  rankdir=LR;' UNION ALL SELECT 2, name, '', '  "' || name || '"' || CASE WHEN present THEN '' ELSE ' [style=dashed]' END || ';' FROM nodes
UNION ALL SELECT 3, src, dst, '  "' || src || '" -> "' || dst || '";' FROM links UNION ALL SELECT 4, '', '', '}}') SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS line, text FROM t""")
def render_dot(spark, folder):
    return _lines(spark, graph.dot(_nations(spark, folder)))


@query(f"""WITH {_NODES}, i AS (SELECT name, 'n' || (row_number() OVER (ORDER BY name) - 1) AS id FROM nodes), t AS (SELECT 0 AS a, '' AS b, '' AS c, 'graph LR' AS text UNION ALL SELECT 1, name, '', '  ' || id || '["' || name || '"]' FROM i
UNION ALL SELECT 2, src, dst, '  ' || x.id || ' --> ' || y.id FROM links JOIN i x ON x.name = src JOIN i y ON y.name = dst) SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS line, text FROM t""")
def render_mermaid(spark, folder):
    return _lines(spark, graph.mermaid(_nations(spark, folder)))


@query(f"""WITH {_NODES}, t AS (SELECT 0 AS a, '' AS b, '' AS c, (SELECT count(*) FROM nodes) || ' nodes, ' || (SELECT count(*) FROM links) || ' edges' AS text UNION ALL SELECT 1 + CASE WHEN name LIKE 'nation:%' THEN 0 ELSE 1 END, name, '', CASE WHEN name LIKE 'nation:%' THEN '  0  ' ELSE '  1  ' END || name || CASE WHEN present THEN '' ELSE '  (not in the bundle)' END FROM nodes
UNION ALL SELECT 3, src, dst, '  ' || src || ' -> ' || dst FROM links) SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS line, text FROM t""")
def render_graph_text(spark, folder):
    return _lines(spark, render.graph_text(_nations(spark, folder)))


@query(f"WITH {_REV} SELECT row_number() OVER (ORDER BY o) - 1 AS line, k2 || '  ' || n AS text FROM (SELECT 0 AS o, 'added    ' AS k2, count(*) FILTER (WHERE kind = 'added') AS n FROM k UNION ALL SELECT 1, 'removed  ', count(*) FILTER (WHERE kind = 'removed') FROM k UNION ALL SELECT 2, 'modified ', count(*) FILTER (WHERE kind = 'modified') FROM k UNION ALL SELECT 3, 'unchanged', count(*) FILTER (WHERE kind = 'unchanged') FROM k)")
def render_counters(spark, folder):
    row = diff.summary(_kinds(spark, folder)).select("added", "removed", "modified", "unchanged").first().asDict()
    return _lines(spark, render.counters(row))


# --- graph -------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT doc_id AS a, doc_id - doc_id % 5 + (doc_id + 1) % 5 AS b FROM documents WHERE doc_id BETWEEN 0 AND 9)
SELECT string_agg('doc:' || i, ' -> ' ORDER BY i) || ' -> doc:' || min(i) AS ring FROM (SELECT a AS i, a // 5 AS g FROM e) GROUP BY g HAVING count(*) = 5""")
def graph_rings(spark, folder):
    records, edges = corpus.rings(spark, folder)
    g = graph.graph(records, edges, pattern="^doc:[0-9]$", depth=5, detect_cycles=True)
    return spark.createDataFrame([(" -> ".join(c),) for c in g.cycles], "ring string")


_CAP = f"""{_ENT}, r0 AS (SELECT name FROM v WHERE regexp_matches(name, '^customer:\\d*5$')), s AS (SELECT name, 0 AS depth FROM r0),
c AS (SELECT dst AS name, min(r0.name) AS place FROM e JOIN r0 ON r0.name = e.src WHERE dst NOT IN (SELECT name FROM r0) GROUP BY dst), a AS (SELECT name FROM c ORDER BY place, name LIMIT 3)"""


@query(f"WITH {_CAP} SELECT src, dst FROM (SELECT DISTINCT src, dst FROM e JOIN r0 ON r0.name = e.src) WHERE dst IN (SELECT name FROM a UNION SELECT name FROM r0)")
def graph_capped_edges(spark, folder):
    records, edges = corpus.entity_graph(spark, folder)
    roots = cut(graph.roots_of(records, pattern=r"^customer:\d*5$"))
    return graph.neighbourhood(records, edges, roots, depth=1, max_nodes=roots.count() + 3).edges


@query(f"WITH {_ENT} SELECT name, name LIKE 'nation:%' AS in_filter FROM (SELECT name FROM v WHERE name LIKE 'nation:1%' UNION SELECT dst FROM e WHERE src LIKE 'nation:1%')")
def graph_in_filter(spark, folder):
    records, edges = corpus.entity_graph(spark, folder)
    spec = NOTHING | {"include": ["^nation:"], "defaultVerdict": "drop"}
    return graph.graph(records, edges, pattern="^nation:1", spec=spec).nodes.select("name", "in_filter")
