"""The registered queries of this subpackage, each over its whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bm25, bpe, chat, decontam, langid, linededup, neardup, substrings, toxicity, warc


def tokenizer() -> tuple[str, str]:
    """Where the public rank file lies, and the pattern that goes with it."""
    import public_tokenizers as p

    return p.path("byte_bpe_50k.tiktoken"), p.PATTERN


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as p

    rows = chat.with_probe(_read(spark, sf_dir, "conversations"))
    return chat.digests(chat.render_conversations(rows, p.path("byte_bpe_50k.json"))).drop("n_tokens", "loss_tokens")


def op2_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    hits = bm25.search(docs, docs.where("doc_id % 20 = 0"))
    return hits.withColumn("score", F.round("score", 4))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup(_read(spark, sf_dir, "documents"), texts=False)
    return out.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in ("removed", "first_docs")})


def op4_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_read(spark, sf_dir, "documents"), *tokenizer())


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(_read(spark, sf_dir, "documents"), texts=False)


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_bm25_topk, op3_line_dedup, op4_minhash_neardup, op5_toxicity, op6_warc, op7_byte_bpe, op8_language_id, op9_benchmark_decontamination, op10_substring_dedup)}

ORACLES = {
    "op10_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM g) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM later),
one AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w)
SELECT w.doc_id, len(any_value(w.ws))::BIGINT AS n_words, count(g.i)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(o.word, ' ' ORDER BY o.i) FILTER (WHERE g.i IS NULL), '')) AS kept_sha256
FROM w LEFT JOIN one o USING (doc_id) LEFT JOIN gone g ON g.doc_id = o.doc_id AND g.i = o.i
GROUP BY w.doc_id""",
}
ORACLES["op9_benchmark_decontamination"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, s AS t, array_to_string(ws[s:s + n - 1], ' ') AS k FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS s FROM b WHERE len(ws) > 0)),
g AS (SELECT doc_id, s, n, array_to_string(ws[s:s + n - 1], ' ') AS k FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM w, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
m AS (SELECT doc_id, s, n, item_id, t FROM g JOIN bw USING (n, k)),
hit AS (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS i FROM m),
h AS (SELECT doc_id, count(*) AS n_hit FROM hit GROUP BY doc_id),
one AS (SELECT doc_id, item_id, n, s - t AS d, s - row_number() OVER (PARTITION BY doc_id, item_id, n, s - t ORDER BY s) AS run FROM (SELECT DISTINCT * FROM m)),
l AS (SELECT doc_id, max(k) AS longest FROM (SELECT doc_id, count(*) + n - 1 AS k FROM one GROUP BY doc_id, item_id, n, d, run) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS xs FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY doc_id)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(xs, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest, 0)::BIGINT AS longest_match
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN it USING (doc_id)"""

ORACLES["op6_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, true AS complete FROM f"""

ORACLES["op1_chat_format"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(regexp_replace(role, '<(\\*)(turn>|text>|/turn>|\|endoftext\|>)', '<\\\1\2', 'g')) + length(regexp_replace(text, '<(\\*)(turn>|text>|/turn>|\|endoftext\|>)', '<\\\1\2', 'g')) + 20 AS n FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""

ORACLES["op3_line_dedup"] = r"""
WITH l AS (SELECT doc_id, i - 1 AS number, ls[i] AS t FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
o AS (SELECT * FROM l WHERE regexp_matches(t, '[^\x20\x09-\x0D]')),
d AS (SELECT t, length(t) AS n, min({'d': doc_id, 'i': number}) AS first FROM o GROUP BY t),
p AS (SELECT a.t AS t, b.first AS theirs FROM d a JOIN d b ON b.n BETWEEN a.n - 2 AND a.n + 2 AND a.n >= 40 AND b.n >= 40 AND a.t <> b.t
      AND (left(a.t, 13) = left(b.t, 13) OR right(a.t, 13) = right(b.t, 13) OR substr(a.t, a.n // 3 + 1, a.n // 3) IN (substr(b.t, a.n // 3 - 1, a.n // 3), substr(b.t, a.n // 3, a.n // 3), substr(b.t, a.n // 3 + 1, a.n // 3), substr(b.t, a.n // 3 + 2, a.n // 3), substr(b.t, a.n // 3 + 3, a.n // 3)))
      AND levenshtein(a.t, b.t) <= 2),
e AS (SELECT d.t, least(any_value(d.first), min(coalesce(p.theirs, d.first))) AS first, count(p.theirs) AS links FROM d LEFT JOIN p USING (t) GROUP BY d.t),
m AS (SELECT doc_id, sum(links) AS n_links, list(number ORDER BY number) FILTER (WHERE {'d': doc_id, 'i': number} > first) AS removed,
        list(first.d ORDER BY number) FILTER (WHERE {'d': doc_id, 'i': number} > first) AS firsts FROM o JOIN e USING (t) GROUP BY doc_id)
SELECT x.doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines, coalesce(len(removed), 0)::BIGINT AS n_removed,
       coalesce(n_links, 0)::BIGINT AS n_links, array_to_string(coalesce(removed, []), ',') AS removed, array_to_string(coalesce(firsts, []), ',') AS first_docs,
       sha256(array_to_string(list_filter(string_split(text, chr(10)), lambda t, i: NOT list_contains(coalesce(removed, []), i - 1)), chr(10))) AS kept_sha256
FROM documents x LEFT JOIN m USING (doc_id)"""

ORACLES["op2_bm25_topk"] = r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t FROM documents),
tf AS (SELECT doc_id, t, count(*) AS n FROM w GROUP BY ALL),
len AS (SELECT doc_id, sum(n) AS l FROM tf GROUP BY doc_id),
c AS (SELECT (SELECT count(*) FROM documents) AS docs, (SELECT sum(l) FROM len) / (SELECT count(*) FROM documents) AS avg),
idf AS (SELECT t, ln(1 + (docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, c GROUP BY t, docs),
s AS (SELECT q.doc_id AS query_id, d.doc_id, sum(q.n * idf * d.n * 2.2 / (d.n + 1.2 * (0.25 + 0.75 * l / avg))) AS score
      FROM tf q JOIN tf d USING (t) JOIN idf USING (t) JOIN len ON len.doc_id = d.doc_id, c WHERE q.doc_id % 20 = 0 GROUP BY q.doc_id, d.doc_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INTEGER AS rank, doc_id, round(score, 4) AS score FROM s)
SELECT * FROM r WHERE rank <= 10"""
