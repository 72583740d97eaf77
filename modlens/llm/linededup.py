"""Line deduplication by a segment-partition edit join.

Two lines of at least MIN_CHARS characters are linked if at most EDITS insertions, deletions
and replacements turn one into the other.  A line is cut into EDITS + 1 segments; as EDITS
edits cannot touch them all, a linked line of the same length or longer holds one of them as
it is, and only at the few places that its length allows.  The segments are the index, the
substrings at those places the probes, keyed by length, segment number and text.

A key that more than HOT lines share (a template with changing numbers, say) gives no pairs: its lines go
to a second round, cut into FINE segments.  As EDITS edits touch EDITS segments at most, each
line is paired through its EDITS + 1 rarest ones only, which are those that tell lines of one
template apart.

Keys travel as packed rows, one for each shard of documents and key range, with the line's
64-bit hash and the parity of its letter counts (which EDITS edits can change in at most
2 * EDITS places); lines that stand often in a shard are sent once.  Candidates are verified
by bit-parallel edit distance within the band of EDITS diagonals.

A line goes if an equal or linked line stands earlier: in a document of smaller doc_id, or
higher up in the same one.  Blank lines always stay, shorter lines go only as copies.  All of
this is judged on the input, not on what is left.

Defined results: lines are parted by \\n; null text has no lines and stays null; rows of equal
doc_id stand at the same place, none earlier; a null doc_id comes after all others; different
lines share a 64-bit hash with a chance of N*N / 2**65 among N; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import filters, textops as T
from .substrings import pack_sorted, planes, unpack_sorted, unplanes
from .work import Work

EDITS, MIN_CHARS = 2, 40
SHARD_BYTES = 3 << 20
RANGE_KEYS = 4_000_000
HOT, FINE = 200, 12
LAST = (1 << 63) - 1
_U = np.uint64


def _lines(texts: list[str]):
    """(codes, start, end, text number, line number) of every line."""
    raw = "\n".join(texts).encode("utf-32-le", "replace")
    codes = np.frombuffer(raw, np.uint32)
    stop = np.append(np.flatnonzero(codes == 10), len(codes))
    start = np.concatenate(([0], stop[:-1] + 1))
    per = np.fromiter((t.count("\n") + 1 for t in texts), np.int64, len(texts))
    of = np.repeat(np.arange(len(texts)), per)
    number = np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)
    return codes, start, stop, of, number


class _Hashes:
    """Hashes of any substrings, from sums over prefixes."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.sums = np.concatenate((np.zeros(1, _U), np.cumsum((codes.astype(_U) + _U(1)) * T._pow("b", T._B, max(n, 1))[:n])))
        self.back = T._pow("i", T._BINV, n + 1)

    def of(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return T.mix((self.sums[e] - self.sums[s]) * self.back[s] + (e - s).astype(_U) * _U(0xD6E8FEB86659FD93))


def _blank(codes, start, stop) -> np.ndarray:
    ink = np.concatenate(([0], np.cumsum((codes != 32) & ((codes < 9) | (codes > 13)))))
    return ink[stop] == ink[start]


def segments(length: np.ndarray, edits: int):
    """(begin, size) of each of the edits + 1 segments of lines of these lengths."""
    k, out, at = edits + 1, [], np.zeros_like(length)
    for i in range(k):
        size = length // k + (i >= k - length % k)
        out.append((at, size))
        at = at + size
    return out


def places(i: int, delta: int, edits: int):
    """Where segment i (from 0) of a line can stand in one that is delta longer, from its own place."""
    return range(max(-i, delta - (edits - i)), min(i, delta + (edits - i)) + 1)


def keys(h: _Hashes, start: np.ndarray, stop: np.ndarray, edits: int):
    """For each kind of entry (keys, lines, kind): 1 is index, 2 probe, 3 both."""
    length = stop - start
    every = np.arange(len(start))
    for delta in range(edits + 1):
        other = length - delta
        ok = other >= edits + 1
        for i, (at, size) in enumerate(segments(other, edits)):
            for shift in places(i, delta, edits):
                b = at + shift
                good = ok & (b >= 0) & (b + size <= length)
                s = start[good] + b[good]
                salt = other[good].astype(_U) * _U(0xA24BAED4963EE407) + _U((i + 1) * 0x9FB21C651E98DF25 & T._MASK)
                yield T.mix(h.of(s, s + size[good]) + salt), every[good], 3 if delta == 0 and shift == 0 else 2


EXCHANGE = "p int, keys binary, same binary, lines binary, parity binary, kind binary"


def _entries(edits: int, least: int, n_ranges: int, bits: int):
    edges = np.array([-(-(i << bits) // n_ranges) for i in range(n_ranges)], dtype=np.uint64)
    types = [pa.int32()] + [pa.binary()] * 5

    def run(batches):
        for b in T.slices(batches, SHARD_BYTES):
            codes, start, stop, *_ = _lines([t or "" for t in b.column("text").to_pylist()])
            h = _Hashes(codes)
            long_ = (stop - start >= least) & ~_blank(codes, start, stop)
            start, stop = start[long_], stop[long_]
            line, first = np.unique(h.of(start, stop), return_index=True)
            start, stop = start[first], stop[first]
            flips = np.concatenate((np.zeros(1, np.uint32), np.bitwise_xor.accumulate(np.uint32(1) << (codes & 31))))
            parity = flips[stop] ^ flips[start]
            got = list(keys(h, start, stop, edits))
            key = np.concatenate([k for k, *_ in got]) >> _U(64 - bits)
            own = np.concatenate([i for _, i, _ in got])
            kind = np.concatenate([np.full(len(k), c, np.uint8) for k, _, c in got])
            order = np.argsort(key, kind="stable")
            key, own, kind = key[order], own[order], kind[order]
            cut = np.append(np.searchsorted(key, edges), len(key))
            rows = []
            for p in range(n_ranges):
                i, j = int(cut[p]), int(cut[p + 1])
                if i < j:
                    k, n = np.unique(key[i:j] - edges[p], return_counts=True)
                    rows.append((p, pack_sorted(k), np.minimum(n, 255).astype(np.uint8).tobytes() if n.max() < 255 else n.astype("<u4").tobytes(), planes(line[own[i:j]]), planes(parity[own[i:j]]), kind[i:j].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in EXCHANGE.split(", ")])

    return run


def _candidates(edits: int, hot: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """One key range: an indexed and a probing line of one key, unless their letters differ too much.  The
        lines of a key with more than `hot` entries come out alone, with no b."""
        ks, lines, par, kinds = [], [], [], []
        for r in table.to_pylist():
            k = unpack_sorted(r["keys"])
            n = np.frombuffer(r["same"], np.uint8 if len(r["same"]) == len(k) else "<u4")
            ks.append(np.repeat(k, n))
            lines.append(unplanes(r["lines"], _U))
            par.append(unplanes(r["parity"], np.uint32))
            kinds.append(np.frombuffer(r["kind"], np.uint8))
        k, line, parity, kind = (np.concatenate(x) for x in (ks, lines, par, kinds))
        order = np.lexsort((kind, line, k))
        k, line, parity, kind = k[order], line[order], parity[order], kind[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (line[1:] != line[:-1]) | (kind[1:] != kind[:-1])
        k, line, parity, kind = k[new], line[new], parity[new], kind[new]
        _, of, size = np.unique(k, return_inverse=True, return_counts=True)
        many = size[of] > hot
        alone = np.unique(line[many]).view(np.int64)
        k, line, parity, kind = (x[~many] for x in (k, line, parity, kind))
        a, b = [], []
        at, d = np.arange(len(k)), 1
        while len(at):
            at = at[at + d < len(k)]
            at = at[k[at] == k[at + d]]  # the pairs of places d apart within one key
            to = at + d
            ok = (line[at] != line[to]) & (np.bitwise_count(parity[at] ^ parity[to]) <= 2 * edits) & (((kind[at] & 1) & (kind[to] >> 1)) | ((kind[to] & 1) & (kind[at] >> 1))).astype(bool)
            a.append(line[at[ok]])
            b.append(line[to[ok]])
            d += 1
        a, b = (np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (a, b))
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        right = pa.array(np.append(pair[:, 1], alone), pa.int64(), mask=np.arange(len(pair) + len(alone)) >= len(pair))
        return pa.table({"a": pa.array(np.append(pair[:, 0], alone), pa.int64()), "b": right})

    return run


ENTRY = "key long, line long, parity int, indexed boolean"


def _fine(edits: int, parts: int):
    """Index and probe entries of lines cut into `parts` segments: a probe's segment stands where the edits before
    and behind it, edits together, can have moved it."""

    def run(batches):
        for b in T.slices(batches, SHARD_BYTES):
            codes, start, stop, *_ = _lines(b.column("text").to_pylist())
            h, length, own = _Hashes(codes), stop - start, b.column("line").to_numpy()
            flips = np.concatenate((np.zeros(1, np.uint32), np.bitwise_xor.accumulate(np.uint32(1) << (codes & 31))))
            parity = (flips[stop] ^ flips[start]).view(np.int32)
            for delta in range(edits + 1):
                other = length - delta
                for i, (at, size) in enumerate(segments(other, parts - 1)):
                    for shift in range(-((edits - delta) // 2), (edits + delta) // 2 + 1):
                        begin = at + shift
                        ok = (begin >= 0) & (begin + size <= length)
                        s = start[ok] + begin[ok]
                        salt = other[ok].astype(_U) * _U(0xA24BAED4963EE407) + _U((i + 1) * 0x9FB21C651E98DF25 & T._MASK)
                        key = T.mix(h.of(s, s + size[ok]) + salt).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own[ok]), pa.array(parity[ok]), pa.array(np.full(len(key), delta == 0 and shift == 0))], [x.split()[0] for x in ENTRY.split(", ")])

    return run


def _second_round(lines: DataFrame, work: Work, edits: int, least: int) -> DataFrame:
    """Pairs among lines (line, text) of hot keys: each through the edits + 1 of its segments that fewest lines hold."""
    parts = max(edits + 1, min(FINE, (least - edits) // 3))
    entries = work.table(lines.transform(T.mapped, _fine(edits, parts), ENTRY).distinct(), "entries")
    held = entries.groupBy("key").agg(F.count("*").alias("held"))
    rare = Window.partitionBy("line").orderBy("held", "key")
    chosen = entries.where("indexed").join(held, "key").withColumn("r", F.row_number().over(rare)).where(F.col("r") <= edits + 1)
    a, b = chosen.select("key", F.col("line").alias("a"), F.col("parity").alias("pa")), entries.select("key", F.col("line").alias("b"), F.col("parity").alias("pb"))
    near = a.join(b, "key").where((F.col("a") != F.col("b")) & (F.bit_count(F.col("pa").bitwiseXOR(F.col("pb"))) <= 2 * edits))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


LINES = "line long, doc_id long, th long, number int, text string"


def _occurrences(sent):
    """Every line that is not blank; its text too where the filter may hold it (once in a shard)."""

    def run(batches):
        bits = np.frombuffer(sent.value, np.uint8)
        for b in T.slices(batches, SHARD_BYTES):
            texts = b.column("text").to_pylist()
            some = [i for i, t in enumerate(texts) if t is not None]
            codes, start, stop, of, number = _lines([texts[i] for i in some])
            ok = ~_blank(codes, start, stop)
            start, stop, of, number = start[ok], stop[ok], np.array(some, np.int64)[of[ok]], number[ok]
            line = _Hashes(codes).of(start, stop).view(np.int64)
            first = np.zeros(len(line), bool)
            first[np.unique(line, return_index=True)[1]] = True
            ask = first & filters.holds(bits, line)
            raw = codes.tobytes()
            spelt = [raw[4 * s : 4 * e].decode("utf-32-le") if k else None for s, e, k in zip(start.tolist(), stop.tolist(), ask.tolist(), strict=True)]
            ids, th = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("th").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(line), pa.array(ids[of]), pa.array(th[of]), pa.array(number, pa.int32()), pa.array(spelt, pa.string())], [x.split()[0] for x in LINES.split(", ")])

    return run


def distance(a: str, b: str, most: int) -> int:
    """Edit distance, or most + 1 if it is more: Myers' bit vectors, matches taken only within the band."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    n, i = min(len(a), len(b)), 0
    while i < n and a[i : i + 64] == b[i : i + 64]:
        i += 64
    i = min(i, n)
    while i < n and a[i] == b[i]:
        i += 1
    a, b, n, j = a[i:], b[i:], n - i, 0
    while j < n and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[: len(a) - j], b[: len(b) - j]
    if not a or not b:
        return min(max(len(a), len(b)), most + 1)
    where: dict = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full, high, band = (1 << len(a)) - 1, 1 << len(a) - 1, (1 << 2 * most + 1) - 1
    up, down, out = full, 0, len(a)
    for k, c in enumerate(b):
        eq = where.get(c, 0) & (band << k - most if k >= most else band >> most - k)
        xv = eq | down
        xh = ((eq & up) + up ^ up) | eq
        ph, mh = (down | ~(xh | up)) & full, up & xh
        out += bool(ph & high) - bool(mh & high)
        ph, mh = (ph << 1 | 1) & full, mh << 1 & full
        up, down = (mh | ~(xv | ph)) & full, ph & xv
    return min(out, most + 1)


def _verified(edits: int):
    def run(batches):
        for b in batches:
            d = np.array([distance(x, y, edits) for x, y in zip(b.column("text_a").to_pylist(), b.column("text_b").to_pylist(), strict=True)], np.int32)
            out = pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(d, pa.int32())], ["a", "b", "edits"])
            yield out.filter(pa.array((d > 0) & (d <= edits)))

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), F.xxhash64("text").alias("th"), "text")


def links(docs: DataFrame, work: Work, edits: int = EDITS, least: int = MIN_CHARS, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(line occurrences, verified links between different lines: a, b, edits)."""
    if least < 2 * edits + 2:
        raise ValueError("lines must be long enough to have edits + 1 segments after edits deletions")
    spark = docs.sparkSession
    T.small_batches(spark, 4)
    rows = _keyed(docs)
    size = int(docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0)
    n_keys = max(1, size // least * (edits + 1) * (edits + 2))
    n_ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_keys // (8 * RANGE_KEYS)))
    bits = min(56, max(36, n_keys.bit_length() + 10))
    found = rows.transform(T.mapped, _entries(edits, least, n_ranges, bits), EXCHANGE).groupBy("p").applyInArrow(_candidates(edits, hot), "a long, b long")
    found = work.table(found.distinct(), "candidates")
    pairs = found.where("b is not null")
    alone = found.where("b is null").select(F.col("a").alias("line"))
    ends = found.select(F.col("a").alias("line")).unionByName(pairs.select(F.col("b").alias("line"))).distinct()
    sent = spark.sparkContext.broadcast(filters.of(ends, "line", hashed=True))
    lines = work.table(rows.transform(T.mapped, _occurrences(sent), LINES), "lines")
    texts = lines.where("text is not null").select("line", "text").join(ends, "line", "left_semi").dropDuplicates(["line"])
    if not alone.isEmpty():
        texts = work.table(texts, "texts")
        more = _second_round(texts.join(alone, "line", "left_semi"), work, edits, least)
        pairs = work.table(pairs.unionByName(more).distinct(), "all_candidates")
    both = pairs.join(texts.select(F.col("line").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("line").alias("b"), F.col("text").alias("text_b")), "b")
    return lines, work.table(both.select("a", "b", "text_a", "text_b").transform(T.mapped, _verified(edits), "a long, b long, edits int"), "links")


def marks(docs: DataFrame, edits: int = EDITS, least: int = MIN_CHARS, work: Work | None = None) -> DataFrame:
    """(doc_id, th, n_links, removed) of each document with a link or a line to remove; removed is an array of
    (number, first_doc) in order, first_doc the document in which the earliest such line stands."""
    work = work or Work(docs.sparkSession, "lines")
    lines, found = links(docs, work, edits, least)
    place = F.struct("doc_id", "number")
    first = lines.groupBy("line").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    sides = found.select(F.col("a").alias("line"), F.col("b").alias("other")).unionByName(found.select(F.col("b").alias("line"), F.col("a").alias("other")))
    near = sides.join(first.select(F.col("line").alias("other"), F.col("first").alias("theirs")), "other").groupBy("line").agg(F.min("theirs").alias("theirs"), F.count("*").alias("links"))
    known = first.join(near, "line", "left").where("n > 1 or links is not null").select("line", F.least("first", F.coalesce("theirs", "first")).alias("first"), F.coalesce("links", F.lit(0)).alias("links"))
    told = lines.select("line", "doc_id", "th", "number").join(known, "line").withColumn("late", place > F.col("first"))
    per = told.groupBy("doc_id", "th").agg(
        F.sum("links").alias("n_links"),
        F.array_sort(F.collect_set(F.when(F.col("late"), F.struct("number", F.col("first.doc_id").alias("first_doc"))))).alias("removed"),
    )
    return work.table(per, "marks")


KEPT = "doc_id long, th long, n_lines long, kept_sha256 string, kept string, text string"
DONE = "doc_id long, n_lines long, n_removed long, n_links long, removed array<int>, first_docs array<long>, kept_sha256 string, kept string"


def _split(sent, texts: bool):
    def run(batches):
        bits = np.frombuffer(sent.value, np.uint8)
        for b in batches:
            ask = filters.holds(bits, b.column("th").to_numpy(zero_copy_only=False)).tolist()
            n, sha, kept, text = [], [], [], []
            for t, k in zip(b.column("text").to_pylist(), ask, strict=True):
                n.append(None if k else 0 if t is None else t.count("\n") + 1)
                sha.append(None if k or t is None else hashlib.sha256(t.encode()).hexdigest())
                kept.append(t if texts and not k else None)
                text.append(t if k else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string()), pa.array(text, pa.string())], [x.split()[0] for x in KEPT.split(", ")])

    return run


def _cut(texts: bool):
    def run(batches):
        types = [pa.int64()] * 4 + [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.string(), pa.string()]
        for b in batches:
            rows = []
            for r in b.to_pylist():
                gone = r["removed"] or []
                n, sha, kept = r["n_lines"], r["kept_sha256"], r["kept"]
                if r["text"] is not None:
                    own = r["text"].split("\n")
                    out = {x["number"] for x in gone}
                    kept = "\n".join(x for i, x in enumerate(own) if i not in out)
                    n, sha = len(own), hashlib.sha256(kept.encode()).hexdigest()
                rows.append((r["doc_id"], n or 0, len(gone), r["n_links"] or 0, [x["number"] for x in gone], [x["first_doc"] for x in gone], sha, kept if texts else None))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in DONE.split(", ")])

    return run


def dedup(docs: DataFrame, edits: int = EDITS, least: int = MIN_CHARS, texts: bool = True) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, n_links (links of its lines to other lines), removed (line
    numbers from 0), first_docs (where each removed line stands first), kept_sha256 and with texts kept."""
    T.small_batches(docs.sparkSession, 4)
    told = marks(docs, edits, least)
    sent = docs.sparkSession.sparkContext.broadcast(filters.of(told, "th", hashed=True))
    out = _keyed(docs).transform(T.mapped, _split(sent, texts), KEPT).join(told, ["doc_id", "th"], "left").drop("th").transform(T.mapped, _cut(texts), DONE)
    out = out.withColumn("doc_id", F.nullif("doc_id", F.lit(LAST))).withColumn("first_docs", F.transform("first_docs", lambda x: F.nullif(x, F.lit(LAST))))
    return out if texts else out.drop("kept")


def clean(docs: DataFrame, edits: int = EDITS, least: int = MIN_CHARS) -> DataFrame:
    """All columns, text without the removed lines; a document of which nothing but blank lines is left goes."""
    told = marks(docs, edits, least).select("doc_id", "th", F.col("removed.number").alias("_gone")).where("size(_gone) > 0")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # other columns travel inside, whatever their names
    keyed = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("_id"), F.xxhash64("text").alias("_th"), F.col("text").alias("_text"), row.alias("_row"))
    joined = keyed.join(told.withColumnsRenamed({"doc_id": "_id", "th": "_th"}), ["_id", "_th"], "left")
    kept = F.array_join(F.filter(F.split("_text", "\n", -1), lambda x, i: ~F.array_contains(F.coalesce("_gone", F.array().cast("array<int>")), i)), "\n")
    out = joined.withColumn("_kept", F.when(F.col("_gone").isNotNull(), kept)).where("_gone is null or trim(translate(_kept, '\\t\\n\\u000b\\f\\r', '')) <> ''")
    return out.select(*[F.coalesce("_kept", "_text").alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
