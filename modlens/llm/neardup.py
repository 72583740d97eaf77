"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A text is the sequence of its word SHINGLEs (words of letters and digits, A-Z folded).
Equal shingles are told apart by a running number.  For each of SKETCHES hash functions the
PICKS smallest shingles are taken in the order in which they stand in the text; texts that
agree in one such sketch are candidates.  Of a pair of texts the longest common subsequence
of m shingles, found in a band that is as wide as the threshold allows, gives the similarity
m / (n_a + n_b - m): the Jaccard index of the shingles, but for those out of order.  Pairs of
THRESHOLD or more are links; classes are the connected components.

Copies of one word sequence are one node throughout.  The first pass goes over each bucket once and
verifies every node with its likeliest leader (leaders are those not almost equal to an earlier
one, FEW at most), which puts a group of thousands of near copies into one class or a few, with a pair or so
for each of them.  It only saves work.  What is right is settled by the rounds after it: all nodes
of every bucket that holds more than one class are compared, whether leaders or not, by estimated
similarity, length and a bound from bitmaps of their shingles, and pairs of different classes that
may be alike are verified; links make classes, and the next round goes over what is left.
The first rounds take the likeliest pairs of each node and of each two classes, the last takes all,
so that in the end no candidate pair of two classes is unverified.

A bucket of more than LEADERS nodes is dealt out again into finer buckets, one for each minimum.  A
candidate pair has LEAST minima in common, so it meets in one of them; nothing is cut off.

Defined results: texts without words are copies only of equal texts; a text of less than
SHINGLE words is one shingle; a class's id is the smallest doc_id in it (null only if all are);
repeated rows are in one class; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import filters, textops as T
from .components import components
from .work import Work

SHINGLE, THRESHOLD = 5, 0.8
SKETCHES, PICKS = 16, 3
FEW, LEADERS, ALMOST, LEAST = 64, 8192, 14, 5
BITS, BUFFER = 2048, 4096
LAST = (1 << 63) - 1  # stands for a null doc_id, behind all others
_U = np.uint64
_TOP = _U((1 << 64) - 1)
_rng = np.random.default_rng(20)
_ODD = _rng.integers(0, 1 << 63, SKETCHES, dtype=np.uint64) * _U(2) + _U(1)
SKETCH = "doc_id long, node binary, n int, buckets array<long>, sig binary, bits binary"


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE):
    """(hashes, first) of the shingles of each text, in order, and the words' hashes with theirs."""
    _, _, h, of = T.words(data, offsets)
    texts = len(offsets) - 1
    first = np.searchsorted(of, np.arange(texts + 1))
    n = np.diff(first)
    w = T.windows(h, size)
    ok = of[: len(w)] == of[size - 1 :][: len(w)]
    full, owner = w[ok], of[: len(w)][ok]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):  # the whole text is one shingle
        ends = [T.mix(np.array([hash_of(h[first[i] : first[i + 1]])], _U))[0] for i in short]
        full, owner = np.concatenate([full, np.array(ends, _U)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        full, owner = full[order], owner[order]
    return full, np.searchsorted(owner, np.arange(texts + 1)), h, first


def hash_of(words: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(words.tobytes(), digest_size=8).digest(), "little")


def name_of(words: np.ndarray, raw: bytes) -> bytes:
    """A text's node: its word sequence, or without words its bytes."""
    return hashlib.blake2b(words.tobytes() if len(words) else raw, digest_size=16, person=b"words" if len(words) else b"bytes").digest()


def labelled(s: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Each shingle with its running number among the equal ones of its text."""
    order = np.lexsort((s, owner))
    a, b = s[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    begin = np.flatnonzero(new)[np.cumsum(new) - 1] if len(s) else order
    number = np.empty(len(s), np.int64)
    number[order] = np.arange(len(s)) - begin
    return T.mix(s + number.astype(_U) * _U(0x9E3779B97F4A7C15))


def sketches(s: np.ndarray, first: np.ndarray):
    """(texts that have shingles, bucket of each sketch, low bits of each minimum, bitmap of the shingles)."""
    lens = np.diff(first)
    own = np.flatnonzero(lens)
    starts, lens = first[own], lens[own]
    lab = labelled(s, np.repeat(own, lens))
    buckets, sig = np.empty((len(own), SKETCHES), _U), np.empty((len(own), SKETCHES), np.uint16)
    row = np.repeat(np.arange(len(own)), lens)
    for t in range(SKETCHES):
        v = lab * _ODD[t]
        picked = np.full((len(own), PICKS), len(s), np.int64)
        for j in range(PICKS):
            low = np.minimum.reduceat(v, starts)
            if j == 0:
                sig[:, t] = (T.mix(low) & _U(0xFFFF)).astype(np.uint16)
            at = np.flatnonzero(v == low[row])
            at = at[lens[row[at]] > j]
            picked[row[at], j] = at
            v[at] = _TOP
        picked.sort(axis=1)  # the order of the text
        key = np.full(len(own), t + 1, _U)
        padded = np.append(lab, _U(0))
        for j in range(PICKS):
            key = T.mix(key * _U(T._B) + padded[picked[:, j]])
        buckets[:, t] = key
    bits = np.zeros((len(own), BITS), bool)
    bits[row, (lab & _U(BITS - 1)).astype(np.int64)] = True
    return own, buckets, sig, np.packbits(bits, axis=1)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def sketch(docs: DataFrame) -> DataFrame:
    """One row for each document: its node (a hash of the word sequence), shingles, buckets and minima."""

    def run(batches):
        for b in T.slices(batches, 4 << 20):
            data, off = T.column(b.column("text"))
            s, first, h, words = shingles(data, off)
            own, buckets, sig, bits = sketches(s, first)
            at = {int(i): k for k, i in enumerate(own)}
            raw = data.tobytes()
            node = [name_of(h[words[i] : words[i + 1]], raw[off[i] : off[i + 1]]) for i in range(len(off) - 1)]
            signed = buckets.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array(node, pa.binary()),
                    pa.array(np.diff(first), pa.int32()),
                    pa.array([signed[at[i]] if i in at else [] for i in range(len(node))], pa.list_(pa.int64())),
                    pa.array([sig[at[i]].tobytes() if i in at else b"" for i in range(len(node))], pa.binary()),
                    pa.array([bits[at[i]].tobytes() if i in at else b"" for i in range(len(node))], pa.binary()),
                ],
                ["doc_id", "node", "n", "buckets", "sig", "bits"],
            )

    return _keyed(docs).transform(T.mapped, run, SKETCH)


ROUND = "a binary, a_doc long, b binary, b_doc long"
LIMITS = (4, 64, None)  # pairs of a node, and of two classes, in a bucket by round; the last has to be None


class _Leaders:
    """The nodes of a bucket that others are compared with in the first pass."""

    def __init__(self, most: int):
        self.most, self.size = most, 0
        self.nodes: list = []
        self.sig, self.n = np.empty((16, SKETCHES), np.uint16), np.empty(16, np.int64)

    def add(self, row):
        """The leader that the node is likeliest to be alike to, if any."""
        _, _, n, sig = row
        k = self.size
        same = (self.sig[:k] == sig).sum(1)
        own = self.n[:k]
        same[np.minimum(own, n) < THRESHOLD * np.maximum(own, n)] = 0
        best = int(same.argmax()) if k else 0
        hit = self.nodes[best] if k and same[best] >= LEAST else None
        if (hit and same[best] >= ALMOST) or k >= self.most:
            return hit
        if k == len(self.n):
            self.sig, self.n = (np.concatenate([x, np.empty_like(x)]) for x in (self.sig, self.n))
        self.sig[k], self.n[k] = sig, n
        self.nodes.append(row)
        self.size += 1
        return hit


def _central_first(rows: list) -> list:
    """Rows in the order of how many share their minima: what the others are copies of comes first."""
    sig = np.stack([r[3] for r in rows])
    score = np.zeros(len(rows), np.int64)
    for t in range(SKETCHES):
        _, at, count = np.unique(sig[:, t], return_inverse=True, return_counts=True)
        score += count[at]
    return [rows[i] for i in np.argsort(-score, kind="stable")]


def _batch(out: list) -> pa.RecordBatch:
    types = [pa.binary(), pa.int64(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["a", "a_doc", "b", "b_doc"])


def _pair(a, b) -> tuple:
    return (*a[:2], *b[:2]) if a[0] < b[0] else (*b[:2], *a[:2])


def _first(most: int):
    """First pass: each node with its likeliest leader."""

    def run(batches):
        """Rows stream by sorted by bucket and node, BUFFER of a bucket at a time; buckets of one cost nothing."""
        out, key, rows, own = [], None, [], None

        def work():
            nonlocal own
            if own is None and len(rows) < 2:
                return
            own = own or _Leaders(most)
            for row in _central_first(rows):
                hit = own.add(row)
                if hit:
                    out.append(_pair(hit, row))
            rows.clear()

        for b in batches:
            bucket = b.column("bucket").to_numpy()
            alone = np.ones(len(bucket), bool)
            alone[1:] = bucket[1:] != bucket[:-1]
            alone[:-1] &= bucket[1:] != bucket[:-1]
            alone[:1] &= key is None or bucket[:1] != key
            alone[-1:] = False  # the next batch may go on with it
            at = np.flatnonzero(~alone)
            few = b.take(pa.array(at)).to_pydict()
            for i, k in enumerate(bucket[at].tolist()):
                if k != key:
                    if rows:
                        work()
                    key, own = k, None
                    rows.clear()
                rows.append((few["node"][i], few["doc_id"][i], few["n"][i], np.frombuffer(few["sig"][i], np.uint16)))
                if len(rows) >= BUFFER:
                    work()
                if len(out) >= 20_000:
                    yield _batch(out)
                    out.clear()
        if rows:
            work()
        if out:
            yield _batch(out)

    return run


def _top(most: int, score: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Places of the `most` highest scores of each key."""
    order = np.lexsort((-score.astype(np.int64), *keys))
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    at = np.arange(len(order))
    return order[at - np.maximum.accumulate(np.where(new, at, 0)) < most]


def crossing(n: np.ndarray, sig: np.ndarray, bits: np.ndarray, label: np.ndarray, limit: int | None):
    """Pairs (i, j) of different labels that may be alike, in pieces; with a limit the likeliest of each i, and of
    each two labels, only."""
    m = len(n)
    sig = np.ascontiguousarray(sig.T)
    # shingles in common fall on bits in common; at most as many more as share bits among themselves
    extra = n - np.bitwise_count(bits).sum(1).astype(np.int64)
    step = max(1, (1 << 22) // max(m, 1))
    some = []
    for lo in range(0, m, step):
        hi, base = min(m, lo + step), 0 if limit else lo
        ok = label[lo:hi, None] != label[None, base:]
        if not limit:
            ok &= np.arange(base, m)[None, :] > np.arange(lo, hi)[:, None]
        same = np.zeros(ok.shape, np.uint8)
        for t in range(SKETCHES):
            same += sig[t, lo:hi, None] == sig[t, None, base:]
        ok &= same >= LEAST
        i, j = np.nonzero(ok)
        score = same[i, j]
        i, j = i + lo, j + base
        ok = np.minimum(n[i], n[j]) >= THRESHOLD * np.maximum(n[i], n[j])
        i, j, score = i[ok], j[ok], score[ok]
        ok = np.ones(len(i), bool)
        for k in range(0, len(i), 1 << 14):
            x, y = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
            common = np.bitwise_count(bits[x] & bits[y]).sum(1).astype(np.int64) + np.minimum(extra[x], extra[y])
            ok[k : k + (1 << 14)] = common >= THRESHOLD / (1 + THRESHOLD) * (n[x] + n[y]) - 1e-9
        i, j, score = i[ok], j[ok], score[ok]
        if limit and len(i):
            at = _top(limit, score, i)
            some.append((i[at], j[at], score[at]))
        elif len(i):
            yield i, j
    if some:
        i, j, score = (np.concatenate(x) for x in zip(*some, strict=True))
        at = _top(limit, score, np.minimum(label[i], label[j]), np.maximum(label[i], label[j]))
        yield i[at], j[at]


def _across(limit: int | None):
    """The pairs of crossing() for each bucket; rows stream by sorted by bucket."""

    def run(batches):
        out, key, parts = [], None, []

        def close():
            if not parts:
                return
            t = pa.Table.from_batches(parts)
            parts.clear()
            node, doc = t.column("node").to_pylist(), t.column("doc_id").to_pylist()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, SKETCHES)
            bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), _U).reshape(-1, BITS // 64)
            for i, j in crossing(t.column("n").to_numpy().astype(np.int64), sig, bits, t.column("label").to_numpy(), limit):
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    out.append(_pair((node[x], doc[x]), (node[y], doc[y])))
                    if len(out) >= 20_000:
                        yield _batch(out)
                        out.clear()

        for b in batches:
            bucket = b.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if bucket[lo] != key:
                    yield from close()
                    key = bucket[lo]
                parts.append(b.slice(lo, hi - lo))
        yield from close()
        if out:
            yield _batch(out)

    return run


def align(x: np.ndarray, y: np.ndarray, need: int) -> int:
    """Length of the longest common subsequence within the band that `need` leaves, by bit-parallel rows."""
    n = min(len(x), len(y))
    same = x[:n] == y[:n]
    head = n if same.all() else int(same.argmin())
    x, y, n = x[head:], y[head:], n - head
    tail = 0
    if n:
        same = x[::-1][:n] == y[::-1][:n]
        tail = n if same.all() else int(same.argmin())
        x, y = x[: len(x) - tail], y[: len(y) - tail]
    if not len(x) or not len(y):
        return head + tail
    width = max(len(x), len(y)) - (need - head - tail)  # how far the diagonal may be left
    if width < 0:
        return head + tail
    where: dict = {}
    for j, w in enumerate(y.tolist()):
        where[w] = where.get(w, 0) | 1 << j
    full, band = (1 << len(y)) - 1, (1 << 2 * width + 1) - 1
    v = full
    for i, w in enumerate(x.tolist()):
        m = where.get(w)
        if m:
            u = v & m & (band << i - width if i >= width else band >> width - i)
            v = (v + u | v - u) & full
    return head + tail + len(y) - v.bit_count()


def _verify(threshold: float):
    def run(batches):
        for b in batches:
            a, fa, ha, wa = shingles(*T.column(b.column("text_a")))
            c, fc, hc, wc = shingles(*T.column(b.column("text_b")))
            sims = np.zeros(b.num_rows)
            for i in range(b.num_rows):
                if b.column("a")[i].as_py() != name_of(ha[wa[i] : wa[i + 1]], b"") or b.column("b")[i].as_py() != name_of(hc[wc[i] : wc[i + 1]], b""):
                    continue  # another row of the same doc_id
                x, y = a[fa[i] : fa[i + 1]], c[fc[i] : fc[i + 1]]
                need = int(np.ceil(threshold / (1 + threshold) * (len(x) + len(y)) - 1e-9))
                if need <= min(len(x), len(y)):
                    m = align(x, y, need)
                    sims[i] = m / (len(x) + len(y) - m)
            ok = pa.array(sims >= threshold)
            out = pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(sims)], ["a", "b", "similarity"])
            yield out.filter(ok)

    return run


def _found(docs: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs that hold, with their similarity; only texts that stand in a pair move."""
    wanted = pairs.select(F.col("a_doc").alias("doc_id")).unionByName(pairs.select(F.col("b_doc").alias("doc_id"))).distinct()
    texts = filters.only(_keyed(docs), "doc_id", filters.of(wanted, "doc_id"))
    one = pairs.join(texts.select(F.col("doc_id").alias("a_doc"), F.col("text").alias("text_a")), "a_doc")
    two = one.join(texts.select(F.col("doc_id").alias("b_doc"), F.col("text").alias("text_b")), "b_doc")
    return two.select("a", "b", "text_a", "text_b").transform(T.mapped, _verify(threshold), "a binary, b binary, similarity double").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def classes(docs: DataFrame, threshold: float = THRESHOLD, work: Work | None = None, leaders: int = LEADERS) -> DataFrame:
    """One row for each document: doc_id, class_id and representative (of the smallest doc_id in its class)."""
    spark = docs.sparkSession
    T.small_batches(spark)
    work = work or Work(spark, "neardup")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sketched = work.table(sketch(docs), "sketches")
    facts = [F.first(c).alias(c) for c in ("n", "sig")]
    nodes = sketched.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), *facts, F.first("buckets").alias("buckets"))
    nodes = work.table(nodes, "nodes")

    def dealt(rows: DataFrame, kernel, name: str) -> DataFrame:
        return work.table(rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "node").transform(T.mapped, kernel, ROUND).distinct(), name)

    def mixed(rows: DataFrame) -> DataFrame:
        """The rows of buckets with more than one label, and how many each has."""
        rows = rows.select("bucket", "node", "label").repartition(parts, "bucket")
        many = rows.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("many")).where("lo <> hi")
        return rows.join(many.select("bucket", "many"), "bucket")

    def named(rows: DataFrame, roots: DataFrame) -> DataFrame:
        return rows.join(roots, "node", "left").withColumn("label", F.xxhash64(F.coalesce("root", "node"))).drop("root")

    pairs = dealt(nodes.select("node", "doc_id", "n", "sig", F.explode("buckets").alias("bucket")), _first(FEW), "pairs")
    found = work.table(_found(docs, pairs, threshold), "links")
    roots = work.table(components(found, work, "stars"), "roots")

    # all that stands in a bucket with another class
    shared = work.table(mixed(named(nodes.select("node", F.explode("buckets").alias("bucket")), roots)), "shared")
    large = shared.where(F.col("many") > leaders)
    if not large.isEmpty():
        finer = [F.xxhash64("bucket", F.lit(t), F.substring("sig", 2 * t + 1, 2)) for t in range(SKETCHES)]
        again = large.join(nodes.select("node", "sig"), "node").select("node", "label", F.explode(F.array(*finer)).alias("bucket"))
        shared = work.table(shared.where(F.col("many") <= leaders).unionByName(mixed(again)), "finer")
    known = sketched.where("n > 0").join(shared.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"), *facts, F.first("bits").alias("bits"))
    known = work.table(known, "known")
    for k, limit in enumerate(LIMITS):
        shared = work.table(mixed(named(shared.select("bucket", "node"), roots)), f"shared{k}") if k else shared
        if shared.isEmpty():
            break
        more = dealt(shared.select("bucket", "node", "label").join(known, "node"), _across(limit), f"pairs{k}")
        more = work.table(more.join(pairs.select("a", "b"), ["a", "b"], "left_anti"), f"new{k}")
        if limit and more.isEmpty():
            continue  # these were tried; the next round goes further
        links = work.table(_found(docs, more, threshold), f"links{k}")
        pairs, found = pairs.unionByName(more), found.unionByName(links)
        if not links.isEmpty():
            roots = work.table(components(found, work, f"stars{k}-"), f"roots{k}")

    # first what each word sequence stands for, so that copies are counted once before anything is joined
    placed = sketched.groupBy("node").agg(F.min("doc_id").alias("own")).join(roots, "node", "left").select("node", "own", F.coalesce("root", "node").alias("root"))
    heads = placed.groupBy("root").agg(F.min("own").alias("class_id"))
    called = placed.join(heads, "root").select("node", "class_id")
    out = sketched.select("doc_id", "node").join(called, "node")
    return out.select(F.nullif("doc_id", F.lit(LAST)).alias("doc_id"), F.nullif("class_id", F.lit(LAST)).alias("class_id"), (F.col("doc_id") == F.col("class_id")).alias("representative"))


def clean(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The document of smallest doc_id of each class, all columns kept."""
    kept = classes(docs, threshold).where("representative").select(F.coalesce("doc_id", F.lit(-1)).alias("_id"), F.col("doc_id").isNull().alias("_none")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # other columns travel inside, whatever their names
    keyed = docs.select(F.coalesce("doc_id", F.lit(-1)).alias("_id"), F.col("doc_id").isNull().alias("_none"), F.col("text").alias("_text"), row.alias("_row"))
    return keyed.join(kept, ["_id", "_none"], "left_semi").dropDuplicates(["_id", "_none", "_text"]).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
