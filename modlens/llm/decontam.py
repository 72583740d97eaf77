"""Benchmark decontamination by suffix arrays over the training text.

The training side is cut into shards of a few MB.  Each shard gets a suffix array over its
words, every suffix in it, sorted as deep as the longest benchmark item goes.  Every suffix of
every item that has room for a window is binary-searched in it, word by word: the interval
of the suffixes that begin alike narrows, and what falls out of it at some word is an
occurrence whose longest match ends there.  So each occurrence of a window comes with its
longest verbatim match and with its places in the document and in the item; those that
another one holds are left out, and the spelling of the rest is compared.  Benchmark items come in blocks of
bounded size, each broadcast in turn; the documents are never shuffled.

Defined results: a null or wordless text has no words, hits or items; a repeated document
row gets one result row each; an item without words is never found; equal items are all
reported; items without item_id count as one item, without a name in the list, and what they
hit is hit; extra columns of either table are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textops as T

WINDOW = 10
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 32 << 20
MATCH = "struct<item_id:string,doc_start:bigint,item_start:bigint,length:bigint>"
OUT = f"doc_id long, text string, n_words long, hit_runs array<long>, matches array<{MATCH}>"


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of codes, sorted by their first `depth` codes at least; a 0 ends a text and is below
    all else.  Prefix doubling: a round sorts only what the one before left tied."""
    n = len(codes)
    sa = np.argsort(codes, kind="stable")
    sorted_ = codes[sa]
    new = np.ones(n, bool)
    new[1:] = (sorted_[1:] != sorted_[:-1]) | (sorted_[1:] == 0)  # ends of texts are apart from each other
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied = ~new
    tied[:-1] |= ~new[1:]
    at, k = np.flatnonzero(tied), 1
    while k < depth and len(at):
        own = sa[at]
        key = rank[own] * n + rank[np.minimum(own + k, n - 1)]  # a text's end stands last, so nothing lies beyond
        order = np.argsort(key, kind="stable")
        own, key = own[order], key[order]
        sa[at] = own
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        rank[own] = np.maximum.accumulate(np.where(new, at, 0))
        tied = ~new
        tied[:-1] |= ~new[1:]
        at, k = at[tied], 2 * k
    return sa


def _bound(codes, sa, j, want, lo, hi, right: bool) -> np.ndarray:
    """For each interval of the array the place where the code j words on reaches (or passes) the one wanted."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        todo = lo < hi
        if not todo.any():
            return lo
        mid = (lo + hi) >> 1
        got = codes[np.minimum(sa[np.minimum(mid, len(sa) - 1)] + j, len(codes) - 1)]
        up = todo & (got <= want if right else got < want)
        lo = np.where(up, mid + 1, lo)
        hi = np.where(todo & ~up, mid, hi)


class Items:
    """One block of benchmark items: their words, and the suffixes that have room for a window."""

    def __init__(self, ids: list[str | None], texts: list[str], window: int):
        data, off = T.column(pa.array(texts, pa.string()))
        self.start, self.end, h, of = T.words(data, off)
        self.folded, self.ids = T.LOWER[data].tobytes(), ids
        self.vocab, self.code = np.unique(h, return_inverse=True)
        self.of, self.first = of, np.searchsorted(of, np.arange(len(ids) + 1))
        n = np.diff(self.first)
        at = np.arange(len(h))
        self.need = np.minimum(n, window)[of]
        self.room = self.first[of + 1] - at
        self.suffixes = at[self.room >= self.need]
        self.depth = int(n.max()) if len(n) else 0

    def spelt(self, i: int, n: int) -> list[bytes]:
        return [self.folded[a:b] for a, b in zip(self.start[i : i + n].tolist(), self.end[i : i + n].tolist(), strict=True)]

    def search(self, data: np.ndarray, offsets: np.ndarray):
        """(first word of each text, marks of the words in a match, [(text, item, place in the text, in the item, length)])."""
        n_texts = len(offsets) - 1
        s, e, h, of = T.words(data, offsets)
        bounds = np.searchsorted(of, np.arange(n_texts + 1))
        hit, found = np.zeros(len(h), bool), []
        if not len(h) or not len(self.suffixes):
            return bounds, hit, found
        known, own = np.unique(h, return_inverse=True)
        place = np.arange(len(h)) + of  # with a 0 behind each text
        codes = np.zeros(len(h) + n_texts, np.int64)
        codes[place] = own + 1
        at = np.minimum(np.searchsorted(known, self.vocab), len(known) - 1)
        item = np.where(known[at] == self.vocab, at + 1, -1)[self.code]
        there = np.concatenate(([0], np.cumsum(item > 0)))
        q = self.suffixes
        q = q[there[q + self.need[q]] - there[q] == self.need[q]]  # a word that the shard lacks ends the search
        if not len(q):
            return bounds, hit, found
        sa = suffix_array(codes, self.depth)
        begin = np.searchsorted(codes[sa], np.arange(len(known) + 2))
        lo, hi = begin[item[q]], begin[item[q] + 1]
        pairs, j = [], 1

        def out(q, lo, hi, length):
            n = hi - lo
            if n.sum():
                where = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                pairs.append((np.repeat(q, n), sa[where], np.full(len(where), length)))

        while len(q):
            done = self.room[q] == j
            out(q[done], lo[done], hi[done], j)
            q, lo, hi = q[~done], lo[~done], hi[~done]
            want = item[q + j]
            lo2 = _bound(codes, sa, j, want, lo, hi, False)
            hi2 = _bound(codes, sa, j, want, lo2, hi, True)
            some = self.need[q] <= j  # what leaves the interval matches j words
            out(q[some], lo[some], lo2[some], j)
            out(q[some], hi2[some], hi[some], j)
            left = lo2 < hi2
            q, lo, hi, j = q[left], lo2[left], hi2[left], j + 1
        if not pairs:
            return bounds, hit, found
        q, p, n = (np.concatenate(x) for x in zip(*pairs, strict=True))
        before = (q > self.first[self.of[q]]) & (p > 0) & (codes[p - 1] == item[q - 1])  # part of a longer match
        text = np.searchsorted(place, p, side="left")
        q, p, n = q[~before], text[~before], n[~before]  # p: place among the words
        folded = T.LOWER[data].tobytes()
        for i, w, k in sorted(zip(q.tolist(), p.tolist(), n.tolist(), strict=True), key=lambda x: (x[1], x[0])):
            same = np.array([folded[a:b] == x for a, b, x in zip(s[w : w + k].tolist(), e[w : w + k].tolist(), self.spelt(i, k), strict=True)])
            for a, b in zip(*T.runs(same), strict=True):  # one run, but for equal hashes of different words
                if b - a >= self.need[i]:
                    hit[w + a : w + b] = True
                    t = int(of[w])
                    found.append((t, self.ids[self.of[i]], w + int(a) - int(bounds[t]), i + int(a) - int(self.first[self.of[i]]), int(b - a)))
        return bounds, hit, found


_made: dict = {}


def _items(sent, name: str, window: int) -> Items:
    """The block's items, made once in each worker."""
    if name not in _made:
        _made.clear()
        _made[name] = Items(*sent.value, window)
    return _made[name]


def _blocks(benchmark: DataFrame, block_bytes: int):
    """Broadcasts of the benchmark's items in blocks of about block_bytes, each with a name."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    for k in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        rows = own.collect()  # about block_bytes by construction
        yield spark.sparkContext.broadcast(([r["item_id"] for r in rows], [r["text"] for r in rows])), uuid.uuid4().hex


def _pass(block, name: str, window: int):
    def run(batches):
        items = _items(block, name, window)
        for b in T.slices(batches, SHARD_BYTES):
            bounds, hit, found = items.search(*T.column(b.column("text")))
            old_runs, old = b.column("hit_runs").to_pylist(), b.column("matches").to_pylist()
            new: dict[int, list] = {}
            for t, i, d, k, n in found:
                new.setdefault(t, []).append({"item_id": i, "doc_start": d, "item_start": k, "length": n})
            runs, matches = [], []
            for i in range(b.num_rows):
                f, r = hit[bounds[i] : bounds[i + 1]], old_runs[i] or []
                if i in new:
                    f = f.copy()
                    for x, y in zip(r[::2], r[1::2], strict=True):
                        f[x:y] = True
                    r = np.stack(T.runs(f), 1).ravel().tolist()
                runs.append(r)
                matches.append((old[i] or []) + new.get(i, []))
            kind = pa.list_(pa.struct([("item_id", pa.string()), ("doc_start", pa.int64()), ("item_start", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text"), pa.array(np.diff(bounds), pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(matches, kind)],
                ["doc_id", "text", "n_words", "hit_runs", "matches"],
            )

    return run


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, text, n_words, hit_runs (starts and ends in words, alternating) and matches: each
    longest verbatim match with an item that holds a window of it, as (item_id, doc_start, item_start, length in words).

    Keeps no state between documents: one narrow pass for each block of the benchmark.
    """
    T.small_batches(docs.sparkSession)
    out = docs.select("doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<bigint>)").alias("hit_runs"), F.expr(f"cast(array() as array<{MATCH}>)").alias("matches"))
    for block, name in _blocks(benchmark, block_bytes):
        out = out.transform(T.mapped, _pass(block, name, window), OUT)
    return out


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the length of the longest verbatim match with one item."""
    m = matches(docs, benchmark, **options)
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda x: x.item_id)))
    spans = "if(size(hit_runs) = 0, 0L, aggregate(sequence(0, size(hit_runs) - 1), 0L, (a, i) -> a + if(i % 2 = 0, -hit_runs[i], hit_runs[i])))"
    return m.select("doc_id", "n_words", F.expr(spans).alias("n_hit"), items.alias("items"), F.array_max(F.transform("matches", lambda x: x.length)).alias("longest")).select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.coalesce("longest", F.lit(0)).cast("long").alias("longest_match"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without a benchmark window, all columns kept: a row travels beside its text, in narrow passes."""
    cols = docs.columns
    T.small_batches(docs.sparkSession)
    keyed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"))
    for block, name in _blocks(benchmark, block_bytes):

        def run(batches, block=block, name=name):
            items = _items(block, name, window)
            for b in T.slices(batches, SHARD_BYTES):
                bounds, hit, _ = items.search(*T.column(b.column("text")))
                c = np.concatenate(([0], np.cumsum(hit)))
                yield b.filter(pa.array(c[bounds[1:]] == c[bounds[:-1]]))

        keyed = keyed.transform(T.mapped, run, keyed.schema)
    return keyed.select(*[F.col(f"_row.`{c}`").alias(c) for c in cols])
