"""Exact substring deduplication with fixed-block anchors.

A window is WINDOW neighbouring words of one document.  A word goes if it is covered by a
window whose word sequence also starts earlier: in a document of smaller doc_id, or
earlier in the same one.

1. Anchors.  Every document is cut into non-overlapping blocks of BLOCK words, the index;
   every rolling window of BLOCK words is a probe.  Any window of WINDOW >= 2*BLOCK - 1
   words holds a whole block, so both ends of a repeat hold a block that some other
   position's probe equals.  Probes travel as sorted, delta-coded hashes cut to a few
   bits more than the input needs: a chance hit costs work, never a wrong result.
2. Extension.  The windows around each block that was hit are compared by full 64-bit
   hashes (two different windows among N agree with probability N*N / 2**65); of equal
   windows all but the earliest are marked, and neighbouring marks run together into
   maximal repeats.
3. The marked words are cut out.  Only documents with marks travel with their text.

Both exchanges send one packed row per shard of documents and hash range, and a shard
sends each hash once, however often it stands there: a group of copies that makes up a
third of all rows is no heavier in any task than other text.

Defined results: null counts as the empty text (no words, nothing kept); rows of equal
doc_id are at the same place, so none of them is earlier than another; a null doc_id
comes after all others; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import filters, textops as T
from .work import Work

WINDOW, BLOCK = 20, 10
SHARD_BYTES = 6 << 20
RANGE_WORDS = 4_000_000
_U = np.uint64
_LAST = (1 << 63) - 1
EXCHANGE = "p int, kind int, shard long, a binary, b binary, c binary, d binary"


def _row(p, kind, shard, a=b"", b=b"", c=b"", d=b""):
    return (p, kind, shard, a, b, c, d)


def _batch(rows):
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
    types = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["p", "kind", "shard", "a", "b", "c", "d"])


def planes(x: np.ndarray) -> bytes:
    """Byte planes, so that the shuffle's codec sees the runs of equal high bytes."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unplanes(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted distinct keys below 2**56 as differences in as few bytes as all of them fit."""
    d = np.diff(keys, prepend=_U(0))
    width = max(1, (int(d.max()).bit_length() + 7) // 8) if len(d) else 1
    return bytes([width]) + d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_sorted(b: bytes) -> np.ndarray:
    width = b[0]
    raw = np.frombuffer(b, np.uint8, offset=1).reshape(-1, width)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, :width] = raw
    return np.cumsum(full.view("<u8").ravel(), dtype=_U)


def _shard(ids: np.ndarray, th: np.ndarray) -> int:
    """A shard's name follows from its rows, so a task that runs again gives it again."""
    return int.from_bytes(hashlib.blake2b(ids.tobytes() + th.tobytes(), digest_size=8).digest(), "little", signed=True)


def _ids(b) -> tuple[np.ndarray, np.ndarray]:
    ids = b.column("doc_id").fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64)
    return ids, b.column("th").to_numpy(zero_copy_only=False).astype(np.int64)


def _bounds(n_ranges: int, bits: int) -> np.ndarray:
    return np.array([-(-(i << bits) // n_ranges) for i in range(n_ranges + 1)], dtype=object)


def _probe(window: int, block: int, bits: int, n_ranges: int):
    edges = np.array(_bounds(n_ranges, bits)[:-1], dtype=np.uint64)

    def run(batches):
        for b in T.slices(batches, SHARD_BYTES):
            ids, th = _ids(b)
            data, off = T.column(b.column("text"))
            _, _, h, of = T.words(data, off, T.NONSPACE, T.SAME)
            first = np.searchsorted(of, np.arange(len(ids) + 1))
            n_words = np.diff(first)
            shard = _shard(ids, th)
            n_blocks = np.where(n_words >= window, n_words // block, 0)  # a shorter text has no window
            base = np.concatenate(([0], np.cumsum(n_blocks)))
            rows = [_row(shard % n_ranges, 1, shard, ids.tobytes(), th.tobytes(), base.astype(np.int64).tobytes())]
            w = T.windows(h, block)
            if len(w) and base[-1]:
                last = of[block - 1 :][: len(w)]
                ok = (of[: len(w)] == last) & (n_words[last] >= window)
                key = w >> _U(64 - bits)
                uniq, inv, count = np.unique(key[ok], return_inverse=True, return_counts=True)
                where = np.full(len(w), -1, np.int64)
                where[ok] = inv
                owner = np.repeat(np.arange(len(ids)), n_blocks)
                at = first[owner] + (np.arange(base[-1]) - base[owner]) * block
                at_key = where[at]
                order = np.argsort(at_key, kind="stable")
                at_key, ordinal = at_key[order], order.astype(np.uint32)
                cut = np.searchsorted(uniq, edges)
                cut = np.append(cut, len(uniq))
                for p in range(n_ranges):
                    i, j = int(cut[p]), int(cut[p + 1])
                    if i == j:
                        continue
                    x, y = np.searchsorted(at_key, [i, j])
                    rows.append(_row(p, 0, shard, pack_sorted(uniq[i:j] - edges[p]), np.packbits(count[i:j] > 1).tobytes(), planes((at_key[x:y] - i).astype(np.uint32)), planes(ordinal[x:y])))
                    if len(rows) >= 512:
                        yield _batch(rows)
                        rows = []
            yield _batch(rows)

    return run


def _hit_blocks(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One hash range: which indexed blocks does another position's probe equal?"""
    out, own = [], []
    for r in table.to_pylist():
        if r["kind"] == 1:
            out.append(_row(0, 1, r["shard"], r["a"], r["b"], r["c"]))
        else:
            own.append((r["shard"], unpack_sorted(r["a"]), r["b"], r["c"], r["d"]))
    if own:
        every = np.sort(np.concatenate([x[1] for x in own]))
        many = np.unique(every[1:][every[1:] == every[:-1]])
        for shard, keys, twice, at, ordinal in own:
            hit = np.unpackbits(np.frombuffer(twice, np.uint8), count=len(keys)).astype(bool)
            if len(many):
                hit |= many[np.minimum(np.searchsorted(many, keys), len(many) - 1)] == keys
            got = unplanes(ordinal, np.uint32)[hit[unplanes(at, np.uint32)]]
            if len(got):
                out.append(_row(0, 0, shard, np.sort(got).tobytes()))
    return pa.Table.from_batches([_batch(out)])


def _gather_blocks(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One shard: the hits by document."""
    rows = table.to_pylist()
    hits = [np.frombuffer(r["a"], np.uint32) for r in rows if r["kind"] == 0]
    ids, lists, ths = [], [], []
    if hits:
        hit = np.unique(np.concatenate(hits)).astype(np.int64)
        head = next(r for r in rows if r["kind"] == 1)
        doc, th, base = (np.frombuffer(head[c], np.int64) for c in "abc")
        cut = np.searchsorted(hit, base)
        for i in np.flatnonzero(np.diff(cut)).tolist():
            ids.append(int(doc[i]))
            ths.append(int(th[i]))
            lists.append((hit[cut[i] : cut[i + 1]] - base[i]).tolist())
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "th": pa.array(ths, pa.int64()), "blocks": pa.array(lists, pa.list_(pa.int32()))})


def _extend(window: int, block: int, n_ranges: int):
    edges = np.array(_bounds(n_ranges, 64)[:-1], dtype=np.uint64)

    def run(batches):
        for b in T.slices(batches, SHARD_BYTES):
            ids, th = _ids(b)
            data, off = T.column(b.column("text"))
            _, _, h, of = T.words(data, off, T.NONSPACE, T.SAME)
            first = np.searchsorted(of, np.arange(len(ids) + 1)).astype(np.int64)
            shard = _shard(ids, th)
            w = T.windows(h, window)
            blocks = b.column("blocks").combine_chunks() if isinstance(b.column("blocks"), pa.ChunkedArray) else b.column("blocks")
            lens = np.array([len(x) for x in blocks.to_pylist()], np.int64)
            at = first[np.repeat(np.arange(len(ids)), lens)] + blocks.flatten().to_numpy(zero_copy_only=False).astype(np.int64) * block
            near = np.zeros(len(h) + 1, np.int32)  # windows that hold the block: from at+block-window to at
            np.add.at(near, np.maximum(at + block - window, 0), 1)
            np.add.at(near, at + 1, -1)
            cand = np.cumsum(near)[: len(w)] > 0
            cand &= of[: len(w)] == of[window - 1 :][: len(w)]
            g = np.flatnonzero(cand)
            doc = ids[of[g]]
            start = g - first[of[g]]
            order = np.lexsort((start, doc, w[g]))
            g, doc, start = g[order], doc[order], start[order]
            key = w[g]
            new = np.ones(len(g), bool)
            new[1:] = key[1:] != key[:-1]
            lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(g) else g
            later = (doc != doc[lead]) | (start != start[lead])
            key, lead_g = key[new], g[new].astype(np.uint32)
            # rows of one doc_id stand at the same place: they share the answer to the first of them
            same = g[~new & ~later]
            rows = [_row(shard % n_ranges, 1, shard, ids.tobytes(), th.tobytes(), first.tobytes(), np.sort(g[later]).astype(np.uint32).tobytes())]
            if len(same):
                rows.append(_row(shard % n_ranges, 2, shard, same.astype(np.uint32).tobytes(), g[lead][~new & ~later].astype(np.uint32).tobytes()))
            cut = np.append(np.searchsorted(key, edges), len(key))
            places = first.astype(np.uint32).tobytes()
            for p in range(n_ranges):
                i, j = int(cut[p]), int(cut[p + 1])
                if i < j:
                    rows.append(_row(p, 0, shard, planes(key[i:j]), planes(lead_g[i:j]), ids.tobytes(), places))
                    if len(rows) >= 256:
                        yield _batch(rows)
                        rows = []
            yield _batch(rows)

    return run


def _later_windows(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One hash range: of equal windows all but the earliest."""
    out, own = [], []
    for r in table.to_pylist():
        if r["kind"]:
            out.append(_row(0, r["kind"], r["shard"], r["a"], r["b"], r["c"], r["d"]))
        else:
            g = unplanes(r["b"], np.uint32)
            first = np.frombuffer(r["d"], np.uint32)
            of = np.searchsorted(first, g, side="right") - 1
            own.append((r["shard"], unplanes(r["a"], _U), g, np.frombuffer(r["c"], np.int64)[of], (g - first[of]).astype(np.int64)))
    if own:
        k, g, doc, start = (np.concatenate([x[i] for x in own]) for i in (1, 2, 3, 4))
        src = np.repeat(np.arange(len(own)), [len(x[1]) for x in own])
        order = np.lexsort((start, doc, k))
        k, g, doc, start, src = (x[order] for x in (k, g, doc, start, src))
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = (doc != doc[lead]) | (start != start[lead])
        g, src = g[later], src[later]
        for i, x in enumerate(own):
            if len(got := g[src == i]):
                out.append(_row(0, 0, x[0], np.sort(got).tobytes()))
    return pa.Table.from_batches([_batch(out)])


def _gather_windows(window: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next((r for r in rows if r["kind"] == 1), None)
        ids, ths, lists = [], [], []
        if head:
            late = [np.frombuffer(head["d"], np.uint32), *[np.frombuffer(r["a"], np.uint32) for r in rows if r["kind"] == 0]]
            late = np.unique(np.concatenate(late)).astype(np.int64)
            for r in rows:
                if r["kind"] == 2:
                    same, lead = np.frombuffer(r["a"], np.uint32), np.frombuffer(r["b"], np.uint32)
                    late = np.unique(np.concatenate([late, same[np.isin(lead, late)].astype(np.int64)]))
            doc, th, first = (np.frombuffer(head[c], np.int64) for c in "abc")
            cut = np.searchsorted(late, first)
            for i in np.flatnonzero(np.diff(cut)).tolist():
                at = late[cut[i] : cut[i + 1]] - first[i]
                new = np.flatnonzero(np.diff(at, prepend=-window - 1) > window)  # touching windows run together
                stop = np.append(at[new[1:] - 1], at[-1]) + window
                ids.append(int(doc[i]))
                ths.append(int(th[i]))
                lists.append(np.stack([at[new], stop], 1).ravel().tolist())
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "th": pa.array(ths, pa.int64()), "runs": pa.array(lists, pa.list_(pa.int32()))})

    return run


def _only(sent):
    def run(batches):
        bits = np.frombuffer(sent.value, np.uint8)
        for b in batches:
            yield b.filter(pa.array(filters.holds(bits, _ids(b)[1])))

    return run


def repeats(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, work: Work | None = None) -> DataFrame:
    """(doc_id, th, runs): the maximal runs of words to cut from each document that has any, as starts and
    ends alternating.  th is xxhash64 of the text."""
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block")
    spark = docs.sparkSession
    T.small_batches(spark, 6)
    work = work or Work(spark, "substrings")
    docs = _keyed(docs)
    size = int(docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0)
    n_words = max(1, size // 4)
    bits = min(56, max(32, math.ceil(math.log2(n_words)) + 11))
    n_ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_words // RANGE_WORDS))

    probes = docs.transform(T.mapped, _probe(window, block, bits, n_ranges), EXCHANGE)
    hits = probes.groupBy("p").applyInArrow(_hit_blocks, EXCHANGE)
    flagged = work.table(hits.groupBy("shard").applyInArrow(_gather_blocks, "doc_id long, th long, blocks array<int>"), "blocks")

    sent = spark.sparkContext.broadcast(filters.of(flagged, "th", hashed=True))
    near = docs.transform(T.mapped, _only(sent), docs.schema).join(flagged.dropDuplicates(["doc_id", "th"]), ["doc_id", "th"])
    entries = near.select("doc_id", "th", "text", "blocks").transform(T.mapped, _extend(window, block, n_ranges), EXCHANGE)
    late = entries.groupBy("p").applyInArrow(_later_windows, EXCHANGE)
    runs = late.groupBy("shard").applyInArrow(_gather_windows(window), "doc_id long, th long, runs array<int>")
    return work.table(runs.dropDuplicates(["doc_id", "th"]), "runs")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce("doc_id", F.lit(_LAST)).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _cut(text: bytes, runs) -> tuple[int, int, bytes]:
    ws = text.split()  # bytes are split at exactly space and 0x09-0x0D
    if not runs:
        return len(ws), 0, b" ".join(ws)
    keep, at, gone = [], 0, 0
    for a, b in zip(runs[::2], runs[1::2], strict=True):
        keep += ws[at:a]
        gone += b - a
        at = b
    return len(ws), gone, b" ".join(keep + ws[at:])


KEPT = "doc_id long, th long, n_words long, n_removed long, kept_sha256 string, kept string"


def _finish(texts: bool):
    """Cuts the runs out of the rows that still carry their text."""

    def run(batches):
        for b in batches:
            rows = b.to_pydict()
            n, gone, sha, kept = rows["n_words"], rows["n_removed"], rows["kept_sha256"], rows["kept"]
            for i, text in enumerate(rows["text"]):
                if text is not None:
                    n[i], gone[i], out = _cut(text.encode(), rows["runs"][i])
                    sha[i], kept[i] = hashlib.sha256(out).hexdigest(), out.decode() if texts else None
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], [x.split()[0] for x in KEPT.split(", ")])

    return run


def dedup(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, texts: bool = True) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 and (with texts) kept, the kept words joined by one space."""
    spark = docs.sparkSession
    cut = repeats(docs, window, block)
    sent = spark.sparkContext.broadcast(filters.of(cut, "th", hashed=True))

    def whole(batches):
        bits = np.frombuffer(sent.value, np.uint8)
        for b in batches:
            maybe = filters.holds(bits, _ids(b)[1])
            n, sha, kept, text = [], [], [], []
            for m, t in zip(maybe.tolist(), b.column("text").to_pylist(), strict=True):
                if m:
                    row = (None, None, None, t)
                else:
                    k, _, out = _cut(t.encode(), None)
                    row = (k, hashlib.sha256(out).hexdigest(), out.decode() if texts else None, None)
                for c, x in zip((n, sha, kept, text), row, strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("th"), pa.array(n, pa.int64()), pa.array([None if x is None else 0 for x in n], pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string()), pa.array(text, pa.string())],
                ["doc_id", "th", "n_words", "n_removed", "kept_sha256", "kept", "text"],
            )

    out = _keyed(docs).transform(T.mapped, whole, KEPT + ", text string").join(cut, ["doc_id", "th"], "left").transform(T.mapped, _finish(texts), KEPT)
    return out.select(F.nullif("doc_id", F.lit(_LAST)).alias("doc_id"), "n_words", "n_removed", "kept_sha256", *["kept"] * texts)
