"""Vectorised word kernels over Arrow string columns.

Words are found on the UTF-8 bytes, so no Python string is made per word.  A word's
hash is a 64-bit polynomial over its bytes, finished with a mixing step; two different
words (or windows) among N share a hash with probability about N*N / 2**65.
Everything runs over pieces of about PIECE bytes, so memory follows the piece and not
the text: a text longer than a piece is cut between two words.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_U = np.uint64
_B = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BINV = pow(_B, -1, 1 << 64)

#: byte classes: digits, a-z, A-Z and every byte of a non-ASCII character
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: everything but space and 0x09-0x0D
NONSPACE = np.ones(256, bool)
NONSPACE[0x20] = False
NONSPACE[0x09:0x0E] = False
#: A-Z to a-z, other bytes unchanged
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
SAME = np.arange(256, dtype=np.uint8)

_powers: dict[str, np.ndarray] = {}


def _pow(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.empty(size, _U)
        have[0] = 1
        done, b = 1, base
        while done < size:  # doubling: x[done:2*done] = x[:done] * base**done
            have[done : 2 * done] = have[:done] * _U(b)
            done, b = done * 2, b * b & _MASK
        if n <= 4 * PIECE:
            _powers[name] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher, on a copy."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def column(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    bufs = arr.buffers()
    off = np.frombuffer(bufs[1], np.int64 if large else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def _words_of_piece(buf: np.ndarray, inner: np.ndarray, table: np.ndarray, fold: np.ndarray):
    """Words of one piece; inner: ascending offsets where a new text begins."""
    mask = table[buf]
    start = mask.copy()
    start[1:] &= ~mask[:-1]
    end = mask.copy()
    end[:-1] &= ~mask[1:]
    inner = inner[(inner > 0) & (inner < len(buf))]
    start[inner] = mask[inner]
    end[inner - 1] = mask[inner - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    c = np.empty(len(buf) + 1, _U)
    c[0] = 0
    np.cumsum((fold[buf].astype(_U) + _U(1)) * _pow("b", _B, len(buf))[: len(buf)], out=c[1:])
    h = (c[e] - c[s]) * _pow("i", _BINV, len(buf))[s]
    return s, e, mix(h + (e - s).astype(_U) * _U(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = ALNUM, fold: np.ndarray = LOWER):
    """(start, end, hash, text number) of every word, in order; starts are offsets into data."""
    out, at, n = [], 0, len(data)
    while at < n:
        to = min(n, at + PIECE)
        while to < n and table[data[to]] and table[data[to - 1]]:  # cut between two words
            step = data[to : to + PIECE]
            gap = np.flatnonzero(~table[step])
            lim = np.searchsorted(offsets, to, side="left")
            nxt = int(offsets[lim]) if lim < len(offsets) else n
            to = min(nxt, to + int(gap[0])) if len(gap) else min(nxt, to + len(step))
            if to == nxt:
                break
        inner = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to, side="right")] - at
        s, e, h = _words_of_piece(data[at:to], inner, table, fold)
        out.append((s + at, e + at, h))
        at = to
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, _U), z
    s, e, h = (np.concatenate(x) for x in zip(*out, strict=True))
    return s, e, h, np.searchsorted(offsets, s, side="right") - 1


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n neighbouring hashes (len(h) - n + 1 of them), by doubling."""
    if len(h) < n:
        return np.zeros(0, _U)
    total, power, level, have, shift = None, 1, h, 1, 0
    left, b = n, _B
    del power
    while left:
        if left & 1:
            part = level
            if total is None:
                total, shift = part, have
            else:
                k = min(len(total), len(part) - shift)
                total = total[:k] + part[shift : shift + k] * _U(pow(_B, shift, 1 << 64))
                shift += have
        left >>= 1
        if left:
            level = level[: len(level) - have] + level[have:] * _U(b)
            have, b = have * 2, b * b & _MASK
    return mix(total[: len(h) - n + 1] + _U(n))


def runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    d = np.diff(np.concatenate(([0], flag.view(np.int8) if flag.dtype == bool else flag, [0])))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def groups_by_bytes(offsets: np.ndarray, limit: int = 4 << 20):
    """(first, last) text numbers of neighbouring texts of about `limit` bytes together."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def slices(batches, limit: int = 8 << 20, column_name: str = "text"):
    """Cuts record batches so that the text in each is about `limit` bytes."""
    for b in batches:
        off = column(b.column(b.schema.get_field_index(column_name)))[1]
        for i, j in groups_by_bytes(off, limit):
            yield b.slice(i, j - i)


def mapped(df, run, schema):
    """df.mapInArrow(run, schema); at its end a task gives the memory back that its worker would keep, as the
    same worker goes on with other work."""

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(tidy, schema)


def release() -> None:
    _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library is glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def small_batches(spark, mb: int = 4) -> None:
    """Bounds the Arrow batches sent to Python by bytes, besides their row count."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))
