"""Texts as arrays of folded characters, and bounded labelled samples."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from . import textops as T

#: characters above this are no letters (the last block with letters ends below it)
TOP = 0x323B0


@functools.lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """Letters to their first lower-case character, all else to 0."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(TOP):
        c = chr(i)
        if c.isalpha():
            out[i] = ord(c.lower()[0])
    return out


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, first): each text as one 0, then its words of letters with one 0 behind each.

    first has len(texts) + 1 entries; a text without letters has the single leading 0.
    """
    raw = np.frombuffer("\0".join(texts).encode("utf-32-le", "replace"), np.uint32)
    lens = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    begin = np.concatenate(([0], np.cumsum(lens + 1)))[:-1]
    code = _fold()[raw]
    code = np.concatenate((code, np.zeros(1, np.uint32)))
    keep = code != 0
    keep[1:] |= code[:-1] != 0  # the first of several 0s behind a word
    # before each text stands its own leading 0; the 0 behind the last word is kept even at a text's end
    out = np.insert(code, begin, 0) if len(texts) else code
    kept = np.insert(keep, begin, True) if len(texts) else keep
    n_before = np.concatenate(([0], np.cumsum(kept)))
    first = n_before[begin + np.arange(len(texts))]
    body = out[kept]
    return body, np.append(first, n_before[-1])


def held_out(folds: int = 5) -> Column:
    """crc32 of doc_id as text, mod folds, is 0; a null doc_id is held out as well."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds, F.lit(0)) == 0


def picked(rows: DataFrame, label: str, per_label: int, docs: DataFrame | None = None) -> DataFrame | None:
    """doc_id, whole text and label of about per_label rows of each label, chosen by a hash of doc_id; None if
    there are none.

    Where the labels come from another table, rows has doc_id and label, and docs the texts: the ids are
    chosen first, and only the chosen texts move.
    """
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_label / n))])
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    out = rows.where(u < share[F.col(label)])
    if docs is not None:
        few = out.select("doc_id", label).toArrow()  # per_label ids of each label
        out = docs.select("doc_id", "text").join(F.broadcast(docs.sparkSession.createDataFrame(few)), "doc_id")
    return out.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), label)
