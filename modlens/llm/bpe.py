"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The vocabulary is read from a rank file on the driver, whose path is a parameter, and
sent to the executors once (its size is that of the vocabulary, whatever the input).
Texts are encoded in pieces of bounded size, cut only where a pattern match must end;
every match is merged by itself, so the pieces' ids are those of the whole text.

Defined results: null counts as the empty text, which has no tokens; a repeated row gets
one result row each; strings that look like special tokens are ordinary text; rows of
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textops as T

PIECE_CHARS = 1 << 18
BATCH_CHARS = 1 << 20
CACHE = 300_000
# between two ASCII letters or digits and one space a match always ends
_UNCUT = re.compile(r"\s | \s|^ | $")
_CUT = re.compile(r"[A-Za-z0-9](?= [A-Za-z0-9])")


def byte_table() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for 256 and up."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _merges(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """For each token the pair of tokens that merges into it: its own bytes merged by lower ranks."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) == 1:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank))
            if ranks.get(parts[best] + parts[best + 1], rank) >= rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) != 2:
            raise ValueError(f"rank {rank} is not reached by merges")
        out.append((parts[0], parts[1]))
    return out


class Codec:
    """Encodes to ids and back.  Built from ranks (bytes to id) and the pattern whose matches are merged."""

    def __init__(self, ranks: dict[bytes, int], merges: list[tuple[bytes, bytes]], pattern: str, cache: int = 10_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        table = byte_table()
        show = lambda b: "".join(map(table.__getitem__, b))
        self.tok = Tokenizer(models.BPE({show(b): i for b, i in ranks.items()}, [(show(a), show(b)) for a, b in merges]))
        self.tok.model._resize_cache(cache)
        native = pattern == LIBRARY_PATTERN
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=native)
        self.tok.pre_tokenizer = level if native else pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), level])
        # decoding: each token's characters through the byte table the other way round
        back = {c: b for b, c in table.items()}
        self.bytes_of: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for shown, i in self.tok.get_vocab(with_added_tokens=False).items():
            self.bytes_of[i] = bytes(map(back.__getitem__, shown))
        self.sizes = np.array([len(b or b"") for b in self.bytes_of], np.int64)
        self.digits = [b"%d " % i for i in range(len(self.bytes_of))]

    @staticmethod
    def pieces(text: str) -> list[str]:
        out, at = [], 0
        while len(text) - at > PIECE_CHARS:
            m = _CUT.search(text, at + PIECE_CHARS)
            if not m:
                break
            out.append(text[at : m.end()])
            at = m.end()
        out.append(text[at:])
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text, in batches of bounded size."""
        out: list[list] = [[] for _ in texts]
        todo, size = [], 0

        def flush():
            for (i, _), e in zip(todo, self.tok.encode_batch_fast([p for _, p in todo], add_special_tokens=False), strict=True):
                out[i] += e.ids
            todo.clear()

        for i, text in enumerate(texts):
            for p in self.pieces(text):
                todo.append((i, p))
                size += len(p)
                if size >= BATCH_CHARS:
                    flush()
                    size = 0
        flush()
        return out

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids) -> str:
        """Joins the bytes first, so characters split between tokens come out whole."""
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


class Units:
    """Encodes texts unit by unit and keeps each unit's ids; a text's ids are those of its units in order.

    A text is cut before every single space between two characters that are no white space: a match of
    the pattern always begins there.  Units repeat a great deal, and those not met yet are encoded
    together, as one text whose tokens that begin with a space begin the units.
    """

    def __init__(self, codec: Codec, cache: int = CACHE):
        self.codec, self.cache = codec, cache
        self.known: dict = {}
        self.opens = np.array([b is not None and b[:1] == b" " for b in codec.bytes_of])

    @staticmethod
    def cut(text: str) -> list[str]:
        """Units; all but the first have lost the space in front."""
        parts = text.split(" ")
        if not _UNCUT.search(text):
            return parts
        out, own = [], parts[0]
        for p in parts[1:]:
            if own and p and not own[-1].isspace() and not p[0].isspace():
                out.append(own)
                own = p
            else:
                own += " " + p
        return [*out, own]

    def of(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        cut = [self.cut(t) for t in texts]
        new = set().union(*[x[1:] for x in cut]).difference(self.known)
        if len(self.known) + len(new) > self.cache:
            self.known.clear()
            new = set().union(*[x[1:] for x in cut])
        plain = [u for u in new if len(u) <= 64 and " " not in u]
        odd = [u for u in new if len(u) > 64 or " " in u]
        for i in range(0, len(plain), 8192):
            group = plain[i : i + 8192]
            ids = np.array(self.codec.tok.encode_batch_fast([" " + " ".join(group)], add_special_tokens=False)[0].ids)
            at = [*np.flatnonzero(self.opens[ids]).tolist(), len(ids)]
            ids = ids.tolist()
            for u, a, b in zip(group, at[:-1], at[1:], strict=True):
                self.known[u] = tuple(ids[a:b])
        for u, ids in zip(odd, self.codec.encode([" " + u for u in odd]), strict=True):
            self.known[u] = tuple(ids)
        first = self.codec.encode([x[0] for x in cut])
        return [list(chain(f, *map(self.known.__getitem__, x[1:]))) for f, x in zip(first, cut, strict=True)]


def char_spans(text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) in characters of tokens of these sizes in bytes, which make up the text: the characters' first
    bytes, by binary search, tell which character a byte belongs to.  A token that holds part of a character spans it."""
    raw = np.frombuffer(text.encode(), np.uint8)
    heads = np.flatnonzero((raw & 0xC0) != 0x80)
    ends = np.cumsum(sizes)
    return np.searchsorted(heads, ends - sizes, "right") - 1, np.searchsorted(heads, ends - 1, "right")


#: fixed value: the pattern that the library's byte-level splitter has built in
LIBRARY_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def shipped(spark, ranks_path: str, pattern: str):
    """A function for executors that makes the codec, once in each worker."""
    ranks = read_ranks(ranks_path)
    sent, name = spark.sparkContext.broadcast((ranks, _merges(ranks), pattern)), uuid.uuid4().hex
    return lambda: _codec(sent, name)


_made: dict = {}


def _codec(sent, name: str) -> Codec:
    if name not in _made:
        _made.clear()
        _made[name] = Codec(*sent.value)
    return _made[name]


def encode(docs: DataFrame, ranks_path: str, pattern: str = LIBRARY_PATTERN, offsets: bool = False) -> DataFrame:
    """doc_id, ids array<int>, and with offsets also starts and ends (characters) of each token."""
    T.small_batches(docs.sparkSession)
    codec = shipped(docs.sparkSession, ranks_path, pattern)

    def run(batches):
        c = codec()
        units = Units(c)
        for b in T.slices(batches, 1 << 20):
            texts = [x or "" for x in b.column("text").to_pylist()]
            cols = [units.of(texts)]
            if offsets:
                spans = [char_spans(t, c.sizes[ids]) for t, ids in zip(texts, cols[0], strict=True)]
                cols += [[a for a, _ in spans], [z for _, z in spans]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(x, pa.list_(pa.int32())) for x in cols]], ["doc_id", "ids", "starts", "ends"][: 1 + len(cols)])

    return docs.select("doc_id", "text").transform(T.mapped, run, "doc_id long, ids array<int>" + ", starts array<int>, ends array<int>" * offsets)


def decode(encoded: DataFrame, ranks_path: str, pattern: str = LIBRARY_PATTERN) -> DataFrame:
    """doc_id, text of the rows of encode()."""
    T.small_batches(encoded.sparkSession)
    codec = shipped(encoded.sparkSession, ranks_path, pattern)

    def run(batches):
        c = codec()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([c.decode(x or []) for x in b.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").transform(T.mapped, run, "doc_id long, text string")


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, ranks_path: str, pattern: str = LIBRARY_PATTERN) -> DataFrame:
    """Encodes, decodes again and returns the digests; ids stay in the worker."""
    T.small_batches(docs.sparkSession)
    codec = shipped(docs.sparkSession, ranks_path, pattern)

    def run(batches):
        c = codec()
        units = Units(c)
        for b in T.slices(batches, 1 << 20):
            rows = []
            for ids in units.of([x or "" for x in b.column("text").to_pylist()]):
                listed = b"".join(map(c.digits.__getitem__, ids))[:-1]
                rows.append((len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(c.decode_bytes(ids)).hexdigest()))
            n, a, d = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").transform(T.mapped, run, DIGEST)
