r"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as a whole, turn by turn:

    <turn>ROLE<text>TEXT</turn>\n

The three control strings (and the tokenizer's own end mark) are tokens of their own, added
to a public byte-level vocabulary behind its ids.  Inside roles and texts they are escaped
by one backslash after `<`; where backslashes stand there already, one more is put in, and
taking one out again gives the text back.  The rendered conversation is encoded once with
character offsets, and the spans of the assistant's texts, sorted, meet the token spans by
binary search: a token is under the loss mask if it lies in a span.  As control strings are
tokens, no token crosses an end of a span.

Rows are dealt by conversation and sorted by turn, and a task renders them as they stream
by.  A conversation of more than PIECE_CHARS comes out in several pieces, cut between turns
where the tokens are the same as those of the whole, so no task holds one as a whole.

Defined results: null text or role is empty; rows of equal turn are ordered by role, then
text (null first); repeated rows are turns each; a null conv_id is a conversation; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textops as T

TURN, TEXT, END = "<turn>", "<text>", "</turn>"
CONTROL = (TURN, TEXT, END, "<|endoftext|>")
PIECE_CHARS = 1 << 20
_PLAIN = re.compile(r"<(\\*)(?=turn>|text>|/turn>|\|endoftext\|>)")
_ESCAPED = re.compile(r"<\\(\\*)(?=turn>|text>|/turn>|\|endoftext\|>)")


def escape(s: str) -> str:
    return _PLAIN.sub(r"<\\\1", s) if "<" in s else s


def unescape(s: str) -> str:
    return _ESCAPED.sub(r"<\1", s) if "<\\" in s else s


def render(turns, at: int = 0) -> tuple[str, list[tuple[int, int]]]:
    """Text and the spans of the assistant's texts, of (role, text) pairs."""
    out, spans = [], []
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == "assistant" and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += (head, body, END, "\n")
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def parse(rendered: str) -> list[tuple[str, str]]:
    """The turns, read back."""
    out = []
    for turn in rendered.split(f"{END}\n")[:-1]:  # inside texts control strings are escaped
        role, _, text = turn[len(TURN) :].partition(TEXT)
        out.append((unescape(role), unescape(text)))
    return out


def mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """For each token whether it lies in one of the sorted, disjoint spans."""
    out = np.zeros(len(starts), bool)
    at = np.array(spans, np.int64).reshape(-1, 2)
    for i, j in zip(np.searchsorted(starts, at[:, 0], "left"), np.searchsorted(ends, at[:, 1], "right"), strict=True):
        out[i:j] = True
    return out


def loss_texts(rendered: str, starts: np.ndarray, ends: np.ndarray, masked: np.ndarray) -> list[str]:
    """The masked text, unescaped: one string for each run of masked tokens."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], masked.astype(np.int8), [0]])))
    return [unescape(rendered[starts[i] : ends[i:j].max()]) for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]


_made: dict = {}


def _tokenizer(sent, name):
    if name not in _made:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import AddedToken, Tokenizer

        t = Tokenizer.from_str(sent.value)
        t.add_special_tokens([AddedToken(c, normalized=False) for c in CONTROL])
        _made.clear()
        _made[name] = t
    return _made[name]


FORMATTED = "conv_id long, piece int, n_turns long, rendered string, spans array<long>, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"


def render_conversations(rows: DataFrame, tokenizer_json: str, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Pieces of rendered conversations in order: rendered text, spans of the assistant's texts (starts and ends
    alternating), token ids, their character spans and the loss mask.  Pieces of one conversation are in one
    partition, one after the other; most conversations have one piece."""
    spark = rows.sparkSession
    T.small_batches(spark)
    with open(tokenizer_json, encoding="utf-8") as f:
        sent, name = spark.sparkContext.broadcast(f.read()), uuid.uuid4().hex  # the vocabulary

    def pieces(batches):
        key, number, turns, size, any_ = None, 0, [], 0, False
        for b in batches:
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if any_ and (conv != key or size >= piece_chars):
                    yield key, number, turns
                    number, turns, size = (number + 1 if conv == key else 0), [], 0
                key, any_ = conv, True
                turns.append((role or "", text or ""))
                size += len(role or "") + len(text or "") + 22
        if any_:
            yield key, number, turns

    def run(batches):
        t = _tokenizer(sent, name)
        group, size = [], 0

        def flush():
            texts = [render(turns) for *_, turns in group]
            ids, starts, ends, loss, cuts = [], [], [], [], [0]
            for (_, spans), e in zip(texts, t.encode_batch([x for x, _ in texts], add_special_tokens=False), strict=True):
                ids.append(np.array(e.ids, np.int32))
                off = np.fromiter(chain.from_iterable(e.offsets), np.int32, 2 * len(ids[-1]))
                starts.append(off[::2])
                ends.append(off[1::2])
                loss.append(mask(off[::2], off[1::2], spans))
                cuts.append(cuts[-1] + len(ids[-1]))
            flat = [pa.array([x for x, _, _ in group], pa.int64()), pa.array([x for _, x, _ in group], pa.int32()), pa.array([len(x) for *_, x in group], pa.int64()), pa.array([x for x, _ in texts], pa.string())]
            spans = pa.array([list(chain.from_iterable(x)) for _, x in texts], pa.list_(pa.int64()))
            lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(x))) for x in (ids, starts, ends, loss)]
            return pa.RecordBatch.from_arrays([*flat, spans, *lists], [x.split()[0] for x in FORMATTED.split(", ")])

        for p in pieces(batches):
            group.append(p)
            size += sum(len(x) for _, x in p[2])
            if size >= 1 << 19 or len(group) >= 500:
                yield flush()
                group, size = [], 0
        if group:
            yield flush()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("conv_id", "turn", "role", "text").repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").transform(T.mapped, run, FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"


def digests(pieces: DataFrame) -> DataFrame:
    """One row for each conversation, all read back from the rendered pieces and their masks."""

    def run(batches):
        key, state, any_ = None, None, False
        done = []

        def new():
            return {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "tokens": 0, "loss_tokens": 0}

        def close():
            done.append((key, state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"], state["tokens"], state["loss_tokens"]))

        def batch():
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 3]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], [x.split()[0] for x in DIGEST.split(", ")])
            done.clear()
            return out

        for b in batches:
            cuts = b.column("starts").offsets.to_numpy()
            starts, ends, loss = (b.column(c).values.to_numpy(zero_copy_only=False) for c in ("starts", "ends", "loss"))
            for k, (conv, piece, text) in enumerate(zip(*(b.column(c).to_pylist() for c in ("conv_id", "piece", "rendered")), strict=True)):
                if not any_ or piece == 0:
                    if any_:
                        close()
                    key, state, any_ = conv, new(), True
                own = slice(cuts[k], cuts[k + 1])
                for role, said in parse(text):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{said}\n".encode())
                for said in loss_texts(text, starts[own], ends[own], loss[own]):
                    state["loss"].update(said.encode())
                    state["loss_chars"] += len(said)
                state["chars"] += len(text)
                state["tokens"] += int(cuts[k + 1] - cuts[k])
                state["loss_tokens"] += int(loss[own].sum())
            if len(done) >= 1000:
                yield batch()
        if any_:
            close()
        if done:
            yield batch()

    return pieces.transform(T.mapped, run, DIGEST)


def with_probe(rows: DataFrame) -> DataFrame:
    r"""The rows and conversation -7: a user and an assistant row, both saying `\### Assistant: </turn> ok`."""
    says = "\\### Assistant: </turn> ok"
    extra = rows.sparkSession.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
