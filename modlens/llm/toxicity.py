"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A text is the bag of its character n-grams (within words, word ends marked).  Each n-gram
has a vector of DIM numbers in a hashed table; the text's vector is their weighted average
(an n-gram weighs the square root of its count over its usual size; the weights are brought to one
Euclidean length rather than to one sum, which tells a short passage in a long text better),
and a softmax over the two labels stands on it.  Table and softmax are trained jointly in
numpy on a bounded sample of labelled rows, so a misspelling never seen shares most n-grams
with what was.

With two labels the gradient of the table is one number for each row times the difference of
the softmax's columns, so a step costs two passes over the bags whatever DIM is; scoring needs
one number for each table row, and runs over whole texts in pieces.

Defined results: a text that is null or has no letter gets the score of an empty bag,
near one half; repeated rows are scored alike; extra columns are ignored.  With no
labelled rows, or those of one label only, every text gets the smoothed share of label 1 in the sample.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import chars, textops as T
from .work import Work

ORDERS = (3, 4, 5, 6)
BITS = 18
BUCKETS = 1 << BITS
DIM = 16
GAIN = 5.0
PER_LABEL = 1500
MIN_SHARE, MAX_SHARE = 0.005, 0.4
STEPS, RATE, DECAY = 60, 2.0, 1e-2
PIECE = 1 << 19  # n-grams that a step works on at once


def _bag(codes: np.ndarray):
    """(table row, start) for the n-grams of each order that have no word end inside."""
    c = codes.astype(np.uint64) + np.uint64(1)
    inner = codes != 0
    h, ok = c, None
    for n in range(2, ORDERS[-1] + 1):
        if len(c) < n:
            return
        h = h[:-1] * np.uint64(T._B) + c[n - 1 :]
        if n > 2:
            ok = inner[1 : len(c) - n + 2].copy() if ok is None else ok[:-1] & inner[n - 2 : len(c) - 1]
        if n in ORDERS:
            at = np.flatnonzero(ok)
            yield ((h[at] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int64), at


class Model:
    """used: compact number of each table row, or -1; weights: of each compact row in the softmax's favour of
    label 1; scale: its weight in the mean; bias: of the empty bag."""

    def __init__(self, used: np.ndarray, weights: np.ndarray, scale: np.ndarray, bias: float):
        self.used, self.weights, self.scale, self.bias = used, weights, scale, bias

    def counts(self, texts: list[str]):
        """For each text its n-grams as (compact row, count)."""
        codes, first = chars.folded(texts)
        found, cuts = [], []
        for row, at in _bag(codes):
            own = self.used[row]
            kept = own >= 0
            found.append(own[kept])
            cuts.append(np.searchsorted(at[kept], first))
        for i in range(len(texts)):
            rows = np.concatenate([f[c[i] : c[i + 1]] for f, c in zip(found, cuts, strict=True)]) if found else np.zeros(0, np.int64)
            c = np.bincount(rows, minlength=len(self.weights))
            at = np.flatnonzero(c)
            yield at, c[at]

    def logits(self, texts: list[str]) -> np.ndarray:
        own, square = self.weights * self.scale, self.scale**2
        out = []
        sizes = np.array([0, *map(len, texts)]).cumsum()
        for i, j in T.groups_by_bytes(sizes, 1 << 18):
            pieces = [p for t in texts[i:j] for p in _pieces(t)]
            if len(pieces) == j - i:
                bags = self.counts(pieces)
            else:  # one very long text
                total = np.zeros(len(self.weights))
                for p in pieces:
                    for at, c in self.counts([p]):
                        total[at] += c
                bags = [(np.flatnonzero(total), total[total > 0])]
            out += [GAIN * (np.sqrt(c) @ own[at]) / max(np.sqrt(c @ square[at]), 1e-9) for at, c in bags]
        return np.array(out) + self.bias

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -30, 30)))


def _pieces(text: str, limit: int = 1 << 20):
    """A very long text in pieces cut at white space."""
    at = 0
    while len(text) - at > limit:
        to = text.find(" ", at + limit)
        if to < 0:
            break
        yield text[at:to]
        at = to
    yield text[at:]


class Bags:
    """Labelled bags in flat arrays: text number, table row and count of each n-gram of a text, and the labels."""

    def __init__(self, of: np.ndarray, row: np.ndarray, count: np.ndarray, y: np.ndarray):
        self.of, self.row, self.count, self.y = of, row, count, y

    @classmethod
    def listed(cls, bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> Bags:
        flat = lambda k: np.concatenate([b[k] for b in bags]) if bags else np.zeros(0, np.int32)
        return cls(np.repeat(np.arange(len(bags), dtype=np.int32), [len(r) for r, _ in bags]), flat(0), flat(1), np.array(labels, np.int64))

    def only(self, own: np.ndarray) -> Bags:
        """Those of some texts, numbered anew."""
        at = own[self.of]
        return Bags((np.cumsum(own) - 1).astype(np.int32)[self.of[at]], self.row[at], self.count[at], self.y[own])

    def logits(self, model: Model) -> np.ndarray:
        up, square = np.zeros(len(self.y)), np.zeros(len(self.y))
        for i in range(0, len(self.of), PIECE):
            own = model.used[self.row[i : i + PIECE]]
            ok = own >= 0
            of, own, c = self.of[i : i + PIECE][ok], own[ok], self.count[i : i + PIECE][ok]
            scale = model.scale[own]
            up += np.bincount(of, np.sqrt(c) * scale * model.weights[own], minlength=len(self.y))
            square += np.bincount(of, c * scale**2, minlength=len(self.y))
        return GAIN * up / np.maximum(np.sqrt(square), 1e-9) + model.bias


def calibrated(bags: Bags, prior: float) -> Model:
    """fit(), with the bias moved so that a score of 0.5 gives the best F1 where label 1 has the share `prior`.

    The logits for that come from two models, each fitted on the half that the other is scored on.
    """
    y = bags.y
    if not 8 <= y.sum() <= len(y) - 8:
        return fit(bags)
    half = np.arange(len(y)) % 2 == 0
    z = np.empty(len(y))
    for own in (half, ~half):
        z[~own] = bags.only(~own).logits(fit(bags.only(own)))
    model = fit(bags)
    order = np.argsort(-z)
    w = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))[order]
    f1 = 2 * np.cumsum(w * y[order]) / (np.cumsum(w) + (w * y[order]).sum())
    k = min(int(f1.argmax()), len(z) - 2)
    model.bias -= float(np.clip((z[order][k] + z[order][k + 1]) / 2, -2, 2))
    return model


def _bag_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The table rows of a text's n-grams with their counts."""
    got = [x for piece in _pieces(text) for x, _ in _bag(chars.folded([piece])[0])]
    row, count = np.unique(np.concatenate(got) if got else np.zeros(0, np.int64), return_counts=True)
    return row.astype(np.int32), count.astype(np.int32)


def _sums(to: np.ndarray, size: int, x: np.ndarray, by: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of x * by[at] for each number in `to`, in pieces, so that no array of doubles is as long as the bags."""
    out = np.zeros(size)
    for i in range(0, len(to), PIECE):
        j = slice(i, i + PIECE)
        out += np.bincount(to[j], x[j] * by[at[j]], minlength=size)
    return out


def _totals(to: np.ndarray, size: int, x: np.ndarray, power: int = 1) -> np.ndarray:
    """Sums of a power of x for each number in `to`, in pieces."""
    out = np.zeros(size)
    for i in range(0, len(to), PIECE):
        out += np.bincount(to[i : i + PIECE], x[i : i + PIECE].astype(float) ** power, minlength=size)
    return out


def loss(of, row, x, y, weight, table, soft, bias):
    """(weighted cross-entropy of the labels, gradients of table, soft and bias) of the bags (text, table row, weight x)."""
    lead = soft[:, 1] - soft[:, 0]
    z = _sums(of, len(y), x, table @ lead, row) + bias[1] - bias[0]  # what label 1 is ahead by
    g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
    pull = _sums(row, len(table), x, g, of)
    sides = np.array([-1.0, 1.0])
    value = (weight * (np.logaddexp(0, z) - y * z)).sum()
    return value, np.outer(pull, lead), np.outer(table.T @ pull, sides), g.sum() * sides


def told(texts: np.ndarray, n: int) -> np.ndarray:
    """Which table rows are learnt, by the number of texts that hold them: rows that few texts share say nothing
    about other texts, rows that most share tell none apart."""
    return (texts >= max(2, MIN_SHARE * n)) & (texts <= MAX_SHARE * n)


def fit(bags: Bags, seed: int = 7) -> Model:
    """Trains table and softmax together by gradient descent, both labels weighing the same in all."""
    of, row, count, y = bags.of, bags.row, bags.count, bags.y
    used = np.full(BUCKETS, -1, np.int64)
    share = (y.sum() + 0.5) / (len(y) + 1)
    none = np.zeros(0)
    if not 0 < y.sum() < len(y):
        return Model(used, none, none, float(np.log(share / (1 - share))))
    held = sum(np.bincount(row[i : i + PIECE], minlength=BUCKETS) for i in range(0, len(row), PIECE))
    kept = np.flatnonzero(told(held, len(y)))
    used[kept] = np.arange(len(kept))
    small = used.astype(np.int32)[row]
    ok = small >= 0
    of, row, count = (bags.of, small, bags.count) if ok.all() else (bags.of[ok], small[ok], bags.count[ok])
    del small, ok
    scale = 1 / np.sqrt(_totals(row, len(kept), count) / len(y)) if len(kept) else none
    x = np.sqrt(count, dtype=np.float32)
    x *= scale.astype(np.float32)[row]
    x *= (GAIN / np.maximum(np.sqrt(_totals(of, len(y), x, 2)), 1e-9)).astype(np.float32)[of]
    del count
    rng = np.random.default_rng(seed)
    table, soft, bias = rng.normal(0, 0.01, (len(kept), DIM)).astype(np.float32), rng.normal(0, 1, (DIM, 2)), np.zeros(2)
    soft /= np.linalg.norm(soft[:, 1] - soft[:, 0])
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    speed = [np.zeros_like(w) for w in (table, soft, bias)]
    for _ in range(STEPS):
        _, to_table, to_soft, to_bias = loss(of, row, x, y, weight, table, soft, bias)
        to_table += DECAY * table
        for w, v, d, rate in zip((table, soft, bias), speed, (to_table, to_soft, to_bias), (RATE, 0.05, 0.5), strict=True):
            v *= 0.9
            v += d
            w -= rate * v
    return Model(used, table @ (soft[:, 1] - soft[:, 0]), scale, float(bias[1] - bias[0]))


BAG = "doc_id long, label int, place long, row array<int>, count array<int>"


def _bag_batch(b, bags) -> pa.RecordBatch:
    row, count = pa.array([r for r, _ in bags], pa.list_(pa.int32())), pa.array([c for _, c in bags], pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("label").cast(pa.int32()), b.column("place"), row, count], ["doc_id", "label", "place", "row", "count"])


def _bags(batches):
    for b in batches:
        yield _bag_batch(b, [_bag_of(t) for t in b.column("text").to_pylist()])


def _without(sent):
    """The bags with the rows that are learnt only."""

    def run(batches):
        for b in batches:
            out = []
            for r, c in zip(b.column("row"), b.column("count"), strict=True):
                r, c = r.values.to_numpy(), c.values.to_numpy()
                ok = sent.value[r]
                out.append((r[ok], c[ok]))
            yield _bag_batch(b, out)

    return run


def _trainer(prior: float):
    """All bags of a partition, in their order, to one row: the model that calibrated() makes of them, pickled."""

    def run(batches):
        parts = {"label": [], "row": [], "count": []}
        lengths = []
        for b in batches:
            parts["label"].append(b.column("label").to_numpy())
            lengths.append(b.column("row").value_lengths().to_numpy())
            for c in ("row", "count"):
                parts[c].append(b.column(c).flatten().to_numpy())
        joined = lambda x: np.concatenate(x) if x else np.zeros(0, np.int32)
        row, count, y, lengths = joined(parts.pop("row")), joined(parts.pop("count")), joined(parts.pop("label")), joined(lengths)
        bags = Bags(np.repeat(np.arange(len(y), dtype=np.int32), lengths), row, count, y.astype(np.int64))
        del row, count
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(calibrated(bags, prior))], pa.binary())], ["model"])

    return run


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, label: str = "toxic") -> Model:
    """Fits on at most about per_label rows of each label that are not held out, with their whole texts: executors
    turn each into its bag, of BUCKETS numbers at most, and one task fits on the bags without the n-grams that are
    not learnt from.  Neither texts nor bags reach the driver, only the model does."""
    spark = docs.sparkSession
    own = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("label"))
    rows = docs.select("doc_id").where(~chars.held_out()).distinct().join(own, "doc_id")
    share = rows.agg(F.avg("label").alias("p")).first()["p"]
    T.small_batches(spark)
    chosen = chars.picked(rows, "label", per_label, docs)
    if chosen is None:
        return calibrated(Bags.listed([], []), 0.5)
    table = Work(spark, "toxicity").table(chosen.withColumn("place", F.xxhash64("text")).transform(T.mapped, _bags, BAG), "bags")
    held = table.select(F.explode("row").alias("row")).groupBy("row").agg(F.count("*").alias("n")).toArrow()  # BUCKETS rows at most
    texts = np.zeros(BUCKETS, np.int64)
    texts[held.column("row").to_numpy()] = held.column("n").to_numpy()
    sent = spark.sparkContext.broadcast(told(texts, table.count()))
    bags = table.transform(T.mapped, _without(sent), BAG).repartition(1).sortWithinPartitions("doc_id", "place")
    model = pickle.loads(bags.select("label", "row", "count").transform(T.mapped, _trainer(share or 0.5), "model binary").collect()[0]["model"])
    sent.destroy()
    return model


def _scorer(sent):
    def run(batches):
        model = sent.value
        for b in T.slices(batches, 4 << 20):
            s = model.scores([x or "" for x in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64())], [*b.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    T.small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers
    rows = docs.select("doc_id", chars.held_out().alias("held_out"), "text")
    return rows.transform(T.mapped, _scorer(sent), "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows that score below the threshold, all columns kept, in one narrow pass."""
    T.small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    cols = docs.columns
    keyed = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"))

    def run(batches):
        for b in T.slices(batches, 4 << 20):
            yield b.filter(pa.array(sent.value.scores([x or "" for x in b.column("text").to_pylist()]) < threshold))

    return keyed.transform(T.mapped, run, keyed.schema).select(*[F.col(f"_row.`{c}`").alias(c) for c in cols])
