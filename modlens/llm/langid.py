"""Language identification by interpolated Kneser-Ney character models.

Every language has a model of character n-grams up to ORDER (letters folded to lower case,
everything else one space).  The n-grams of all languages stand in one sorted array of
64-bit hashes for each order, with a column of log probabilities for each language; a
second sorted array has the back-off weights of the contexts.  A text goes to the language
of the lowest cross-entropy per character.

score is the calibrated chance that this is right, from the lead over the second language;
`rejected` tells that the text fits none of the languages (its cross-entropy lies beyond
what all but 1 in 1000 texts of that language have) or that score is under 0.5.

Defined results: null text and text without letters give `und` with score 0; without any
labelled rows every text is `und`; with one language its score is 1; repeated rows are
predicted alike; equal cross-entropies go to the first language by name; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import chars, textops as T
from .work import Work

ORDER = 4
PER_LANG = 500
PIECE_CHARS = 1 << 20
_U = np.uint64


def _steps(codes: np.ndarray):
    """Hashes of the n-grams that end at each place, for n = 0 to ORDER; a place has them from n - 1 on."""
    c = codes.astype(_U) + _U(1)
    h = [np.zeros(len(c), _U), T.mix(c)]
    for n in range(2, ORDER + 1):
        h.append(T.mix(h[-1][:-1] * _U(T._B) + c[n - 1 :]))  # of the n - 1 before, then this one
    return h


def _find(keys: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Places in sorted keys, or -1."""
    if not len(keys):
        return np.full(len(want), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return np.where(keys[at] == want, at, -1)


class Model:
    """langs; for each order the n-grams' keys and log probabilities, the contexts' keys and log weights."""

    def __init__(self, langs, grams, logp, contexts, weight, floor):
        self.langs, self.grams, self.logp, self.contexts, self.weight, self.floor = langs, grams, logp, contexts, weight, floor
        self.slope, self.shift, self.limit = 1.0, 0.0, np.full(len(langs), np.inf)

    def costs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(nats per character of each text under each language, characters of each text)."""
        codes, first = chars.folded(texts)
        lead = np.zeros(len(codes), bool)
        lead[first[:-1]] = True
        text = np.cumsum(lead) - 1
        place = np.arange(len(codes)) - first[text]
        total = np.zeros((len(texts), len(self.langs)))
        steps = _steps(codes)
        todo = np.flatnonzero(place > 0)  # the leading space is given, not scored
        back = np.zeros((len(todo), len(self.langs)), np.float32)
        for n in range(ORDER, 0, -1):
            full = place[todo] >= n - 1
            key = np.zeros(len(todo), _U)
            key[full] = steps[n][todo[full] - n + 1]
            at = np.where(full, _find(self.grams[n], key), -1)
            got = at >= 0
            self._add(total, text[todo[got]], self.logp[n][at[got]] + back[got])
            miss = ~got
            todo, back, full = todo[miss], back[miss], full[miss]
            if len(todo):
                context = np.zeros(len(todo), _U)  # the empty one for n = 1
                context[full] = steps[n - 1][todo[full] - n + 1]
                c = np.where(full, _find(self.contexts[n], context), -1)
                back[c >= 0] += self.weight[n][c[c >= 0]]
        self._add(total, text[todo], self.floor + back)
        n_chars = np.diff(first) - 1
        return -total / np.maximum(n_chars, 1)[:, None], n_chars

    @staticmethod
    def _add(total, text, values):
        if not len(text):
            return
        cut = np.flatnonzero(np.diff(text, prepend=-1))
        total[text[cut]] += np.add.reduceat(values, cut, axis=0, dtype=np.float64)

    def predict(self, texts: list[str]):
        """For each text (lang, score, rejected)."""
        if not self.langs:
            return [("und", 0.0, True)] * len(texts)
        cost, n = self.all_costs(texts)
        best = cost.argmin(1)
        lead = self.lead(cost)
        score = 1 / (1 + np.exp(-np.clip(self.slope * lead + self.shift, -30, 30))) if len(self.langs) > 1 else np.ones(len(texts))
        low = cost[np.arange(len(texts)), best]
        odd = (low > self.limit[best]) | (score < 0.5)
        return [(self.langs[b], float(s), bool(o)) if k > 0 else ("und", 0.0, True) for b, s, o, k in zip(best, score, odd, n, strict=True)]

    def all_costs(self, texts: list[str], limit: int = 1 << 19):
        """costs() in pieces of bounded size; a very long text is cut at spaces and its pieces are summed."""
        sizes = np.array([0, *map(len, texts)]).cumsum()
        costs, ns = [], []
        for i, j in T.groups_by_bytes(sizes, limit):
            if j - i > 1 or len(texts[i]) <= 2 * limit:
                c, n = self.costs(texts[i:j])
            else:
                pieces, at, t = [], 0, texts[i]
                while at < len(t):
                    to = t.find(" ", at + limit)
                    to = len(t) if to < 0 else to
                    pieces.append(t[at:to])
                    at = to
                parts = [self.costs([p]) for p in pieces]
                n = np.sum([m for _, m in parts], 0)
                c = np.sum([x * m[:, None] for x, m in parts], 0) / np.maximum(n, 1)[:, None]
            costs.append(c)
            ns.append(n)
        return (np.concatenate(costs), np.concatenate(ns)) if costs else (np.zeros((0, len(self.langs))), np.zeros(0, int))

    @staticmethod
    def lead(cost: np.ndarray) -> np.ndarray:
        if cost.shape[1] < 2:
            return np.zeros(len(cost))
        two = np.partition(cost, 1, axis=1)
        return two[:, 1] - two[:, 0]


COUNTS = "lang string, n int, key long, context long, suffix long, count long"


def ngrams(texts: list[str]) -> dict[int, tuple]:
    """For each order the n-grams of the texts: (sorted keys, counts, keys of what stands before the last character,
    keys of what stands behind the first)."""
    codes, first = chars.folded(texts)
    steps = _steps(codes)
    lead = np.zeros(len(codes), bool)
    lead[first[:-1]] = True
    place = np.arange(len(codes)) - first[np.cumsum(lead) - 1]
    own = {}
    for n in range(1, ORDER + 1):
        end = np.flatnonzero(place >= max(n - 1, 1))
        keys, at, count = np.unique(steps[n][end - n + 1], return_index=True, return_counts=True)
        end = end[at]
        none = np.zeros(len(end), _U)
        own[n] = keys, count, steps[n - 1][end - n + 1] if n > 1 else none, steps[n - 1][end - n + 2] if n > 1 else none
    return own


def _pieces(text: str, limit: int = PIECE_CHARS) -> list[str]:
    """A very long text in pieces cut at spaces."""
    out, at = [], 0
    while len(text) - at > limit and (to := text.find(" ", at + limit)) >= 0:
        out.append(text[at:to])
        at = to
    return [*out, text[at:]]


def _counts(batches):
    """Counts of the whole texts of a batch, one row for each n-gram of a language."""
    types = [pa.string(), pa.int32(), *[pa.int64()] * 4]
    for b in T.slices(batches, 2 << 20):
        by: dict[str, list[str]] = {}
        for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
            by.setdefault(lang, []).extend(_pieces(text or ""))
        for lang, texts in by.items():
            for n, (key, count, context, suffix) in ngrams(texts).items():
                if len(key):
                    cols = [pa.array([lang] * len(key)), pa.array(np.full(len(key), n, np.int32)), *[pa.array(x.view(np.int64)) for x in (key, context, suffix)], pa.array(count)]
                    yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in COUNTS.split(", ")])


def _raw(langs: list[str], seen: list[dict[int, tuple]]) -> Model:
    """Kneser-Ney by orders from the lowest up; seen has what ngrams() gives, for each language."""
    n_langs = len(langs)
    grams, logp, contexts, weight = {}, {}, {}, {}
    vocab = len(np.unique(np.concatenate([s[1][0] for s in seen]))) + 1
    floor = np.full(n_langs, -np.log(vocab), np.float32)
    lower = None
    for n in range(1, ORDER + 1):
        keys, at = np.unique(np.concatenate([s[n][0] for s in seen]), return_index=True)
        ctx_of = np.concatenate([s[n][2] for s in seen])[at]
        suffix = np.concatenate([s[n][3] for s in seen])[at]
        contexts[n] = np.unique(ctx_of)
        p = np.empty((len(keys), n_langs))
        w = np.ones((len(contexts[n]), n_langs))
        at_ctx = np.searchsorted(contexts[n], ctx_of)
        below = np.full((len(keys), n_langs), 1 / vocab) if n == 1 else lower[np.maximum(_find(grams[n - 1], suffix), 0)]
        for i, s in enumerate(seen):
            own, count = s[n][0], s[n][1].astype(float)
            if n < ORDER:  # how many different characters stand in front
                up = np.searchsorted(own, s[n + 1][3])
                up = up[(up < len(own)) & (own[np.minimum(up, len(own) - 1)] == s[n + 1][3])]
                more = np.bincount(up, minlength=len(own)).astype(float)
                count = np.where(more > 0, more, 1.0)
            once, twice = (count == 1).sum(), (count == 2).sum()
            d = once / (once + 2 * twice) if once else 0.5
            c = np.zeros(len(keys))
            c[np.searchsorted(keys, own)] = count
            sums = np.bincount(at_ctx, c, minlength=len(w))
            kinds = np.bincount(at_ctx, c > 0, minlength=len(w))
            known = sums > 0
            w[known, i] = d * kinds[known] / sums[known]
            p[:, i] = np.where(known[at_ctx], np.maximum(c - d, 0) / np.maximum(sums, 1)[at_ctx], 0) + w[at_ctx, i] * below[:, i]
        grams[n], lower = keys, p
        logp[n], weight[n] = np.log(np.maximum(p, 1e-12)).astype(np.float32), np.log(np.maximum(w, 1e-12)).astype(np.float32)
    return Model(langs, grams, logp, contexts, weight, floor)


def fit(rows: list[tuple[str, str]]) -> Model:
    """rows of (text, lang).  A fifth of each language's rows is kept for calibration."""
    by: dict[str, list[str]] = {}
    for text, lang in rows:
        by.setdefault(lang, []).append(text)
    langs = sorted(by)
    if not langs:
        return Model([], {}, {}, {}, {}, np.zeros(0))
    kept = {k: v[::5] if len(v) >= 10 else [] for k, v in by.items()}
    model = _raw(langs, [ngrams([t for i, t in enumerate(by[k]) if i % 5 or len(by[k]) < 10]) for k in langs])
    texts, truth = [t for k in langs for t in kept[k]], np.array([i for i, k in enumerate(langs) for _ in kept[k]])
    return calibrated(model, *model.all_costs(texts), truth) if len(texts) else model


def calibrated(model: Model, cost: np.ndarray, n: np.ndarray, truth: np.ndarray) -> Model:
    """The chance of being right by the lead, and the limits of rejection, from texts that were not learnt from."""
    langs = model.langs
    if len(truth) < 5 or len(langs) < 2:
        return model
    ok = n > 0
    cost, truth = cost[ok], truth[ok]
    best, lead = cost.argmin(1), model.lead(cost)
    right = (best == truth).astype(float)
    x = lead / (lead.std() or 1)
    a, b = 1.0, 0.0
    for _ in range(50):  # logistic regression with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, h = p - (right * len(x) + 0.5) / (len(x) + 1), p * (1 - p) + 1e-6
        ga, gb = (g * x).sum() + 0.1 * a, g.sum() + 0.1 * b
        haa, hab, hbb = (h * x * x).sum() + 0.1, (h * x).sum(), h.sum() + 0.1
        det = haa * hbb - hab * hab
        a, b = a - (hbb * ga - hab * gb) / det, b - (haa * gb - hab * ga) / det
    model.slope, model.shift = max(a, 0.0) / (lead.std() or 1), b
    for i in range(len(langs)):
        own = np.sort(cost[truth == i, i])
        if len(own):
            model.limit[i] = own[min(len(own) - 1, int(0.999 * len(own)))] * 1.25
    return model


COSTS = "lang string, n long, cost array<double>"


def train(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """Fits on the whole texts of about per_lang rows of each language that are not held out.  Executors count their
    n-grams, and score the fifth of them that is kept for calibration: no text reaches the driver."""
    spark = docs.sparkSession
    T.small_batches(spark)
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~chars.held_out())
    chosen = chars.picked(rows, "lang", per_lang)
    if chosen is None:
        return fit([])
    chosen = Work(spark, "langid").table(chosen, "sample")
    sizes = {r["lang"]: r["count"] for r in chosen.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    few = [k for k in langs if sizes[k] < 10]  # too few to keep some back
    kept = (F.pmod(F.xxhash64("doc_id", F.lit("kept")), F.lit(5)) == 0) & ~F.col("lang").isin(few)
    counted = chosen.where(~kept).transform(T.mapped, _counts, COUNTS).groupBy("lang", "n", "key").agg(F.min("context").alias("context"), F.min("suffix").alias("suffix"), F.sum("count").alias("count")).toArrow()
    lang, order = counted.column("lang").to_numpy(), counted.column("n").to_numpy()
    cols = [counted.column(c).to_numpy() for c in ("key", "count", "context", "suffix")]
    seen = []
    for k in langs:
        own = {}
        for n in range(1, ORDER + 1):
            at = np.flatnonzero((lang == k) & (order == n))
            key, count, context, suffix = (np.ascontiguousarray(c[at]) for c in cols)
            key = key.view(_U)
            by_key = np.argsort(key)
            own[n] = key[by_key], count[by_key], context.view(_U)[by_key], suffix.view(_U)[by_key]
        seen.append(own)
    model = _raw(langs, seen)
    sent = spark.sparkContext.broadcast(model)

    def costs(batches):
        for b in T.slices(batches, 2 << 20):
            cost, n = sent.value.all_costs(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(np.asarray(n, np.int64)), pa.array(list(cost), pa.list_(pa.float64()))], ["lang", "n", "cost"])

    got = chosen.where(kept).transform(T.mapped, costs, COSTS).toArrow()
    sent.destroy()
    if not got.num_rows:
        return model
    truth = np.searchsorted(langs, got.column("lang").to_pylist())
    return calibrated(model, np.array(got.column("cost").to_pylist()).reshape(-1, len(langs)), got.column("n").to_numpy(), truth)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every row."""
    spark = docs.sparkSession
    T.small_batches(spark)
    sent = spark.sparkContext.broadcast(model)  # bounded by the training sample

    def run(batches):
        for b in T.slices(batches, 2 << 20):
            got = sent.value.predict([x or "" for x in b.column("text").to_pylist()])
            lang, score, odd = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(odd, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", chars.held_out().alias("held_out"), "text").transform(T.mapped, run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
