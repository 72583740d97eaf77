"""Each operator against a brute-force version, over small tables with every odd row that can come."""

from __future__ import annotations

import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from modlens.llm import bm25, bpe, chars, chat, decontam, langid, linededup, neardup, substrings, textops, toxicity, warc
from modlens.llm.work import Work

DOCS = "doc_id long, text string, lang string, source string, n_chars long, th string, _row string, _id string, node string"
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def words(s):
    return ALNUM.findall(low(s or ""))


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def corpus():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeéüñ") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    texts = [make(rng.randint(30, 120)) for _ in range(25)]
    base = make(150)
    near = [" ".join(w if rng.random() > 0.01 else "changed" for w in base.split()) for _ in range(12)]
    shared = make(60)
    texts += [base, base, *near, make(20) + " " + shared + "\n" + make(30), shared, make(5) + "\n" + shared]
    line = make(12)
    texts += [f"{make(8)}\n{line}\n{make(9)}", f"{line[:-1]}x\n{make(9)}", f"{line}\n\n{line}", line + "zz", line[3:]]
    texts += [None, "", " ", "\n\n", "!!!", "...", "word", "two words", "one two three four", "漢字 🙂 " * 20, "x" * 5000, "a b " * 3000, "tab\tsep\x0bvt\x0cff\rcr nbsp", "  ﻿ x"]
    rows = [(i, t, "en", "s", len(t or ""), "t", "r", "i", "n") for i, t in enumerate(texts)]
    rows += [rows[0], rows[3], (None, texts[1], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), (10_001, texts[2], "en", "s", 1, "", "", "", "")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def key(i):
    return (1 << 62) if i is None else i


# --- kernels


def test_words_cross_pieces(monkeypatch):
    texts = ["ab cd" * 50, "", None, "x" * 300 + " y", "é漢 z", " lead"]
    import pyarrow as pa

    data, off = textops.column(pa.array(texts))
    want = textops.words(data, off)
    monkeypatch.setattr(textops, "PIECE", 16)
    got = textops.words(data, off)
    assert all((a == b).all() for a, b in zip(want, got, strict=True))
    spelt = [bytes(data[s:e]).decode() for s, e in zip(got[0], got[1], strict=True)]
    assert spelt == [w for t in texts for w in ALNUM.findall(t or "")]


def test_windows_match_equal_sequences():
    h = textops.mix(np.array([1, 2, 3, 1, 2, 3, 4, 1, 2], np.uint64))
    for n in (1, 2, 3, 5, 8, 9, 10):
        w = textops.windows(h, n)
        seq = [tuple(h[i : i + n]) for i in range(len(h) - n + 1)]
        assert len(w) == len(seq)
        assert [[a == b for a in w] for b in w] == [[a == b for a in seq] for b in seq]


# --- 1 chat


def test_chat(spark):
    import public_tokenizers as p

    odd = ["", None, "plain", "<turn>x", "a</turn>\n<turn>assistant<text>b", "\\", "<\\/turn>", "<|endoftext|>", "\n\n", "漢 🙂", "### Assistant: </turn> ok"]
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "<text>"]), rng.choice(odd), "x") for c in [1, 2, 3, None] for t in [0, 1, 1, 2, 3, None]]
    rows += [rows[0], (4, 0, "assistant", "long " * 300_000, "x"), (4, 1, "assistant", "end", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string")
    for size in (chat.PIECE_CHARS, 30):
        got = {r["conv_id"]: r for r in chat.digests(chat.render_conversations(df, p.path("byte_bpe_50k.json"), size)).collect()}
        by = {}
        first = lambda x: (x is not None, x)
        for c, t, r, x, _ in sorted(rows, key=lambda r: (first(r[0]), first(r[1]), first(r[2]), first(r[3])) if all(v is not None for v in r) else tuple((v is not None, v or 0 if not isinstance(v, str) else v) for v in r[:4])):
            by.setdefault(c, []).append((r or "", x or ""))
        assert set(got) == set(by)
        for c, turns in by.items():
            loss = "".join(x for r, x in turns if r == "assistant")
            assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns))), c
            assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), sha(loss))
            assert got[c]["formatted_chars"] == len(chat.render(turns)[0])
    assert chat.digests(chat.render_conversations(df.limit(0), p.path("byte_bpe_50k.json"))).count() == 0


# --- 2 search


def brute_bm25(rows, top):
    docs = [(i, Counter(words(t))) for i, t, *_ in rows]
    n, avg = len(docs), sum(sum(c.values()) for _, c in docs) / len(docs)
    df = Counter(w for _, c in docs for w in c)
    idf = {w: np.log(1 + (n - k + 0.5) / (k + 0.5)) for w, k in df.items()}
    out = {}
    for q, qc in docs:
        if q is None or q % 5:
            continue
        s = []
        for i, c in docs:
            length = sum(c.values())
            v = sum(qn * idf[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * length / avg)) for w, qn in qc.items() if w in c)
            if v > 0:
                s.append((-round(v, 7), -1 if i is None else i))
        out.setdefault(q, []).extend(sorted(s)[:top])
    return out


def test_bm25(docs, none, rows, monkeypatch):
    distinct = docs.where("doc_id % 5 = 0").dropDuplicates(["doc_id"])
    want = brute_bm25(rows, 6)
    for size, shard, per, seeds in ((1 << 24, 1 << 22, 32, 2000), (2000, 3000, 2, 12), (1 << 24, 20_000, 1, 5)):
        for name, value in (("SHARD_BYTES", shard), ("BLOCK_DOCS", per), ("SEEDS", seeds)):
            monkeypatch.setattr(bm25, name, value)
        got = {}
        for r in bm25.search(docs, distinct, top=6, query_bytes=size).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((-round(r["score"], 7), -1 if r["doc_id"] is None else r["doc_id"]))
        assert got == {q: s[:6] for q, s in want.items() if s}
    assert bm25.search(none, none).count() == 0


def test_bm25_of_many_queries(docs, none, rows, monkeypatch):
    """Queries searched together: the same hits, whatever the groups, tiles, shards and the share of dense terms."""
    distinct = docs.where("doc_id % 5 = 0").dropDuplicates(["doc_id"])
    want = brute_bm25(rows, 6)
    monkeypatch.setattr(bm25, "FEW", 0)
    for size, shard, group, tile, dense, added, seeds in ((1 << 24, 1 << 24, 1024, 2048, 0.002, 1 << 16, 2000), (3000, 3000, 3, 5, 0.2, 10, 5), (1 << 24, 9000, 4, 7, 2.0, 50, 2), (1 << 24, 1 << 24, 5, 3, 0.0, 9, 12)):
        for name, value in (("GATHERED", shard), ("GROUP", group), ("TILE_DOCS", tile), ("DENSE", dense), ("ADDED", added), ("SEEDS", seeds), ("GROWTH", 2)):
            monkeypatch.setattr(bm25, name, value)
        got = {}
        for r in bm25.search(docs, distinct, top=6, query_bytes=size).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((-round(r["score"], 7), -1 if r["doc_id"] is None else r["doc_id"]))
        assert got == {q: s[:6] for q, s in want.items() if s}
    assert bm25.search(none, none).count() == 0


@pytest.mark.parametrize("few", [0, 32])
def test_bm25_ties_by_number(spark, monkeypatch, few):
    """Scores that differ only by the order of their sums are ties, also where the best are cut off."""
    monkeypatch.setattr(bm25, "FEW", few)
    name = lambda k, j: f"t{k}x{j}"
    texts = {0: " ".join(name(k, j) for k in range(40) for j in range(12))}
    texts |= {k + 1: " ".join(name(k, j) for j in range(12)) for k in range(40)}  # equal scores, of other terms
    for j in range(12):
        texts |= {1000 + 20 * j + m: " ".join(name(k, j) for k in range(40)) for m in range(j + 1)}  # make a term's number of documents follow j
    df = spark.createDataFrame([(i, t) for i, t in sorted(texts.items(), reverse=True)], "doc_id long, text string").coalesce(1)
    got = [r["doc_id"] for r in bm25.search(df, df.where("doc_id = 0"), top=100).orderBy("rank").collect()]
    assert len(got) == 100 and [i for i in got if 0 < i < 1000] == list(range(1, 22))


def test_groups_and_tiles_are_of_one_kind(monkeypatch):
    """Texts of three languages and unequal lengths in turn: groups and tiles do not mix them, so most pairs need few dense terms."""
    rng = random.Random(3)
    vocab = [[f"{c}{i}" for i in range(3000)] for c in "abc"]
    texts = []
    for k in range(1500):
        n = 40 * (1 + k % 5)
        texts.append([vocab[k % 3][int(300 * rng.random() ** 4)] for _ in range(n)] + rng.choices(vocab[k % 3], k=n))
    terms = [np.unique(np.array([hash_(w) for w in t], np.uint64), return_counts=True) for t in texts]
    rows = [(i, t.tobytes(), c.astype(np.int32).tobytes()) for i, (t, c) in enumerate(terms)]
    q = bm25.Queries(rows[::4])
    df = Counter(x for t, _ in terms for x in t.tolist())
    words = np.array([len(t) for t in texts])
    q.idf, q.avg = np.array([np.log(1 + (1500 - df[x] + 0.5) / (df[x] + 0.5)) for x in q.vocab.tolist()]), words.mean()
    for name, value in (("GROUP", 100), ("TILE_DOCS", 256), ("DENSE", 0.001)):
        monkeypatch.setattr(bm25, name, value)
    together, work = bm25.Together(q, 5), []
    scores = together._scores

    def counted(row, own, count, first, size, *rest):
        m, n = rest[-2:]
        pairs = np.bincount(row, minlength=len(first)) * size
        work.append(np.minimum(pairs / bm25.DENSE, m * n).sum())  # the cheaper way for each term, in multiplications
        return scores(row, own, count, first, size, *rest)

    monkeypatch.setattr(together, "_scores", counted)
    together.search(np.arange(1500), words, np.concatenate([t for t, _ in terms]), np.array([len(t) for t, _ in terms]), np.concatenate([c for _, c in terms]).astype(np.int32))
    a, d, s = together.hits
    assert bm25.Together(q, 5).term is together.term  # a worker's next task makes nothing anew
    for i in range(0, len(q.ids), 25):
        own = dict(zip(q.vocab[q.term[i]].tolist(), q.count[i].tolist(), strict=True))
        idf = dict(zip(q.vocab.tolist(), q.idf.tolist(), strict=True))
        every = [(-sum(n * idf[x] * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * w / q.avg)) for x, c in zip(t.tolist(), k.tolist(), strict=True) if (n := own.get(x))), j) for j, ((t, k), w) in enumerate(zip(terms, words.tolist(), strict=True))]
        assert d[a == i].tolist() == [j for _, j in sorted((round(v, 9), j) for v, j in every if v < 0)[:5]]
    assert sum(work) < 1000 * len(q.ids) * 1500


def test_blocks_are_skipped():
    """Documents of several languages in turn: like ones come together, most blocks stay closed, scores are exact."""
    rng = random.Random(2)
    vocab = [[f"{c}{i}" for i in range(400)] for c in "abcd"]
    texts = [rng.sample(vocab[k % 4][:30], 20) + rng.choices(vocab[k % 4], k=40) for k in range(800)]
    terms = [np.unique(np.array([hash_(w) for w in t], np.uint64), return_counts=True) for t in texts]
    rows = [(i, t.tobytes(), c.astype(np.int32).tobytes()) for i, (t, c) in enumerate(terms)]
    q = bm25.Queries(rows[::15])
    df = Counter(x for t, _ in terms for x in t.tolist())
    q.idf, q.avg = np.array([np.log(1 + (800 - df[x] + 0.5) / (df[x] + 0.5)) for x in q.vocab.tolist()]), 60.0
    shard = bm25.Shard(q, np.arange(800), np.full(800, 60), [t for _, t, _ in rows], [c for *_, c in rows])
    for i in range(len(q.ids)):
        doc, score = shard.search(q.term[i], q.count[i], -np.inf, 5)
        got = sorted(zip((-score).round(9).tolist(), shard.ids[doc].tolist(), strict=True))[:5]
        own = dict(zip(q.vocab[q.term[i]].tolist(), q.count[i].tolist(), strict=True))
        idf = dict(zip(q.vocab.tolist(), q.idf.tolist(), strict=True))
        every = [(-sum(n * idf[x] * c * 2.2 / (c + 1.2) for x, c in zip(t.tolist(), k.tolist(), strict=True) if (n := own.get(x))), d) for d, (t, k) in enumerate(terms)]
        want = sorted((round(s, 9), d) for s, d in every if s < 0)[:5]
        assert [d for _, d in got] == [d for _, d in want] and np.allclose([s for s, _ in got], [s for s, _ in want])
    assert shard.opened < 0.6 * shard.blocks * len(q.ids)


def hash_(w):
    return int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")


# --- 3 lines


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_distance():
    rng = random.Random(2)
    for _ in range(3000):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(0, 12)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "c"])
        b = "".join(b)
        for most in (1, 2, 3):
            assert linededup.distance(a, b, most) == min(lev(a, b), most + 1)


def test_line_dedup(docs, none, rows):
    least = 20
    lines = [(key(i), n, x) for i, t, *_ in rows if t is not None for n, x in enumerate(t.split("\n")) if x.strip(" \t\n\x0b\x0c\r")]
    first = {}
    for i, n, x in lines:
        first[x] = min(first.get(x, (i, n)), (i, n))
    long_ = [x for x in first if len(x) >= least]
    near = {x: [y for y in long_ if y != x and abs(len(x) - len(y)) <= 2 and len(x) < 500 and lev(x, y) <= 2] for x in long_}
    assert any(near.values())
    gone, degree = {}, Counter()
    for i, n, x in set(lines):
        if (i, n) > min([first[x], *[first[y] for y in near.get(x, [])]]):
            gone.setdefault(i, set()).add(n)
    for i, t, *_ in rows:
        degree[key(i), t] = sum(len(near.get(x, [])) for x in (t or "").split("\n"))
    got = linededup.dedup(docs, least=least).collect()
    assert len(got) == len(rows)
    want = sorted(((key(i), 0 if t is None else t.count("\n") + 1, "" if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(key(i), ()))) for i, t, *_ in rows if i is not None), key=repr)
    assert sorted(((key(r["doc_id"]), r["n_lines"], r["kept"] or "") for r in got if r["doc_id"] is not None), key=repr) == want
    assert {(r["doc_id"], r["n_links"]) for r in got if r["n_removed"] == 0 and r["doc_id"] is not None} <= {(i, n) for (i, _), n in degree.items()}
    left = linededup.clean(docs, least=least)
    assert left.columns == docs.columns
    assert linededup.dedup(none).count() == 0 and linededup.clean(none).count() == 0


# --- 4 near duplicates


@pytest.mark.parametrize("hot", [2, 200])
def test_lines_of_one_template(spark, hot):
    """Many lines that share most segments: every link, and few candidates."""
    rng = random.Random(3)
    ids = ["".join(rng.choice("0123456789") for _ in range(30)) for _ in range(600)]
    lines = [f"2024-01-01 GET /item/{i} status ok" for i in ids]
    for t in lines[:40]:  # lines within two edits, at all places
        a, b = rng.randrange(len(t)), rng.randrange(len(t))
        lines += [t[:a] + "~" + t[a + 1 :], t[:a] + t[a + 1 :], t[:a] + "#" + t[a:b] + t[b + 1 :] if a < b else t + "+", t[:b] + "ab" + t[b:]]
    lines = sorted(set(lines))
    docs = spark.createDataFrame([(i, "\n".join(lines[i::7])) for i in range(7)], "doc_id long, text string")
    work = Work(spark, "template")
    occurrences, found = linededup.links(docs, work, hot=hot)
    spelt = {r["line"]: r["text"] for r in occurrences.where("text is not null").collect()}
    got = {(frozenset((spelt[r["a"]], spelt[r["b"]])), r["edits"]) for r in found.collect()}
    want = set()
    for i, x in enumerate(lines):
        for y in lines[i + 1 :]:
            if abs(len(x) - len(y)) <= 2 and (d := linededup.distance(x, y, 2)) <= 2:
                want.add((frozenset((x, y)), d))
    assert got == want and len(want) > 150
    if hot == 200:
        assert spark.read.parquet(f"{work.path}/all_candidates").count() < 6 * len(lines)


def test_near_duplicates(docs, none, rows, monkeypatch):
    grams = lambda w: Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()
    own = [(key(i), words(t), t or "") for i, t, *_ in rows]
    par = list(range(len(own)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a in range(len(own)):
        for b in range(a):
            x, y = own[a][1], own[b][1]
            if not x and not y:
                same = own[a][2] == own[b][2]
            else:
                p, q = grams(x), grams(y)
                m = sum((p & q).values())
                same = bool(x and y) and m / (sum(p.values()) + sum(q.values()) - m) >= 0.8
            if same:
                i, j = find(a), find(b)
                par[max(i, j)] = min(i, j)
    heads = {}
    for k in range(len(own)):
        heads[find(k)] = min(heads.get(find(k), own[k][0]), own[k][0])
    want = sorted({(own[k][0], heads[find(k)]) for k in range(len(own))})
    for leaders, few in ((neardup.LEADERS, neardup.FEW), (2, 1)):
        monkeypatch.setattr(neardup, "FEW", few)
        got = sorted({(key(r["doc_id"]), key(r["class_id"])) for r in neardup.classes(docs, leaders=leaders).collect()})
        assert got == want
    kept = neardup.clean(docs)
    assert kept.columns == docs.columns
    assert sorted(key(r["doc_id"]) for r in kept.collect()) == sorted({h for h in heads.values()})
    assert neardup.classes(none).count() == 0 and neardup.clean(none).count() == 0


def _copies_of_copies(n, seed):
    """(texts, class of each): n copies of copies of one text, one word in each changed twice, and links by brute force."""
    rng = np.random.default_rng(seed)
    texts = [[f"w{i}" for i in rng.choice(10**6, 100, replace=False)]]
    while len(texts) < n:
        own = list(texts[int(rng.integers(max(0, len(texts) - 400), len(texts)))])
        for at in rng.choice(100, 2, replace=False):
            own[at] = f"w{rng.integers(10**6, 10**9)}"
        texts.append(own)
    code = {}
    held = [{code.setdefault(tuple(w[k : k + 5]), len(code)) for k in range(96)} for w in texts]
    par = list(range(n))

    def find(x):
        while par[x] != x:
            par[x] = par[par[x]]
            x = par[x]
        return x

    grams = np.zeros((n, len(code)), np.float32)
    for i, h in enumerate(held):
        grams[i, list(h)] = 1
    common = grams @ grams.T
    size = grams.sum(1)
    for i, j in zip(*np.nonzero(np.triu(common / (size[:, None] + size[None] - common) >= 0.8, 1)), strict=True):
        a, b = find(i), find(j)
        par[max(a, b)] = min(a, b)
    return [" ".join(w) for w in texts], [find(i) for i in range(n)]


@pytest.mark.parametrize(("seed", "leaders", "few"), [(2, neardup.LEADERS, neardup.FEW), (3, 40, 4), (1, neardup.LEADERS, neardup.FEW)])
def test_near_duplicates_of_near_duplicates(spark, monkeypatch, seed, leaders, few):
    monkeypatch.setattr(neardup, "FEW", few)
    texts, want = _copies_of_copies(2000, seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert [r["class_id"] for r in neardup.classes(docs, leaders=leaders).orderBy("doc_id").collect()] == want


def test_align_is_longest_common_subsequence():
    rng = np.random.default_rng(0)
    for _ in range(400):
        x = rng.integers(0, 4, rng.integers(0, 15))
        y = np.delete(x, rng.integers(0, max(len(x), 1), 2) % max(len(x), 1)) if len(x) else x
        p = np.zeros((len(x) + 1, len(y) + 1), int)
        for i in range(len(x)):
            for j in range(len(y)):
                p[i + 1, j + 1] = p[i, j] + 1 if x[i] == y[j] else max(p[i, j + 1], p[i + 1, j])
        assert neardup.align(x, y, 0) == p[-1, -1]


# --- 5 toxicity


def test_toxicity(spark, docs, none):
    rng = random.Random(0)
    make = lambda bad: " ".join(rng.choice(["idiotic", "idiots", "moronic"]) if bad and rng.random() < 0.1 else rng.choice(["calm", "river", "stone", "green", "walks", "under", "house", "bright"]) for _ in range(60))
    rows = [(i, make(i % 3 == 0), "x") for i in range(400)] + [(1000, None, "x"), (1001, "", "x"), (None, "calm", "x"), (0, make(True), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 1) for i in range(400)], "doc_id long, toxic int, quality int")
    model = toxicity.train(df, labels)
    got = toxicity.score(df, model).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert sum((r["doc_id"] % 3 == 0) == bool(r["predicted"]) for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert model.scores(["calm river idioot moronicc " * 3])[0] > model.scores(["calm river stone house " * 3])[0]  # misspelt
    long_ = "calm river idiotic " * 200_000
    assert abs(model.scores([long_])[0] - model.scores([long_[: len(long_) // 2]])[0]) < 0.05
    assert toxicity.clean(docs, model).columns == docs.columns
    assert toxicity.score(none, toxicity.train(none, labels.limit(0))).count() == 0


def test_toxicity_gradients():
    """loss() against a dense softmax, and each gradient against differences."""
    rng = np.random.default_rng(4)
    texts, rows, dim = 7, 11, 5
    dense = rng.random((texts, rows)) * (rng.random((texts, rows)) < 0.6)
    of, row = np.nonzero(dense)
    x, y, weight = dense[of, row], np.array([0, 1, 0, 1, 1, 0, 0]), rng.random(texts)
    params = [rng.normal(size=(rows, dim)), rng.normal(size=(dim, 2)), rng.normal(size=2)]

    def brute(table, soft, bias):
        z = dense @ table @ soft + bias
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        return -(weight * np.log(p[np.arange(texts), y])).sum()

    value, *grads = toxicity.loss(of, row, x, y, weight, *params)
    assert np.isclose(value, brute(*params))
    for k, g in enumerate(grads):
        for at in np.ndindex(g.shape):
            up, down = ([p.copy() for p in params] for _ in range(2))
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            assert np.isclose(g[at], (brute(*up) - brute(*down)) / 2e-6, atol=1e-6)


def test_toxicity_null_labels(spark):
    says = (["kind", "good", "fine", "lovely"], ["awful", "nasty", "vile", "rotten"])
    docs = spark.createDataFrame([(i, f"{says[i % 2][i // 2 % 4]} words") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2 if i % 3 else None) for i in range(200)] + [(None, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels)).where("held_out").collect()
    assert got and all(r["predicted"] == r["doc_id"] % 2 for r in got)


def test_toxicity_learns_from_whole_texts(spark):
    rng = random.Random(1)
    make = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    ends = [["mnrtp", "oklsi", "tunop", "lmkro"], ["zzyzx", "qwvuy", "xqvzw", "wyuqz"]]
    # only the end of a long text tells what it is
    docs = spark.createDataFrame([(i, make(2500) + f" {ends[i % 2][i // 2 % 4]}" * 60) for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    assert min(len(r["text"]) for r in docs.collect()) > 12_000
    model = toxicity.train(docs, labels)
    bad, good = model.scores([" ".join(x) for x in ends[::-1]])
    assert bad > 0.5 > good


def test_toxicity_is_fitted_off_the_driver(spark):
    """The driver's arrays do not follow the bags, and the model is the one that a fit on all bags in order gives."""
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(4000)]
    rows = [(i, " ".join(rng.choice(vocab[i % 2 * 500 :]) for _ in range(1200))) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(500)], "doc_id long, toxic int")
    tracemalloc.start()
    model = toxicity.train(docs, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    own = sorted(r["doc_id"] for r in docs.where(~chars.held_out()).collect())
    bags = [toxicity._bag_of(rows[i][1]) for i in own]
    kept = toxicity.told(np.bincount(np.concatenate([r for r, _ in bags]), minlength=toxicity.BUCKETS), len(bags))
    bags = toxicity.Bags.listed([(r[kept[r]], c[kept[r]]) for r, c in bags], [i % 2 for i in own])
    alike = toxicity.calibrated(bags, np.mean(bags.y))
    assert len(bags.of) > 2_000_000 and peak < len(bags.of) * 8 and (model.used == alike.used).all()
    assert np.allclose(model.weights, alike.weights) and np.isclose(model.bias, alike.bias)


# --- 6 WARC


def test_warc(spark):
    rng = random.Random(3)
    big = "".join(rng.choice("abcé\r\n") for _ in range(90_000))
    rows = [(1, "http://a/\r\nX: y", "<p>" + "a" * 200, "z"), (2, None, "<p>" + "a" * 200, "z"), (3, "u", None, "z"), (4, "u", "", "z"), (5, "u", "short", "z"), (6, "u", "short", "z"), (7, "u", big, "z"), (8, "u", big, "z"), (8, "u", big, "z"), (9, "u", "WARC/1.1\r\n\r\n0\r\n\r\n" * 40, "z"), (None, "u", "<p>" + "a" * 200, "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = sorted(((r["page_id"] is None, r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or 0) for r in warc.round_trip(df).collect()))
    want, seen = [], {}
    for i, _, h, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        p = h or ""
        n = len(p.encode())
        back = seen.get(p) if n >= 100 else None
        want.append((i is None, i or 0, n, sha(p), "revisit" if back else "response", back or 0))
        seen.setdefault(p, i)
    assert got == sorted(want)
    assert warc.round_trip(df.limit(0)).count() == 0
    work = Work(spark, "warc-test")
    # names follow from the rows: from a shuffled input in another order, and with equal page_ids of other urls
    more = df.unionByName(df.limit(0)).unionByName(spark.createDataFrame([(11, u, "<p>" + "b" * n, "z") for n in (300, 5) for u in ("u", "v", "u", None)], df.schema))
    names = []
    for k in (3, 5):
        warc.write(more.repartition(k, "html"), f"{work.path}/n{k}")
        names.append(sorted(r[0] for r in warc.read(spark, f"{work.path}/n{k}").select("record_id").collect()))
    assert names[0] == names[1] and len(set(names[0])) == len(names[0]) == len(rows) + 8
    warc.write(df, f"{work.path}/a")
    read = warc.read(spark, f"{work.path}/a").where("record_type = 'response'").collect()
    assert big in {bytes(r["payload"]).decode() for r in read} and all(r["complete"] for r in read)
    assert warc.unchunked(warc.chunked(b"abc" * 5000)) == b"abc" * 5000 and warc.unchunked(b"5\r\nab") is None
    import zlib

    two = b"".join(zlib.compress(x, wbits=31) for x in (b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n", b"WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"))
    assert [b for _, b in warc.parse(two)] == [b"ab", b""]


# --- 7 BPE


def test_bpe(docs, none, rows):
    import public_tokenizers as p
    import tiktoken

    path = p.path("byte_bpe_50k.tiktoken")
    e = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = sorted((key(i), len(x := e.encode_ordinary(t or "")), sha(" ".join(map(str, x))), sha(t or "")) for i, t, *_ in rows)
    assert sorted((key(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(docs, path, p.PATTERN).collect()) == want
    enc = bpe.encode(docs, path, p.PATTERN, offsets=True)
    text = {key(i): t or "" for i, t, *_ in rows}
    for r in enc.collect():
        t = text[key(r["doc_id"])] if r["doc_id"] is not None else None
        if t is not None:
            assert r["ids"] == e.encode_ordinary(t) and len(r["starts"]) == len(r["ids"])
            assert all(0 <= a <= b <= len(t) for a, b in zip(r["starts"], r["ends"], strict=True))
    assert sorted((key(r["doc_id"]), r["text"]) for r in bpe.decode(bpe.encode(docs, path), path).collect()) == sorted((key(i), t or "") for i, t, *_ in rows)
    assert bpe.round_trip(none, path).count() == 0
    codec = bpe.Codec(*(lambda r: (r, bpe._merges(r)))(bpe.read_ranks(path)), p.PATTERN)
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "é", "'s", "1", "!", "<|endoftext|>", "漢", "🙂", "\x1c", "\x85", "​", "word"]
    odd = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    got = bpe.Units(codec, cache=500).of(odd)
    assert got == [e.encode_ordinary(t) for t in odd] == codec.encode(odd)
    assert [codec.decode_bytes(x) for x in got] == [t.encode() for t in odd]
    for t, ids, own in zip(odd, got, codec.tok.encode_batch(odd, add_special_tokens=False), strict=True):
        assert list(zip(*(x.tolist() for x in bpe.char_spans(t, codec.sizes[ids])), strict=True)) == own.offsets
    assert sorted(b for x in codec.bytes_of if x and len(x) == 1 for b in x) == list(range(256))
    parts_of_one = codec.encode(["漢🙂"])[0]  # decoded token by token some are no characters
    assert any("\ufffd" in codec.decode([i]) for i in parts_of_one) and codec.decode(parts_of_one) == "漢🙂"


# --- 8 language


def test_language(spark, none):
    rng = random.Random(4)
    sound = {"aa": "la ti mo ra ne", "bb": "schu ker ung tz ach", "cc": "ção nho lha que eiro"}
    make = lambda k, n: " ".join("".join(rng.choice(sound[k].split()) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, make(k, 40), k, "x") for i, k in enumerate(rng.choice("abc") * 2 for _ in range(400))]
    odd = [(900, None, "aa", "x"), (901, "", None, "x"), (902, "12 !!", "aa", "x"), (903, make("bb", 200_000), None, "x"), (None, make("cc", 30), "aa", "x")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    got = langid.predict(df, langid.train(df)).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {i: k for i, _, k, _ in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert by[900] == by[901] == by[902] == "und" and by[903] == "bb" and by[None] == "cc"
    assert langid.predict(none, langid.train(none)).count() == 0
    assert langid.fit([]).predict(["x"]) == [("und", 0.0, True)]


class BruteKneserNey:
    """Interpolated Kneser-Ney over dictionaries, one language at a time."""

    def __init__(self, texts, vocab, order):
        from modlens.llm import chars

        self.vocab, self.order, self.of = vocab, order, lambda t: tuple(chars.folded([t])[0].tolist())
        raw = {n: Counter(c[i - n + 1 : i + 1] for c in map(self.of, texts) for i in range(max(n - 1, 1), len(c))) for n in range(1, order + 1)}
        self.count, self.off, self.sums, self.kinds = {}, {}, {}, {}
        for n in range(1, order + 1):
            own = dict(raw[n])
            if n < order:
                before = Counter(g[1:] for g in raw[n + 1])
                own = {g: before.get(g, 0) or 1 for g in own}
            once, twice = (sum(c == k for c in own.values()) for k in (1, 2))
            self.count[n], self.off[n] = own, once / (once + 2 * twice) if once else 0.5
            self.sums[n], self.kinds[n] = Counter(), Counter(g[:-1] for g in own)
            for g, c in own.items():
                self.sums[n][g[:-1]] += c

    def p(self, h, c):
        n = len(h) + 1
        below = self.p(h[1:], c) if h else 1 / self.vocab
        total = self.sums[n][h]
        return max(self.count[n].get((*h, c), 0) - self.off[n], 0) / total + self.off[n] * self.kinds[n][h] / total * below if total else below

    def cost(self, text):
        c = self.of(text)
        return -sum(np.log(self.p(c[max(0, i - self.order + 1) : i], c[i])) for i in range(1, len(c))) / (len(c) - 1)


def test_kneser_ney_sums_to_one():
    from modlens.llm import chars

    rng = random.Random(8)
    texts = {k: [" ".join("".join(rng.choice(v) for _ in range(rng.randint(1, 6))) for _ in range(30)) for _ in range(6)] for k, v in (("x", "abcab"), ("y", "bcddé"), ("z", "aez"))}
    model = langid._raw(sorted(texts), [langid.ngrams(texts[k]) for k in sorted(texts)])
    letters = {c for v in texts.values() for t in v for c in chars.folded([t])[0].tolist()}
    brute = [BruteKneserNey(texts[k], len(letters) + 1, langid.ORDER) for k in sorted(texts)]
    contexts = [tuple(rng.choice([*letters, 999]) for _ in range(rng.randint(0, 3))) for _ in range(200)]
    for b in brute:
        for h in contexts:
            assert np.isclose(sum(b.p(h, c) for c in [*letters, 999]), 1)  # 999: any letter not met
    for t in ["abba cab", "déjà q bcd", "zz", "qqq www", *texts["y"][:2]]:
        assert np.allclose(model.costs([t])[0][0], [b.cost(t) for b in brute], atol=1e-5), t


# --- 9 decontamination


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(200):
        codes = np.array([*(rng.randint(0, 3) for _ in range(rng.randint(1, 40))), 0])

        def suffix(i, codes=codes):  # to the first 0, which stands for itself
            n = int(np.flatnonzero(codes[i:] == 0)[0])
            return [(c, 0) for c in codes[i : i + n].tolist()] + [(0, i + n)]

        assert decontam.suffix_array(codes, 100).tolist() == sorted(range(len(codes)), key=suffix)


def test_decontamination(spark, docs, none, rows):
    from_doc = words(rows[4][1])
    items = [(1, " ".join(from_doc[3:20]), "x"), (2, "word", "x"), (3, None, "x"), (4, "!!", "x"), (5, " ".join(from_doc[5:15]).upper(), "x"), (6, "one two three", "x"), (7, "nothing like this stands anywhere in the corpus at all", "x"), (8, "one two three", "x"), (None, "two words", "x")]
    bench = spark.createDataFrame(items, "item_id long, text string, n_words string")
    wins = {}
    for i, t, _ in items:
        w = words(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[s : s + n]), set()).add(i)  # an item without id hits as well, as in the query's SQL

    def longest(w):  # by places, one item at a time
        best = 0
        for v in (words(t) for _, t, _ in items):
            for a in range(len(v)):
                for b in range(len(w)):
                    n = 0
                    while a + n < len(v) and b + n < len(w) and v[a + n] == w[b + n]:
                        n += 1
                    best = max(best, n) if n and n >= min(10, len(v)) else best
        return best

    want = []
    for i, t, *_ in rows:
        w, found = words(t), set()
        hit = [False] * len(w)
        for k, ids in wins.items():
            for s in range(len(w) - len(k) + 1):
                if tuple(w[s : s + len(k)]) == k:
                    hit[s : s + len(k)] = [True] * len(k)
                    found |= ids
        want.append((key(i), len(w), sum(hit), len(found), sha(",".join(sorted(str(x) for x in found if x is not None))), longest(w) if any(hit) else 0, any(hit)))
    assert sum(x[-1] for x in want) >= 3
    for size in (decontam.BLOCK_BYTES, 40):
        got = decontam.report(docs, bench, block_bytes=size).collect()
        assert sorted((key(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["longest_match"], r["contaminated"]) for r in got) == sorted(want)
        left = decontam.clean(docs, bench, block_bytes=size)
        assert left.columns == docs.columns
        assert sorted(key(r["doc_id"]) for r in left.collect()) == sorted(x[0] for x in want if not x[-1])
    side = spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(12))), (2, " ".join(f"b{i}" for i in range(11)))], "item_id long, text string")
    text = "x " + " ".join([f"a{i}" for i in range(12)] + [f"b{i}" for i in range(11)]) + " y " + "z " * 200_000
    r = decontam.report(spark.createDataFrame([(1, text)], "doc_id long, text string"), side).first()
    assert (r["n_hit"], r["n_items"], r["longest_match"]) == (23, 2, 12)  # two items side by side are no one match
    m = decontam.matches(spark.createDataFrame([(1, text)], "doc_id long, text string"), side).first()["matches"]
    assert sorted((x["item_id"], x["doc_start"], x["item_start"], x["length"]) for x in m) == [("1", 1, 0, 12), ("2", 13, 0, 11)]
    assert decontam.report(none, bench).count() == 0 and decontam.report(docs, bench.limit(0)).where("contaminated").count() == 0


# --- 10 substrings


def test_substrings(docs, none, rows, monkeypatch):
    split = re.compile(r"[^\x20\x09-\x0D]+").findall
    for window, block in ((20, 10), (7, 4)):
        first = {}
        for i, t, *_ in rows:
            w = split(t or "")
            for s in range(len(w) - window + 1):
                k = tuple(w[s : s + window])
                first[k] = min(first.get(k, (key(i), s)), (key(i), s))
        want = []
        for i, t, *_ in rows:
            w = split(t or "")
            gone = [False] * len(w)
            for s in range(len(w) - window + 1):
                if first[tuple(w[s : s + window])] < (key(i), s):
                    gone[s : s + window] = [True] * window
            kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
            want.append((key(i), len(w), sum(gone), sha(kept)))
        for shard in (substrings.SHARD_BYTES, 700):
            monkeypatch.setattr(substrings, "SHARD_BYTES", shard)
            got = substrings.dedup(docs, window, block).collect()
            assert sorted((key(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted(want)
    assert substrings.dedup(none).count() == 0


def test_packed_keys():
    for top in (10, 1 << 20, 1 << 50):
        x = np.unique(np.random.default_rng(0).integers(0, top, 1000, dtype=np.uint64))
        assert (substrings.unpack_sorted(substrings.pack_sorted(x)) == x).all()
        assert (substrings.unplanes(substrings.planes(x), np.uint64) == x).all()
    assert len(substrings.unpack_sorted(substrings.pack_sorted(np.zeros(0, np.uint64)))) == 0


# --- the pipeline


def test_pipeline_stages(spark, docs, none):
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in c.STAGES] == ["toxicity", "line_dedup", "minhash_neardup", "benchmark_decontamination", "byte_level_bpe"]
    base = spark.read.parquet(f"{sf}/documents.parquet")
    assert c.run(spark, sf).count() <= base.count()
    for _, stage in c.STAGES[:-1]:
        assert stage(spark, base, sf).columns == base.columns
        assert stage(spark, docs, sf).columns == docs.columns
        assert stage(spark, docs, sf).count() > 0
        assert stage(spark, none, sf).count() == 0
    assert c.STAGES[-1][1](spark, docs, sf).where(F.col("n_tokens") > 0).count() > 0
