"""Periodic runs, fill-in-middle and context-tree scores against brute-force
versions on the odd tables."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from odd import docs, texts, words
from stockfair.llm import context_tree, fim, periodic, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# -- periodic runs --------------------------------------------------------------

def brute_runs(w, least):
    """Every period by comparing each word with the one so many words on; a
    stretch belongs to its smallest period."""
    out, n = {}, len(w)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 3 * q) and j > i:
                out.setdefault((i, j - i + q), q)
            i = max(i + 1, j)
    return sorted((s, length, q) for (s, length), q in out.items())


def brute_collapsed(w, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic_words(rng):
    """Random words with repeated pieces put in, some of them nearly periodic
    themselves (long stretches of a small period broken once a period)."""
    v = rng.choice([1, 2, 3, 5, 50])
    w = words(rng, rng.randrange(0, 300), v)
    if rng.random() < 0.1:
        x, y = ["a"], ["a", "b"]
        while len(y) < 200:
            x, y = y, y + x
        return y
    for _ in range(rng.randrange(0, 4)):
        q = rng.randrange(1, max(2, len(w) // 3))
        piece = rng.choice([words(rng, q, v), ["a"] * (q - 1) + ["b"],
                            [f"w{i % rng.randrange(1, 9)}" for i in range(q - 1)] + ["z"]])
        at = rng.randrange(len(w) + 1)
        w[at:at] = [piece[i % q] for i in range(int(q * rng.uniform(2.5, 6)))]
    return w


@pytest.mark.parametrize("least", [1, 24])
def test_runs_equal_brute_force(least):
    rng = random.Random(least)
    for _ in range(8):
        some = [periodic_words(rng) for _ in range(60)]
        for w, (n, runs, rest) in zip(some, periodic._of_texts([" ".join(w) for w in some], least)):
            want = brute_runs(w, least)
            assert [tuple(r.values()) for r in runs] == want and n == len(w), w
            assert rest == brute_collapsed(w, want)


def test_synchronising_set_is_consistent_and_dense():
    """Copies are chosen alike; any so many positions outside periodic regions
    hold a chosen one."""
    import numpy as np

    rng = random.Random(2)
    piece = [rng.randrange(6) for _ in range(200)]
    codes = np.array([rng.randrange(6) for _ in range(50)] + piece + [rng.randrange(6) for _ in range(33)] + piece + [-1])
    levels = periodic._window_hashes(codes, 500)
    for k in (2, 3, 4):
        t = 1 << k
        out = np.zeros(len(levels[k]), bool)
        chosen = set(periodic.synchronising_set(levels[k], t, out).tolist())
        for i in range(200 - 2 * t):
            assert (50 + i in chosen) == (283 + i in chosen)
        assert all(any(i + d in chosen for d in range(t)) for i in range(len(codes) - 3 * t))


def test_runs_on_odd_documents(spark):
    rng = random.Random(4)
    t = texts() + [" ".join(["x"] * 5000), "a b " * 4000, "\n".join(["one two three four"] * 30),
                   *[" ".join(periodic_words(rng)) for _ in range(40)]]
    got = by_id(periodic.find(docs(spark, t)).withColumn("best", periodic.strongest(F.col("runs"))))
    assert len(got) == len(t)
    for i, s in enumerate(t):
        w = WORD.findall(s or "")
        if len(w) > 6000 and i < 40:
            w = None                                         # random words: nothing is found
        want = [] if w is None else brute_runs(w, 24) if len(w) < 1000 else [tuple(r) for r in got[i]["runs"]]
        assert [tuple(r) for r in got[i]["runs"]] == want
        if w is not None:
            assert got[i]["collapsed"] == brute_collapsed(w, want) and got[i]["n_words"] == len(w)
        best = max(want, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        assert (best is None and got[i]["best"] is None) or tuple(got[i]["best"]) == best
    assert [tuple(r) for r in got[40]["runs"]] == [(0, 5000, 1)]
    assert [tuple(r) for r in got[41]["runs"]] == [(0, 8000, 2)]
    assert periodic.find(docs(spark, t).limit(0)).count() == 0
    again = docs(spark, ["a b c " * 9] * 3, [None, 4, 4])
    assert {r["collapsed"] for r in periodic.find(again).collect()} == {"a b c"}


def test_op11_query(spark):
    sf = "/root/testdata/sf0.001"
    got = by_id(queries.op11_periodic(spark, sf))
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        w = WORD.findall(r["text"] or "")
        n, h = len(w), zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and n > 0:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 1500:
            continue
        runs = brute_runs(w, 24)
        x = got[r["doc_id"]]
        assert x["n_runs"] == len(runs)
        assert x["runs_sha256"] == sha("".join(f"{s},{length},{q}\n" for s, length, q in runs))
        assert x["collapsed_sha256"] == sha(brute_collapsed(w, runs))
        if runs:
            s, length, q = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]))
            assert (x["start"], x["length"], x["period"]) == (s, length, q)
            assert x["exponent_milli"] == 1000 * length // q
        else:
            assert x["start"] is x["length"] is x["period"] is x["exponent_milli"] is None


# -- fill in the middle ------------------------------------------------------------

def brute_fim(doc_id, text):
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k:8 * k + 8], 16) for k in range(4)]
    u = UNIT.findall(text)
    a, b = sorted(x % (len(u) + 1) for x in h[:2])
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(u), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fim_on_odd_documents(spark):
    rng = random.Random(6)
    alphabet = ["a", "bc", "é", "日本", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\r", "\x08", "\x0e", "\x1f", "!", "\xa0",
                "😀", "\x00", "\x7f", "\x85", "\xad", "<", ">", "<S", "M>", "P"]
    t = texts() + ["<P> a", "b <M>", "x<S>y"] \
        + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40))) for _ in range(3000)]
    df = docs(spark, t)
    formed = fim.transform(df)
    got = by_id(formed.withColumn("back", fim.restored(F.col("output"), F.col("form"))))
    assert len(got) == len(t)
    for i, s in enumerate(t):
        r = got[i]
        want = brute_fim(i, s or "")
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == want, s
        assert r["back"] == (s or "")
    assert {r["form"] for r in got.values()} == {"plain", "spm", "psm"}
    assert fim.transform(df.limit(0)).count() == 0
    rows = fim.transform(docs(spark, ["a b c d e"] * 3, [None, 7, 7])).collect()
    assert sorted(r["output"] for r in rows) == sorted(brute_fim(i, "a b c d e")[4] for i in (None, 7, 7))


@pytest.mark.parametrize("size", [1, 60, 1 << 20])
def test_fim_borders_of_sliced_batches(monkeypatch, size):
    """Lots of any size, in a batch that starts inside its buffers."""
    import pyarrow as pa

    monkeypatch.setattr(fim, "BYTES_AT_ONCE", size)
    rng = random.Random(size)
    t = ["", *["".join(rng.choice(["a ", "b", " é", "\n", "日"]) for _ in range(rng.randrange(0, 30))) for _ in range(200)], ""]
    h = [[rng.randrange(1 << 32) for _ in t] for _ in range(2)]
    whole = pa.record_batch([pa.array(range(len(t))), pa.array(t), pa.array(h[0]), pa.array(h[1])],
                            names=["doc_id", "text", "_h1", "_h2"])
    for batch in (whole, whole.slice(5, 100), whole.slice(0, 0)):
        out = next(fim._borders([batch])).to_pydict()
        for i, s, n, a, b in zip(*out.values()):
            u = UNIT.findall(s)
            lo, hi = sorted(h[k][i] % (len(u) + 1) for k in range(2))
            assert (n, a, b) == (len(u), len("".join(u[:lo]).encode()), len("".join(u[:hi]).encode()))


def test_fim_rates(spark):
    df = docs(spark, ["a b c"] * 50)
    assert {r["form"] for r in fim.transform(df, formed=100, suffix_first=0).collect()} == {"psm"}
    assert {r["form"] for r in fim.transform(df, formed=0).collect()} == {"plain"}


# -- context-tree scores -----------------------------------------------------------

def lowered(text):
    return (text or "").encode().lower() + b"\xff"


class BruteTree:
    """The weighting straight from its definition, a dictionary of counts."""

    def __init__(self, texts, depth):
        self.depth, self.n = depth, {}
        for t in texts:
            for ctx, node, bit in self.decisions(t):
                for d in range(depth + 1):
                    c = self.n.setdefault((ctx[depth - d:], node), [0, 0])
                    c[bit] += 1
        self.further = {}
        for ctx, node in self.n:
            if ctx:
                self.further.setdefault((ctx[1:], node), []).append((ctx, node))
        self.pw = {}
        for key in sorted(self.n, key=lambda k: -len(k[0])):
            own = self.own(key)
            if len(key[0]) < depth:
                below = sum(self.pw[k] for k in self.further[key])
                top = max(own, below)
                self.pw[key] = top + math.log(math.exp(own - top) + math.exp(below - top)) - math.log(2)
            else:
                self.pw[key] = own

    def decisions(self, text):
        data = b"\xff" * self.depth + lowered(text)
        for i in range(self.depth, len(data)):
            node = 1
            for j in range(7, -1, -1):
                bit = data[i] >> j & 1
                yield data[i - self.depth:i], node, bit
                node = node * 2 + bit

    def own(self, key):
        a, b = self.n[key]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def predict(self, ctx, node, bit, d=0):
        key = ctx[self.depth - d:], node
        if key not in self.n:
            return None
        c = self.n[key]
        own = (c[bit] + 0.5) / (sum(c) + 1)
        further = self.predict(ctx, node, bit, d + 1) if d < self.depth else None
        if further is None:
            return own
        w = math.exp(self.own(key) - math.log(2) - self.pw[key])
        return w * own + (1 - w) * further

    def score(self, text):
        return sum(math.log10(self.predict(*x) or 0.5) for x in self.decisions(text))


def brute_base(train, text):
    count = {}
    for t in train:
        for w in lowered(t)[:-1].split() + [b"\n"]:
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    tokens = lowered(text)[:-1].split() + [b"\n"]
    return len(tokens), sum(w in count for w in tokens), n, sum(
        math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in tokens)


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


@pytest.mark.parametrize("depth,block,task", [(5, 1 << 20, 512), (2, 3000, 2), (3, 500, 512)])
def test_scores_equal_brute_force(spark, monkeypatch, depth, block, task):
    monkeypatch.setattr(context_tree, "BYTES_AT_ONCE", 4000)
    monkeypatch.setattr(context_tree, "BLOCKS_PER_TASK", task)
    t = [s if s is None else s[:2500] for s in texts()] + ["Ünï <P> \xa0 ABC abc", "\x00\x7f"]
    got = by_id(context_tree.score(docs(spark, t), depth=depth, block_bytes=block))
    assert len(got) == len(t)
    train = [s for i, s in enumerate(t) if not held(i)]
    tree = BruteTree(train, depth)
    assert any(held(i) for i in range(len(t)))
    for i, s in enumerate(t):
        r = got[i]
        n, known, total, base = brute_base(train, s)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), n, known, total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert math.isclose(r["score"], tree.score(s), rel_tol=1e-5, abs_tol=1e-5)


def test_scores_odd_tables(spark):
    assert context_tree.score(docs(spark, ["a"]).limit(0)).count() == 0
    none = context_tree.score(docs(spark, ["a b", None]), held_out=F.lit(True)).collect()
    for r, size, n in zip(sorted(none, key=lambda r: r["doc_id"]), (4, 1), (3, 1)):
        assert math.isclose(r["score"], -8 * size * math.log10(2), rel_tol=1e-6)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (n, 0, 0, 0.0)
    rows = context_tree.score(docs(spark, ["same words here"] * 4, [None, None, 3, 3])).collect()
    assert len(rows) == 4 and len({r["score"] for r in rows}) == 1
    assert not any(r["held_out"] for r in rows if r["doc_id"] is None)


def test_next_byte_sums_to_one(spark):
    """The model's probabilities of all texts of one byte, and of longer ones, are
    a distribution: the bytes after a context sum to one."""
    import numpy as np

    keys, starts, sizes = context_tree._grams([b"abcabcabd", b"abd", b""], 3)
    keys = np.concatenate([keys[s:s + n] for s, n in zip(starts, sizes)])
    keys, counts = context_tree._summed(keys, np.ones(len(keys), np.int64))
    trees = context_tree.Trees(keys, counts, 3)
    node, n0, n1 = context_tree._nodes(keys, counts, 3, 1)
    upper = context_tree._upper_tables(list(zip(node, n0, n1, context_tree._children(node, *trees.below))))
    for context in (b"\xff\xff\xff", b"cba", b"zyx", b"zza"):       # latest byte first
        at = (int.from_bytes(context, "big") << 8) + np.arange(256, dtype=np.uint64)
        assert math.isclose((10 ** trees.log10(at.astype(np.uint64), upper)).sum(), 1, rel_tol=1e-9)


def test_held_out_score_beats_the_unigram_base(spark):
    """On held-out documents of sf0.1 the model codes better than the base."""
    got = context_tree.score(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    r = got.where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]
