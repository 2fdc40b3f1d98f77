"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear (logistic) models; each
model gets, besides the text's features, the probabilities of the categories
before it.  In training those probabilities are out-of-fold predictions, so a
later model never sees what an earlier one remembers of its own rows.

The labels hold one toxic flag, so the chain's earlier categories are weak
labels drawn from it and the terms that go with it: ``severe`` (toxic, with at
least ``SEVERE_TERMS`` different such features) and ``dense`` (toxic, with such
words making up at least ``DENSE_SHARE`` of all); the last is ``toxic`` itself,
and documents are rejected by its probability.  ``fit`` takes any categories.

Features are presence of lower-cased words and of word prefixes (inflected
forms), selected by their association with the last category (log-likelihood
ratio) over the training rows.  Training rows are the ``MAX_TRAIN`` labelled
documents with the lowest hash of their id: a documented bound, all fits run on
the driver on at most that many sparse rows of ``MAX_FEATURES`` columns.
Scoring covers whole texts of all documents.  The ratio that a feature must
reach grows with the logarithm of the number of training rows, as the evidence
they can give does.  The decision threshold maximises the out-of-fold F1 among
the cuts between different scores whose precision is ``MIN_PRECISION`` or more.

Defined cases: null or empty texts have no features; labels without a document,
with a null flag or with contradicting flags are not used; without positive or
without negative training rows, without any selected feature and without a cut
of that precision nothing is toxic; repeated rows are scored alike; ids may be null; empty tables give empty results; columns besides
id and text are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockfair.llm.common import stored

MAX_TRAIN = 8000
MAX_FEATURES = 600
#: Documents a feature must be in, and its least log-likelihood ratio at
#: ``MAX_TRAIN`` training rows (fewer: in proportion to the logarithm).
MIN_DOCS, MIN_RATIO = 4, 24.0
#: Least out-of-fold precision of a threshold, and a threshold nothing reaches.
MIN_PRECISION, NEVER = 0.8, 2.0
PREFIXES = (4, 5, 6, 7, 8)
FOLDS = 5
RIDGE = 1.0
SEVERE_TERMS, DENSE_SHARE = 4, 0.01
CATEGORIES = ("severe", "dense", "toxic")
CACHE_WORDS = 100_000

_WORD = re.compile(r"[^\W\d_]+")


def _word_features(word: str) -> list[str]:
    return [word, *[word[:k] + "*" for k in PREFIXES if len(word) >= k]]


@dataclass
class Chain:
    """A fitted chain: features' columns, per category weights over features,
    its share feature, earlier categories and intercept, and the threshold."""

    columns: dict[str, int]
    weights: list[np.ndarray]
    threshold: float
    categories: tuple[str, ...] = CATEGORIES
    scores: dict[str, float] = field(default_factory=dict)
    _seen: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"_seen": {}}

    def row(self, text: str) -> tuple[list[int], float]:
        """Columns present in a text, and the share of words that have any."""
        seen, get = self._seen, self.columns.get
        hit, n = set(), 0
        words = _WORD.findall(text.lower())
        for w in words:
            if (f := seen.get(w)) is None:
                f = tuple(c for x in _word_features(w) if (c := get(x)) is not None)
                if len(seen) < CACHE_WORDS:
                    seen[w] = f
            if f:
                n += 1
                hit.update(f)
        return sorted(hit), n / len(words) if words else 0.0

    def probabilities(self, rows: list[tuple[list[int], float]]) -> np.ndarray:
        """(rows x categories), each category fed by those before it."""
        out = np.zeros((len(rows), len(self.weights)))
        if not self.weights:
            return out
        x = _Rows(rows, len(self.columns))
        for k, w in enumerate(self.weights):
            out[:, k] = _sigmoid(x.dot(w, out[:, :k]))
        return out


class _Rows:
    """Sparse presence rows with dense columns: the share, earlier categories'
    probabilities, and one."""

    def __init__(self, rows, n_columns: int):
        self.n, self.columns = len(rows), n_columns
        self.row = np.repeat(np.arange(self.n), [len(c) for c, _ in rows])
        self.col = np.fromiter((c for cs, _ in rows for c in cs), np.int64, len(self.row))
        self.share = np.minimum(np.array([s for _, s in rows], float) * 20, 1.0)

    def take(self, keep: np.ndarray) -> _Rows:
        out = object.__new__(_Rows)
        new = np.cumsum(keep) - 1
        own = keep[self.row]
        out.n, out.columns = int(keep.sum()), self.columns
        out.row, out.col, out.share = new[self.row[own]], self.col[own], self.share[keep]
        return out

    def dense(self, earlier: np.ndarray) -> np.ndarray:
        return np.column_stack([self.share, earlier, np.ones(self.n)])

    def dot(self, w: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n) + self.dense(earlier) @ w[self.columns:]

    def back(self, r: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.col, r[self.row], self.columns), self.dense(earlier).T @ r])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _fit_linear(x: _Rows, earlier: np.ndarray, y: np.ndarray, steps: int = 150) -> np.ndarray:
    """Ridge logistic regression by accelerated gradient steps."""
    size = x.columns + earlier.shape[1] + 2
    w, v = np.zeros(size), np.zeros(size)
    per_row = np.bincount(x.row, minlength=x.n).max(initial=0) + earlier.shape[1] + 2
    # a step that the curvature allows: power iteration on X'X
    u = np.ones(size) / np.sqrt(size)
    top = float(per_row) * x.n
    for _ in range(12):
        g = x.back(x.dot(u, earlier), earlier)
        top = float(np.linalg.norm(g))
        if top == 0:
            break
        u = g / top
    rate = 1 / (top * 1.05 / 4 + RIDGE)
    keep = np.ones(size)
    keep[-1] = 0  # no ridge on the intercept
    for t in range(steps):
        g = x.back(_sigmoid(x.dot(v, earlier)) - y, earlier) + RIDGE * keep * v
        new = v - rate * g
        v = new + t / (t + 3) * (new - w)
        w = new
    return w


def fit_chain(rows, labels: np.ndarray, columns: dict[str, int], folds: np.ndarray,
              categories: tuple[str, ...] = CATEGORIES) -> Chain:
    """``labels`` (rows x categories, the last decides); ``folds`` the fold of
    each row."""
    x = _Rows(rows, len(columns))
    out_of_fold = np.zeros(labels.shape)
    weights = []
    for k in range(labels.shape[1]):
        earlier, y = out_of_fold[:, :k], labels[:, k].astype(float)
        for f in range(FOLDS):
            rest = folds != f
            if (~rest).any() and 0 < y[rest].sum() < rest.sum():
                w = _fit_linear(x.take(rest), earlier[rest], y[rest])
                out_of_fold[~rest, k] = _sigmoid(x.take(~rest).dot(w, earlier[~rest]))
        weights.append(_fit_linear(x, earlier, y))
    threshold, scores = _cut(out_of_fold[:, -1], labels[:, -1].astype(bool))
    return Chain(columns, weights, threshold, categories, scores)


def _cut(p: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, float]]:
    """The threshold of the best F1 under the precision floor.  Rows of one
    score are taken or left together; where no cut is precise enough nothing
    is taken."""
    order = np.argsort(-p, kind="stable")
    good, taken = np.cumsum(y[order]), np.arange(1, len(y) + 1)
    after = np.append(p[order[1:]], 0.0)
    f1 = np.where((p[order] > after) & (good >= MIN_PRECISION * taken), 2 * good / (taken + y.sum()), 0.0)
    best = int(np.argmax(f1))
    if f1[best] == 0:
        return NEVER, {"f1": 0.0, "precision": 0.0, "recall": 0.0}
    # halfway between the last row taken and the first left out
    return float((p[order[best]] + after[best]) / 2), {
        "f1": float(f1[best]), "precision": float(good[best] / taken[best]), "recall": float(good[best] / y.sum())}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", max_train: int = MAX_TRAIN) -> Chain:
    """Fit the chain on the bounded sample of labelled documents."""
    flags = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")) \
        .where("id is not null and y is not null").groupBy("id") \
        .agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z and y in (0, 1)")
    order = F.xxhash64(F.lit(7), "id")
    own = docs.select(F.col(id_col).alias("id"))
    sample = stored(flags.select("id", "y").join(own, "id", "left_semi").orderBy(order, "id").limit(max_train))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # at most max_train ids: a broadcast of a set bound
    texts = texts.join(F.broadcast(sample), "id").dropDuplicates(["id"])

    def tokens(batches):
        for b in batches:
            found = []
            for t in b.column(2).to_pylist():
                found.append(sorted({f for w in set(_WORD.findall((t or "").lower())) for f in _word_features(w)}))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(found, pa.list_(pa.string()))],
                                  names=["id", "y", "features"])

    kind = texts.schema["id"].dataType.simpleString()
    has = texts.select("id", "y", "text").mapInArrow(tokens, f"id {kind}, y int, features array<string>")
    size = sample.agg(F.count("*"), F.sum("y")).first()
    n, pos = size[0], size[1] or 0
    if not 0 < pos < n:
        return Chain({}, [], NEVER)
    counts = has.select("y", F.explode("features").alias("feature")).groupBy("feature") \
        .agg(F.sum("y").alias("a"), F.count("*").alias("d")).where(F.col("d") >= MIN_DOCS)

    def term(k, expected):
        return F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)

    a, d = F.col("a"), F.col("d")
    ratio = 2 * (term(a, d * pos / n) + term(d - a, d * (n - pos) / n)
                 + term(pos - a, (n - d) * pos / n) + term(n - d - pos + a, (n - d) * (n - pos) / n))
    least = MIN_RATIO * min(1.0, float(np.log(n) / np.log(MAX_TRAIN)))
    best = counts.where(a * n > d * pos).withColumn("g", F.round(ratio, 6)).where(F.col("g") >= least) \
        .orderBy(F.desc("g"), "feature").limit(MAX_FEATURES).collect()
    if not best:
        return Chain({}, [], NEVER)
    columns = {r["feature"]: k for k, r in enumerate(best)}
    chain = Chain(columns, [], NEVER)

    def present(batches):
        for b in batches:
            rows = [chain.row(t.as_py() or "") for t in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([r for r, _ in rows], pa.list_(pa.int32())),
                                   pa.array([s for _, s in rows], pa.float64())],
                                  names=["id", "y", "columns", "share"])

    got = texts.select("id", "y", "text").mapInArrow(
        present, f"id {kind}, y int, columns array<int>, share double") \
        .withColumn("fold", F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(FOLDS))).collect()  # at most max_train rows
    got.sort(key=lambda r: str(r["id"]))
    rows = [(r["columns"], r["share"]) for r in got]
    y = np.array([r["y"] for r in got], bool)
    if not 0 < y.sum() < len(y):  # labelled documents that are not there
        return Chain({}, [], NEVER)
    many = np.array([len(c) >= SEVERE_TERMS for c, _ in rows])
    dense = np.array([s >= DENSE_SHARE for _, s in rows])
    return fit_chain(rows, np.stack([y & many, y & dense, y], 1), columns,
                     np.array([r["fold"] for r in got]))


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, p_<category> ..., toxic) per row of ``docs``."""
    names = [f"p_{c}" for c in chain.categories]

    def run(batches):
        for b in batches:
            p = chain.probabilities([chain.row(t.as_py() or "") for t in b.column(1)])
            if not p.shape[1]:
                p = np.zeros((b.num_rows, len(names)))
            yield pa.record_batch([b.column(0), *[pa.array(p[:, k]) for k in range(len(names))],
                                   pa.array(p[:, -1] >= chain.threshold)], names=[id_col, *names, "toxic"])

    cols = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = cols.schema[0].dataType.simpleString()
    return cols.mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{n} double" for n in names) + ", toxic boolean")


def without_toxic(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the chain does not call toxic, columns as they
    are.  The text is judged in place: no join back to the documents."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("boolean")
    def is_toxic(texts: pa.Array) -> pa.Array:
        p = chain.probabilities([chain.row(t.as_py() or "") for t in texts])
        if not p.shape[1]:
            return pa.array(np.zeros(len(texts), bool))
        return pa.array(p[:, -1] >= chain.threshold)

    return docs.where(~is_toxic(F.col(text_col).cast("string")))
