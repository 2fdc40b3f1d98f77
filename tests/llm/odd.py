"""Small tables with the cases every operator must stand."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, blob string, text_key long, fp string"


def docs(spark, texts, ids=None):
    """Documents with extra columns whose names clash with inner ones."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", "s", len(t) if t is not None else None, "b", 1, "f") for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, SCHEMA)


def words(rng, n, vocabulary=30):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def texts(seed=1, n=40):
    """Nulls, empties, white space, repeats, ties, near copies, a long text."""
    rng = random.Random(seed)
    out = [None, "", "", " \t\n", "one", "É a\x0bB c\x1cd", "a b c a b c", "x" * 3000,
           "same text here", "same text here", "Same Text here"]
    base = words(rng, 300, 2000)
    out += [" ".join(base), " ".join(base), " ".join(base[:150] + ["other"] + base[151:]),
            " ".join(base[40:260]), "\n".join(" ".join(words(rng, 12)) for _ in range(20)) * 2]
    out.append(" ".join(words(rng, 20_000, 5000)))
    while len(out) < n:
        out.append(" ".join(words(rng, rng.randint(1, 200), 3000)))
    return out
