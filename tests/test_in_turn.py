"""Batches decided one after the other: by components and by rounds, against a
walk over all batches."""

import random

import pytest
from pyspark.sql import functions as F

from stockfair.operators import allocation
from stockfair.operators.components import components

REQ = "batch_id long, seq long, event_id long, product_id long, quantity long"


def walk(rows, available):
    """{row: (reason, accepted)} batch by batch."""
    nulls_first = lambda x: (x is not None, x if x is not None else 0)
    batches = {}
    for r in rows:
        batches.setdefault(r[0], []).append(r)
    left, out = dict(available), {}
    order = sorted(batches, key=lambda b: (nulls_first(min((r[1] for r in batches[b] if r[1] is not None), default=None)),
                                           nulls_first(b)))
    for b in order:
        mine = sorted(batches[b], key=lambda r: (nulls_first(r[1]), nulls_first(r[3]), nulls_first(r[4])))
        static = ["invalid_quantity" if r[4] is None or r[4] <= 0 else "unknown_product" if r[3] not in available else None
                  for r in mine]
        if any(static):
            out.update({r: (s, False) for r, s in zip(mine, static)})
            continue
        asked, reasons = {}, []
        for r in mine:
            asked[r[3]] = asked.get(r[3], 0) + r[4]
            reasons.append("insufficient_stock" if asked[r[3]] > left[r[3]] else None)
        ok = not any(reasons)
        if ok:
            for p, q in asked.items():
                left[p] -= q
        out.update({r: (s, ok) for r, s in zip(mine, reasons)})
    return out


def decided(spark, rows, available, **kw):
    av = spark.createDataFrame(list(available.items()), "product_id long, available long")
    got = allocation.allocate_in_turn(spark.createDataFrame(rows, REQ), av, **kw).collect()
    assert len(got) == len(rows)
    return {tuple(r[:5]): (r.reason, r.batch_accepted) for r in got}


@pytest.mark.parametrize("limit", [10 ** 6, 20, 0])
def test_random_batches_equal_the_walk(spark, limit):
    rng = random.Random(limit)
    rows = [(rng.choice([None, *range(60)]), k if rng.random() < 0.95 else None, 7, rng.choice([None, *range(1, 41)]) if rng.random() < 0.03
             else rng.randrange(1, 41), rng.choice([None, 0]) if rng.random() < 0.02 else rng.randint(1, 5)) for k in range(300)]
    available = {p: rng.choice([0, 3, 6, 12, 100]) for p in range(1, 40)}
    assert decided(spark, rows, available, walk_rows=limit) == walk(rows, available)


def test_chain_of_batches(spark, monkeypatch):
    """Each batch shares a product with the next: one component, one walk."""
    stored = []
    plain = allocation.cut_lineage
    monkeypatch.setattr(allocation, "cut_lineage", lambda df: stored.append(1) or plain(df))
    counts = []
    for n in (4, 32):
        stored.clear()
        rows = [(b, 10 * b + k, 1, b + k, 2) for b in range(n) for k in (0, 1)]
        available = {p: 3 for p in range(n + 1)}
        got = decided(spark, rows, available)
        assert got == walk(rows, available)
        assert [got[10 * b // 10, 10 * b, 1, b, 2][1] for b in range(4)] == [True, False, True, False]
        counts.append(len(stored))
    assert counts[0] == counts[1]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(64)] \
        + [(5000, 5001 + k) for k in range(50)] + [(7, 7), (9000, 9000)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in list(root)}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(want) and {r.node: r.root for r in got} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_requests(spark):
    av = spark.createDataFrame([(1, 3)], "product_id long, available long")
    assert allocation.allocate_in_turn(spark.createDataFrame([], REQ), av).count() == 0
    assert allocation.allocate_in_turn(spark.createDataFrame([(1, 1, 1, 1, 3)], REQ), av).where(
        F.col("batch_accepted")).count() == 1
