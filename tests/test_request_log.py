"""Interleaved calls against a model that makes them one after the other."""

import random

import pytest

from stockfair.operators import request_log

CALLS = "seq long, action string, event_id long, product_id long, quantity long"


def model(calls, held, left):
    """({call: [(accepted, reason, held, delta, left)]}, held, left)."""
    n = lambda x: (x is not None, x if x is not None else 0)
    s = lambda x: (x is not None, x or "")
    held, left, out = dict(held), dict(left), {}
    for c in sorted(calls, key=lambda c: (n(c[3]), n(c[0]), n(c[2]), s(c[1]), n(c[4]))):
        _, action, event, product, q = c
        now, have = held.get((event, product)), left.get(product)
        reason, delta = None, None
        if action not in ("allocate", "change", "remove"):
            reason = "unknown_call"
        elif action == "allocate":
            reason = "invalid_quantity" if q is None or q <= 0 else "unknown_product" if have is None \
                else "insufficient_stock" if q > have else None
            delta = q
        elif now is None:
            reason = "not_assigned"
        elif action == "change":
            reason = "invalid_quantity" if q is None or q < 0 else None
            if reason is None:
                delta = q - now
                if delta > 0:
                    reason = "unknown_product" if have is None else "insufficient_stock" if delta > have else None
        else:
            delta = -now
        if reason is None:
            if have is not None:
                left[product] = have - delta
            if action == "remove":
                held.pop((event, product))
            else:
                held[event, product] = (now or 0) + delta
        out.setdefault(c, []).append((reason is None, reason, now, delta if reason is None else None, left.get(product)))
    return out, held, left


def run(spark, calls, held, left, **kw):
    a = spark.createDataFrame([(i, e, p, q) for i, ((e, p), q) in enumerate(held.items())],
                              "id long, event_id long, product_id long, quantity_assigned long")
    av = spark.createDataFrame(list(left.items()), "product_id long, available long")
    d = request_log.decide(spark.createDataFrame(calls, CALLS), a, av, **kw)
    got = {}
    for r in d.collect():
        got.setdefault(tuple(r[:5]), []).append(tuple(r[5:]))
    after = {(r.event_id, r.product_id): r.quantity_assigned for r in request_log.assignments_after(d, a).collect()}
    rest = {r.product_id: r.available for r in request_log.available_after(d, av).collect()}
    return got, after, rest


@pytest.mark.parametrize("seed,block", [(1, 1 << 16), (2, 9)])
def test_random_calls_equal_the_model(spark, seed, block):
    rng = random.Random(seed)
    calls = [(k if rng.random() < 0.95 else None, rng.choice(["allocate", "allocate", "change", "change", "remove", "x"]),
              rng.randrange(4), rng.choice([1, 1, 1, *range(2, 30)]), rng.choice([None, 0, -1, 1, 2, 3, 4, 5, 8]))
             for k in range(500)]
    calls = list(dict.fromkeys(calls))
    held = {(e, p): rng.randrange(6) for e in range(4) for p in range(1, 32) if rng.random() < 0.5}
    left = {p: rng.choice([0, 2, 10, 200]) for p in range(1, 28)}
    want, after, rest = model(calls, held, left)
    got = run(spark, calls, held, left, block_rows=block)
    assert got == (want, after, rest)


def test_one_call_after_the_other(spark):
    calls = [(1, "allocate", 1, 7, 3), (2, "remove", 1, 7, None), (3, "allocate", 2, 7, 4), (4, "change", 1, 7, 1),
             (5, "change", 2, 7, 9), (6, "change", 2, 7, 5), (7, "remove", 2, 7, None), (8, "allocate", 1, 7, 5)]
    want, after, rest = model(calls, {}, {7: 5})
    assert run(spark, calls, {}, {7: 5}) == (want, after, rest)
    assert [want[c][0][0] for c in calls] == [True, True, True, False, False, True, True, True]
    assert after == {(1, 7): 5} and rest == {7: 0}


def test_no_calls(spark):
    assert run(spark, [], {(1, 1): 2}, {1: 3}) == ({}, {(1, 1): 2}, {1: 3})
