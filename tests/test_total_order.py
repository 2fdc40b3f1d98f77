"""Decisions do not depend on unique request numbers: rows that share or lack
a seq, sheets that each count from 1, and blocks of a hot product."""

import random

import pytest
from pyspark.sql import functions as F

from stockfair.operators import allocation, ledger, sequential


def _moves(spark, rows):
    return spark.createDataFrame(rows, "seq long, product_id long, transaction_type string, quantity long")


def _opening(spark, rows):
    return spark.createDataFrame(rows, "product_id long, opening long")


def walk(rows, opening):
    """The movements of a product one after the other: (row, accepted, reason, balance)."""
    nulls_first = lambda x: (x is not None, x if x is not None else 0)
    text_first = lambda x: (x is not None, x or "")
    out, balance = [], dict(opening)
    for r in sorted(rows, key=lambda r: (nulls_first(r[0]), text_first(r[2]), nulls_first(r[3]))):
        seq, p, typ, q = r
        known = p in balance
        reason = None
        if typ not in ("in", "out"):
            reason = "invalid_type"
        elif q is None or q <= 0:
            reason = "invalid_quantity"
        elif not known:
            reason = "unknown_product" if typ == "out" else None
        elif typ == "in":
            balance[p] += q
        elif balance[p] >= q:
            balance[p] -= q
        else:
            reason = "insufficient_stock"
        out.append((*r, reason is None, reason, balance.get(p)))
    return out


def decided(df):
    return sorted(map(repr, (tuple(r[c] for c in ("seq", "product_id", "transaction_type", "quantity", "accepted",
                                                  "reason", "balance_after")) for r in df.collect())))


def test_equal_seq_takes_one(spark):
    d = ledger.apply_ledger(_moves(spark, [(1, 1, "out", 2), (1, 1, "out", 2)]), _opening(spark, [(1, 3)])).collect()
    assert sorted((r.accepted, r.balance_after) for r in d) == [(False, 1), (True, 1)]


@pytest.mark.parametrize("width", [3, 7, 1000])
def test_ledger_equals_the_walk(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice([None, *range(40)]), rng.choice([1, 1, 1, 2, 3, 9]), rng.choice(["in", "out", "out", "out", None, "x"]),
             rng.choice([None, 0, 1, 2, 3, 5, 8])) for _ in range(300)]
    opening = [(1, 4), (2, 30), (3, 0)]
    d = ledger.apply_ledger(_moves(spark, rows), _opening(spark, opening), bucket_width=width)
    assert decided(d) == sorted(map(repr, walk(rows, opening)))


def test_hot_product_is_walked_in_blocks(spark):
    """A product with most rows: blocks of 25 rows, each started from a guess."""
    rng = random.Random(8)
    rows = [(k, 1 if k % 5 else 2, rng.choice(["in", "out", "out"]), rng.randint(1, 9)) for k in range(500)]
    opening = [(1, 10), (2, 10)]
    d = ledger.apply_ledger(_moves(spark, rows), _opening(spark, opening), bucket_width=25)
    assert decided(d) == sorted(map(repr, walk(rows, opening)))


def test_block_fold_walks_only_wrong_blocks_again(spark, monkeypatch):
    walked = []
    plain = sequential.sorted_fold

    def counted(df, *args, **kw):
        walked.append(df.select("_block").distinct().count())
        return plain(df, *args, **kw)

    monkeypatch.setattr(sequential, "sorted_fold", counted)
    rows = [(k, 1, "out", 3 if k < 10 else 1) for k in range(60)]
    ledger.apply_ledger(_moves(spark, rows), _opening(spark, [(1, 7)]), bucket_width=10).collect()
    assert walked[0] >= 5 and sum(walked) < 5 * len(walked) + 6


def _stock(spark):
    products = spark.createDataFrame([(1, "A"), (2, "B")], "id long, sku string")
    return products, spark.createDataFrame([(1, 3), (2, 3)], "product_id long, available long")


SHEET = "event_id long, seq long, SKU string, Quantity string"


def test_sheets_that_each_count_from_one(spark):
    products, available = _stock(spark)
    sheet = spark.createDataFrame([(10, 1, "A", "2"), (10, 2, "B", "2"), (11, 1, "A", "2"), (11, 2, "B", "2")], SHEET)
    got = allocation.allocate_rows(sheet, products, available).collect()
    assert sorted((r.event_id, r.seq, r.accepted) for r in got) == [
        (10, 1, True), (10, 2, True), (11, 1, False), (11, 2, False)]
    assert {r.error for r in got if not r.accepted} == {
        "Error importing SKU 'A': Not enough stock for product ID 1. Available: 1, Requested: 2",
        "Error importing SKU 'B': Not enough stock for product ID 2. Available: 1, Requested: 2"}


def test_row_without_seq_is_decided(spark):
    products, available = _stock(spark)
    sheet = spark.createDataFrame([(10, None, "A", "2"), (10, 2, "A", "2"), (10, None, "X", "1")], SHEET)
    got = {(r.seq, r.sku): r for r in allocation.allocate_rows(sheet, products, available).collect()}
    assert got[None, "A"].accepted and got[None, "A"].reason is None
    assert not got[2, "A"].accepted and got[2, "A"].reason == "insufficient_stock"
    assert got[None, "X"].reason == "unknown_sku"


def test_changes_of_equal_seq(spark):
    assignments = spark.createDataFrame([(1, 10, 1, 0, 1.0), (2, 11, 1, 0, 1.0)],
                                        "id long, event_id long, product_id long, quantity_assigned long, event_sale_price double")
    available = spark.createDataFrame([(1, 3)], "product_id long, available long")
    req = spark.createDataFrame([(1, 10, 1, 2), (1, 11, 1, 2), (None, 10, 1, 1)],
                                "seq long, event_id long, product_id long, new_quantity long")
    d = allocation.reassign_quantity(req, assignments, available)
    assert sorted(((r.seq is not None, r.event_id), r.accepted, r.available_after) for r in d.collect()) == [
        ((False, 10), True, 2), ((True, 10), True, 1), ((True, 11), False, 1)]
    new = allocation.reassigned(d, assignments)
    assert sorted((r.event_id, r.quantity_assigned) for r in new.collect()) == [(10, 2), (11, 0)]


def test_numbered_is_one_order(spark):
    df = spark.createDataFrame([(2, "b"), (None, "z"), (2, "a"), (1, None)], "k long, v string")
    got = sequential.numbered(df, ["k"], "n").select("n", "k", "v").orderBy("n").collect()
    assert [tuple(r) for r in got] == [(1, None, "z"), (2, 1, None), (3, 2, "a"), (4, 2, "b")]
    assert sequential.running_sum(sequential.numbered(df, ["k"], "n").withColumn("one", F.lit(1)), [], "n", "one", "s", 2) \
        .where("s <> n").count() == 0
