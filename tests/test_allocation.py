from stockfair.operators import allocation


def _products(spark):
    return spark.createDataFrame([(1, "SKU001"), (2, "SKU002"), (3, "SKU002")],
                                 "id long, sku string")


def _available(spark):
    return spark.createDataFrame([(1, 10), (2, 4)], "product_id long, available long")


def test_f6_sheet_rows(spark):
    sheet = spark.createDataFrame([
        (1, "SKU001", "6", None), (2, "NOPE", "1", None), (3, "SKU001", "abc", None),
        (4, "SKU001", "5", None), (5, "SKU001", "4", "99.5"), (6, "SKU002", "2.7", None),
    ], "seq long, SKU string, Quantity string, `Sale Price` string")
    d = {r.seq: r for r in allocation.allocate_rows(sheet, _products(spark), _available(spark), 9)
         .collect()}
    assert d[1].accepted and d[4].accepted is False and d[5].accepted   # smaller after shortage
    assert d[2].error == "Product with SKU 'NOPE' not found"
    assert d[3].error.startswith("Error importing SKU 'SKU001': invalid literal")
    assert d[4].error == ("Error importing SKU 'SKU001': Not enough stock for product ID 1. "
                          "Available: 4, Requested: 5")
    assert d[6].quantity == 2 and d[6].product_id == 2 and d[6].accepted   # min id of the sku
    s = allocation.allocate_rows_summary(
        allocation.allocate_rows(sheet, _products(spark), _available(spark), 9)).collect()[0]
    assert (s.imported, s.errors) == (3, 3)


def test_missing_columns(spark):
    df = spark.createDataFrame([("SKU001",)], "SKU string")
    assert allocation.missing_sheet_columns(df) == ["Quantity"]


def test_batch_all_or_nothing(spark):
    req = spark.createDataFrame([
        (1, 1, 9, 1, 6, None), (1, 2, 9, 1, 5, None),     # 11 > 10: batch 1 fails
        (2, 3, 9, 2, 4, 12.0), (2, 4, 9, 1, 3, None),     # fits
    ], "batch_id long, seq long, event_id long, product_id long, quantity long, sale_price double")
    d = allocation.allocate_batch(req, _available(spark))
    ok = {r.batch_id: r.batch_accepted for r in d.collect()}
    assert ok == {1: False, 2: True}
    assign = spark.createDataFrame([(5, 9, 2, 1, None)],
                                   "id long, event_id long, product_id long, quantity_assigned long, "
                                   "event_sale_price double")
    snap = {r.product_id: (r.quantity_assigned, r.event_sale_price)
            for r in allocation.allocation_snapshot(d, assign).collect()}
    assert snap == {2: (5, 12.0), 1: (3, None)}


def test_unassign_restores_availability(spark):
    assign = spark.createDataFrame([(5, 9, 2, 3, None)],
                                   "id long, event_id long, product_id long, quantity_assigned long, "
                                   "event_sale_price double")
    req = spark.createDataFrame([(9, 2), (9, 1)], "event_id long, product_id long")
    d = {r.product_id: r for r in allocation.unassign_product(req, assign).collect()}
    assert d[2].released == 3 and d[1].reason == "not_assigned"
    kept, avail = allocation.unassign_snapshot(req, assign, _available(spark))
    assert kept.count() == 0
    assert {r.product_id: r.available for r in avail.collect()} == {1: 10, 2: 7}


def test_reassign(spark):
    assign = spark.createDataFrame([(5, 9, 2, 3, None), (6, 8, 2, 1, None)],
                                   "id long, event_id long, product_id long, quantity_assigned long, "
                                   "event_sale_price double")
    req = spark.createDataFrame([(1, 9, 2, 6), (2, 8, 2, 3), (3, 7, 1, 1)],
                                "seq long, event_id long, product_id long, new_quantity long")
    d = {r.seq: (r.accepted, r.reason) for r in
         allocation.reassign_quantity(req, assign, _available(spark)).collect()}
    # +3 of 4 available fits, then +2 of the remaining 1 does not
    assert d == {1: (True, None), 2: (False, "insufficient_stock"), 3: (False, "not_assigned")}


REQ = "batch_id long, seq long, event_id long, product_id long, quantity long"


def test_batches_in_turn(spark):
    import random

    rng = random.Random(3)
    rows = [(b, 10 * b + k, 1, rng.choice([1, 2, 3, None] if b % 7 == 0 else [1, 2, 3]), rng.randint(0 if b % 11 == 0 else 1, 4))
            for b in range(1, 60) for k in range(rng.randint(1, 3))]
    rows += [(1000, 9000, 1, 1, None), (None, 9001, 1, 2, 1)]
    stock = {1: 30, 2: 25, 3: 9}
    avail = spark.createDataFrame(list(stock.items()), "product_id long, available long")
    got = allocation.allocate_in_turn(spark.createDataFrame(rows, REQ), avail).collect()
    assert len(got) == len(rows)
    left, want = dict(stock), {}
    for b in sorted({r[0] for r in rows}, key=lambda b: min(r[1] for r in rows if r[0] == b)):
        own, ok = dict(left), True
        for r in sorted((r for r in rows if r[0] == b), key=lambda r: r[1]):
            if not r[4] or r[4] <= 0 or r[3] not in own or own[r[3]] < r[4]:
                ok = False
                break
            own[r[3]] -= r[4]
        want[b] = ok
        left = own if ok else left
    assert {r.batch_id: r.batch_accepted for r in got} == want
    assert any(want.values()) and not all(want.values())


def test_two_batches_do_not_oversell(spark):
    req = spark.createDataFrame([(1, 1, 9, 1, 4), (2, 2, 9, 1, 4)], REQ)
    avail = spark.createDataFrame([(1, 5)], "product_id long, available long")
    d = allocation.allocate_in_turn(req, avail)
    assert {r.batch_id: r.batch_accepted for r in d.collect()} == {1: True, 2: False}
    assert allocation.reserve(avail, d).collect()[0].available == 1


def test_rows_without_product_reject_their_batch(spark):
    req = spark.createDataFrame([(1, 1, 9, None, 1), (1, 2, 9, 1, 1)], REQ)
    d = allocation.allocate_batch(req, _available(spark)).collect()
    assert len(d) == 2 and not any(r.batch_accepted for r in d)


def test_every_reassignment_is_decided(spark):
    assign = spark.createDataFrame([(5, 9, 1, 2), (6, 8, 1, 1)],
                                   "id long, event_id long, product_id long, quantity_assigned long")
    avail = spark.createDataFrame([(1, 5)], "product_id long, available long")
    req = spark.createDataFrame([(1, 9, 1, 5), (2, 9, 1, 100), (3, 8, 1, 3), (4, 9, 1, 6), (5, 9, 1, 1), (6, 8, 1, 6),
                                 (7, 9, None, 1), (8, 9, 1, None)],
                                "seq long, event_id long, product_id long, new_quantity long")
    d = allocation.reassign_quantity(req, assign, avail)
    got = {r.seq: (r.accepted, r.current_quantity, r.available_after) for r in d.collect()}
    # 5 left: 2->5 leaves 2; 5->100 no; 1->3 leaves 0; 5->6 no; 5->1 leaves 4; 3->6 leaves 1
    assert got == {1: (True, 2, 2), 2: (False, 5, 2), 3: (True, 1, 0), 4: (False, 5, 0), 5: (True, 5, 4),
                   6: (True, 3, 1), 7: (False, None, None), 8: (False, 2, None)}
    new = {r.event_id: r.quantity_assigned for r in allocation.reassigned(d, assign).collect()}
    assert new == {9: 1, 8: 6}


def test_second_unassign_finds_nothing(spark):
    assign = spark.createDataFrame([(5, 9, 2, 2)],
                                   "id long, event_id long, product_id long, quantity_assigned long")
    req = spark.createDataFrame([(1, 9, 2), (2, 9, 2)], "seq long, event_id long, product_id long")
    got = {r.seq: (r.accepted, r.released, r.reason) for r in allocation.unassign_product(req, assign).collect()}
    assert got == {1: (True, 2, None), 2: (False, None, "not_assigned")}
