import pytest
from pyspark.sql import functions as F

from stockfair.operators import ledger

SF = "/root/testdata/sf0.001"


def _moves(spark, rows):
    return spark.createDataFrame(rows, "seq long, product_id long, transaction_type string, "
                                       "quantity long")


def test_f8_movements(spark):
    m = _moves(spark, [(1, 1, "in", 5), (2, 1, "out", 7), (3, 1, "out", 5), (4, 1, "out", 1),
                       (5, 1, "in", 0), (6, 99, "out", 1), (7, 99, "in", 3)])
    opening = spark.createDataFrame([(1, 0)], "product_id long, opening long")
    d = {r.seq: (r.accepted, r.reason, r.balance_after)
         for r in ledger.apply_ledger(m, opening).collect()}
    assert d == {1: (True, None, 5), 2: (False, "insufficient_stock", 5), 3: (True, None, 0),
                 4: (False, "insufficient_stock", 0), 5: (False, "invalid_quantity", 0),
                 6: (False, "unknown_product", None), 7: (True, None, None)}


@pytest.mark.parametrize("bucket", [1, 7, 1 << 16])
def test_fixture_counts_and_bucket_independence(spark, bucket):
    from stockfair.sources.driver import DriverTables

    d = ledger.apply_ledger(DriverTables(spark, SF).movements(), bucket_width=bucket)
    c = {(r.transaction_type, r.accepted, r.reason): r.n for r in
         d.groupBy("transaction_type", "accepted", "reason").agg(F.count("*").alias("n")).collect()}
    # FIXTURES.md: in accepted 382, out accepted 440, out rejected 168 (quantity > 0)
    assert c[("in", True, None)] == 382
    assert c[("out", True, None)] == 440
    assert c[("out", False, "insufficient_stock")] == 168
    assert d.where(F.col("balance_after") < 0).count() == 0


def test_stock_log_rows_text(spark):
    m = _moves(spark, [(1, 1, "in", 5), (2, 1, "out", 2)])
    d = ledger.apply_ledger(m)
    rows = sorted((r.event_type, r.description, r.related_id)
                  for r in ledger.stock_log_rows(d).collect())
    assert rows == [("stock_in", "Added 5 units to stock", 1),
                    ("stock_out", "Removed 2 units from stock", 2)]


def test_movements_without_product_or_seq_are_decided(spark):
    m = _moves(spark, [(1, None, "in", 5), (2, None, "out", 1), (3, 1, "out", 9), (None, 1, "in", 1), (4, 1, "in", 2)])
    opening = spark.createDataFrame([(1, 3)], "product_id long, opening long")
    got = sorted(((r.seq or 0), r.product_id, r.accepted, r.reason) for r in ledger.apply_ledger(m, opening).collect())
    assert got == [(0, 1, True, None), (1, None, True, None), (2, None, False, "unknown_product"),
                   (3, 1, False, "insufficient_stock"), (4, 1, True, None)]
