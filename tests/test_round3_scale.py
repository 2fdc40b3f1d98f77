"""Keys with few rows go by windows after one shuffle, those with many by blocks; both
give the same.  Rows are built here."""

import random

from pyspark.sql import functions as F

from stockfair.operators import allocation, ledger, reports, request_log, sequential
from stockfair.session import stored


def exchanges(df):
    """Shuffles in the plan before it runs."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_stored_keeps_rows_and_types(spark):
    df = spark.sql("SELECT id, CAST(id AS STRING) AS s, IF(id = 1, NULL, struct(id)) AS t, "
                   "TIMESTAMP '0900-01-01 00:00:00' AS old, DATE '0900-01-01' AS d FROM range(3)")
    got = stored(df)
    assert got.dtypes == df.dtypes and sorted(got.collect()) == sorted(df.collect())
    assert len(got.inputFiles()) > 0
    assert stored(spark.sql("SELECT 1 AS a, NULL AS b")).collect()[0] == (1, None)


def test_keys_with_many_rows_are_set_apart(spark):
    df = stored(spark.range(100).select(F.when(F.col("id") < 60, F.lit(None)).otherwise(F.col("id")).alias("k"), "id"))
    light, heavy = sequential.apart(df, ["k"], 5)
    assert light.count() == 40 and heavy.where("k IS NULL").count() == 60
    assert sequential.apart(df, ["k"])[1] is None
    sums = [sorted(sequential.sums_by_key(df, ["k"], "id", {"id": "s"}, b).select("id", "s").collect()) for b in (5, 1 << 16)]
    assert sums[0] == sums[1]


def test_a_task_sorts_a_bounded_number_of_rows(spark):
    assert sequential.parts_for(spark.range(1), 100 * sequential.TASK_ROWS) == 100
    assert sequential.parts_for(spark.range(1), 1) == 8


def test_long_numbers_beside_nulls_stay_exact(spark):
    """A walk carries columns as they are: numbers beyond 2^53 beside NULLs too."""
    big = 2 ** 60 + 1
    m = spark.createDataFrame([(big, 1, "out", 9), (None, 1, "out", 8), (big + 2, 1, "out", 1)],
                              "seq long, product_id long, transaction_type string, quantity long")
    got = {r.seq for r in ledger.apply_ledger(m, spark.createDataFrame([(1, 1)], "product_id long, opening long")).collect()}
    assert got == {None, big, big + 2}


def test_huge_batches_by_blocks(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 2, 3]), k, 1, rng.randrange(1, 6), rng.choice([0, 1, 2, None]) if k % 9 == 0 else 1)
            for k in range(60)]
    req = spark.createDataFrame(rows, "batch_id long, seq long, event_id long, product_id long, quantity long")
    av = spark.createDataFrame([(p, 5) for p in range(1, 5)], "product_id long, available long")
    by = lambda r: sorted(map(repr, r.collect()))
    assert by(allocation.allocate_batch(req, av, 3)) == by(allocation.allocate_batch(req, av))


def test_quantity_changes_by_blocks(spark):
    rng = random.Random(4)
    rows = list({(k, rng.randrange(3), rng.choice([1, 1, 1, 2, 3]), rng.randrange(9)) for k in range(60)})
    req = spark.createDataFrame(rows + rows[:5], "seq long, event_id long, product_id long, new_quantity long")
    a = spark.createDataFrame([(e, p, 2) for e in range(3) for p in (1, 2)], "event_id long, product_id long, quantity_assigned long")
    av = spark.createDataFrame([(1, 6), (2, 1)], "product_id long, available long")
    by = lambda r: sorted(map(repr, r.collect()))
    assert by(allocation.reassign_quantity(req, a, av, 4)) == by(allocation.reassign_quantity(req, a, av))


def test_calls_need_few_shuffles(spark):
    """Calls dealt out by product: the plan of the sums has one shuffle of the calls."""
    calls = spark.createDataFrame([(k, "allocate", 1, k % 5, 1) for k in range(30)],
                                  "seq long, action string, event_id long, product_id long, quantity long")
    c = stored(calls.withColumn("_start", F.lit(1).cast("long")).withColumn("available", F.lit(2).cast("long")))
    light, heavy = sequential.apart(c, ["product_id"])
    assert heavy is None and exchanges(request_log._in_windows(light)) == 1


def test_performance_of_products_listed_twice(spark):
    p = spark.createDataFrame([(1, 1, "A", 2.0), (1, 1, "B", 2.0), (2, 1, "C", 1.0)],
                              "id long, supplier_id long, sku string, selling_price double") \
        .selectExpr("*", "sku AS name", "sku AS description", "sku AS category", "1.0D AS purchase_price")
    s = spark.createDataFrame([(1, "S")], "id long, name string")
    a = spark.createDataFrame([(7, 1, 5, None), (7, 2, 4, None)],
                              "event_id long, product_id long, quantity_assigned long, event_sale_price double")
    sales = spark.createDataFrame([(7, 1, 2, 3.0)], "event_id long, product_id long, quantity long, sale_price double")
    got = sorted((r.sku, r.quantity_sold, r.remaining) for r in reports.event_performance(a, p, s, sales).collect())
    assert got == [("A", 2, 3), ("A", 2, 3), ("B", 2, 3), ("B", 2, 3), ("C", 0, 4)]


def test_rounds_then_components(spark):
    """Bounds decide a part of the batches, a walk or further rounds the rest."""
    from test_in_turn import decided, walk

    rng = random.Random(8)
    rows = [(b, 10 * b + k, 1, rng.randrange(12), rng.randint(1, 3)) for b in range(60) for k in range(2)]
    available = {p: rng.randint(4, 9) for p in range(12)}
    want = walk(rows, available)
    assert decided(spark, rows, available, walk_rows=40) == want


def test_sheet_rows_are_written_once_before_the_ledger(spark, monkeypatch):
    """The sheet is stored when its skus are looked up; the ledger reads those rows."""
    kept = []
    monkeypatch.setattr(ledger, "stored", lambda df, real=ledger.stored: kept.append(df.columns) or real(df))
    sheet = spark.createDataFrame([(1, k, "A" if k % 2 else "B", str(k)) for k in range(6)],
                                  "event_id long, seq long, SKU string, Quantity string")
    products = spark.createDataFrame([(1, "A"), (2, "B")], "id long, sku string")
    stock = spark.createDataFrame([(1, 4), (2, 3)], "product_id long, available long")
    got = {r["seq"]: r["reason"] for r in allocation.allocate_rows(sheet, products, stock).collect()}
    assert got == {0: "not_positive", 1: None, 2: None, 3: None, 4: "insufficient_stock", 5: "insufficient_stock"}
    assert len(kept) == 1 and "_bal" in kept[0]
