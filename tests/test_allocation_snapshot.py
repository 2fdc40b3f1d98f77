"""Requests and assignments of ``allocation_snapshot`` come from lines put together once.
Rows are built here."""

import datetime
import random

from stockfair.operators import allocation
from stockfair.plans import driver_queries
from stockfair.sources.driver import DriverTables

DAY = datetime.datetime(1997, 7, 1)


def tables(spark, folder):
    """Orders that come twice, unknown customers, lines that repeat or lack a part, number or order."""
    rng = random.Random(7)
    frames = {
        "customer": ([(k, k % 3) for k in range(5)], "c_custkey long, c_nationkey int"),
        "orders": ([(k, rng.choice([0, 1, 2, 3, 4, 9, None]), DAY) for k in range(40)] + [(3, 1, DAY), (4, 2, DAY)],
                   "o_orderkey long, o_custkey long, o_orderdate timestamp"),
        "part": ([(k, 10.0 + k) for k in range(8)] + [(2, 55.5)], "p_partkey long, p_retailprice double"),
        "lineitem": ([(rng.choice([*range(42), None]), rng.choice([1, 1, 2, 3, None]), rng.choice([*range(9), None]),
                       rng.choice([5.0, 20.0, 37.0, None]), rng.choice([100.0, 70.5, None]), "N", DAY) for _ in range(200)],
                     "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, "
                     "l_returnflag string, l_shipdate timestamp"),
    }
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


def rows(df):
    return sorted(map(repr, df.collect()))


def test_lines_are_put_together_once(spark, scratch, monkeypatch):
    folder = tables(spark, scratch)
    t = DriverTables(spark, folder)
    want = rows(allocation.allocation_snapshot(
        allocation.allocate_batch(t.allocation_requests(), allocation.available_stock(t.inventory())), t.event_products()))
    met = []
    monkeypatch.setattr(DriverTables, "_fair_of_order", lambda self, real=DriverTables._fair_of_order: met.append(1) or real(self))
    got = rows(driver_queries.REGISTRY["allocation_snapshot"](spark, folder))
    assert got == want and len(got) > 10
    assert len(met) == 1


def test_requests_and_assignments_of_stored_lines(spark, scratch):
    t = DriverTables(spark, tables(spark, scratch))
    lines = t.summed_lines()
    assert rows(t.allocation_requests(lines)) == rows(t.allocation_requests())
    assert rows(t.event_products(lines)) == rows(t.event_products())


def test_kept_requests_are_decided_alike(spark):
    rng = random.Random(5)
    req = spark.createDataFrame(
        [(rng.choice([None, 1, 2, 3, 4]), k, 1, rng.choice([None, 0, 1, 2, 3]), rng.choice([0, 1, 2, None]) if k % 9 == 0 else 1)
         for k in range(60)], "batch_id long, seq long, event_id long, product_id long, quantity long")
    av = spark.createDataFrame([(p, 6) for p in range(1, 4)], "product_id long, available long")
    for block in (3, 1 << 16):
        assert rows(allocation.allocate_batch(req, av, block, kept=True)) == rows(allocation.allocate_batch(req, av))


def test_sorted_by_product_first(spark, monkeypatch):
    """Few fairs, many products: sorted by fair first nearly all rows tie."""
    plans = []
    monkeypatch.setattr(allocation, "cut_lineage", lambda df, real=allocation.cut_lineage: plans.append(
        df._jdf.queryExecution().executedPlan().toString()) or real(df))
    decisions = spark.createDataFrame([(k, 1, k % 5, 1, 2.0, True) for k in range(9)] + [(9, None, None, 1, None, True)],
                                      "seq long, event_id long, product_id long, quantity long, sale_price double, batch_accepted boolean")
    assigned = spark.createDataFrame([(7, 1, 2, 3, None), (8, None, None, 1, 1.0)],
                                     "id long, event_id long, product_id long, quantity_assigned long, event_sale_price double") \
        .hint("merge")
    got = {r.id: r[1:] for r in allocation.allocation_snapshot(decisions, assigned).collect()}
    assert got == {7: (1, 2, 5, 2.0), 8: (None, None, 1, 1.0), 9: (None, None, 1, None), 10: (1, 0, 2, 2.0),
                   11: (1, 1, 2, 2.0), 12: (1, 3, 2, 2.0), 13: (1, 4, 1, 2.0)}
    assert "Sort [product_id" in plans[0] and "Sort [event_id" not in plans[0]
