"""Results of the order-dependent jobs do not depend on the partitioning
"""

from stockfair.operators import ledger, scans
from stockfair.sources.driver import DriverTables

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_partition_count_does_not_change_results(spark):
    t = DriverTables(spark, SF)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    try:
        for parts in ("3", "11"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            opening = ledger.opening_balances(t.inventory())
            out.append((_rows(ledger.apply_ledger(t.movements(), opening, bucket_width=97)),
                        _rows(scans.scan_dedupe(t.scans(), 1800.0))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert out[0] == out[1]
