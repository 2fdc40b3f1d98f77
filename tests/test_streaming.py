import datetime as dt
import os
import random

import pandas as pd

from stockfair.operators import ledger, scans
from stockfair.streaming import jobs

T0 = dt.datetime(2024, 1, 1)
A = "5901234123457"


def test_scan_stream_equals_batch(spark, scratch):
    rows = [("s1", T0 + dt.timedelta(seconds=t), A, i)
            for i, t in enumerate([0.0, 1.5, 2.5, 3.0, 9.0, 9.5])]
    df = spark.createDataFrame(rows, "scanner_id string, ts timestamp_ntz, barcode string, "
                                     "scan_id long")
    src = os.path.join(scratch, "scans")
    df.write.parquet(src)
    products = spark.createDataFrame([(1, "SKU001", A, "Helmet")],
                                     "id long, sku string, ean_upc string, name string")
    inventory = spark.createDataFrame([(1, 1, 5, None)],
                                      "id long, product_id long, quantity long, "
                                      "last_updated timestamp_ntz")
    # static sides are tables, as in a real job (a stream-static join with a
    # createDataFrame-built static side fails inside Spark's stateful operator)
    products.write.parquet(os.path.join(scratch, "p"))
    inventory.write.parquet(os.path.join(scratch, "i"))
    products = spark.read.parquet(os.path.join(scratch, "p"))
    inventory = spark.read.parquet(os.path.join(scratch, "i"))
    stream = spark.readStream.schema(df.schema).parquet(src)
    got = {r.scan_id: r.status for r in
           jobs.drain(jobs.scan_stream(stream, products, inventory, 2.0), "t_scans").collect()}
    batch = {r.scan_id: r.status for r in
             scans.scan_lookup(df, products, inventory, 2.0).collect()}
    assert got == batch
    assert got == {0: "found", 1: "duplicate", 2: "found", 3: "duplicate", 4: "found",
                   5: "duplicate"}


def test_scan_stream_decides_late_scans(spark, scratch):
    schema = "scanner_id string, ts timestamp_ntz, barcode string, scan_id long"
    hour, sec = dt.timedelta(hours=1), dt.timedelta(seconds=1)
    files = [[("s1", T0 + 5 * hour, A, 1), ("s1", T0 + 5 * hour + sec, A, 2), ("s2", T0 + 5 * hour, "bad", 3)],
             [("s1", T0, A, 4), ("s1", T0 + sec, A, 5), ("s3", T0, "bad", 6),  # hours behind
              ("s1", T0 + 5 * hour - 600 * sec, A, 7), ("s4", T0 + 5 * hour - 600 * sec, A, 8),
              ("s4", None, A, 9), ("s1", T0 + 5 * hour + 1.5 * sec, A, 10), ("s1", T0 + 5 * hour + 9 * sec, A, 11)]]
    src = os.path.join(scratch, "scans")
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        for name in os.listdir(src):  # the stream reads files by their time
            if name.endswith(".parquet") and os.path.getmtime(f"{src}/{name}") > 1e9 + 9:
                os.utime(f"{src}/{name}", (1e9 + k, 1e9 + k))
    spark.createDataFrame([(1, "SKU001", A, "Helmet")], "id long, sku string, ean_upc string, name string") \
        .write.parquet(os.path.join(scratch, "p"))
    spark.createDataFrame([(1, 1, 5, None)], "id long, product_id long, quantity long, last_updated timestamp_ntz") \
        .write.parquet(os.path.join(scratch, "i"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = jobs.drain(jobs.scan_stream(stream, spark.read.parquet(os.path.join(scratch, "p")),
                                      spark.read.parquet(os.path.join(scratch, "i")), 2.0), "t_late").collect()
    assert {r.scan_id: r.status for r in out} == {
        1: "found", 2: "duplicate", 3: "invalid", 4: "late", 5: "late", 6: "invalid", 7: "found", 8: "found",
        9: "found", 10: "duplicate", 11: "found"}
    assert len(out) == 11


def test_ledger_stream_equals_batch(spark, scratch):
    rows = [(1, 1, "in", 5), (2, 1, "out", 7), (3, 1, "out", 5), (4, 2, "out", 1), (5, 1, "out", 3), (5, 1, "in", 4),
            (5, 1, "out", 2), (None, 2, "in", 1), (None, 2, "out", 1), (5, 1, None, 2)]
    df = spark.createDataFrame(rows, "seq long, product_id long, transaction_type string, "
                                     "quantity long")
    src = os.path.join(scratch, "moves")
    df.write.parquet(src)
    opening = spark.createDataFrame([(1, 0), (2, 0)], "product_id long, opening long")
    opening.write.parquet(os.path.join(scratch, "o"))
    opening = spark.read.parquet(os.path.join(scratch, "o"))
    stream = spark.readStream.schema(df.schema).parquet(src)
    got = sorted(repr(tuple(r)) for r in jobs.drain(jobs.ledger_stream(stream, opening), "t_ledger")
                 .select("seq", "accepted", "reason", "balance_after").collect())
    batch = sorted(repr(tuple(r)) for r in ledger.apply_ledger(df, opening)
                   .select("seq", "accepted", "reason", "balance_after").collect())
    assert got == batch


def _tables(spark, scratch):
    products = spark.createDataFrame([(1, "SKU001", A, "Helmet")], "id long, sku string, ean_upc string, name string")
    products.write.parquet(os.path.join(scratch, "p"))
    spark.createDataFrame([(1, 1, 5, None)], "id long, product_id long, quantity long, last_updated timestamp_ntz") \
        .write.parquet(os.path.join(scratch, "i"))
    return spark.read.parquet(os.path.join(scratch, "p")), spark.read.parquet(os.path.join(scratch, "i"))


def test_scan_stream_meets_a_catalogue_too_large_to_broadcast(spark, scratch):
    """The join is one by shuffle, which has to write the stateful operator's rows."""
    rows = [("s1", T0, A, 1), ("s1", T0 + dt.timedelta(seconds=1), "590-1234123457", 2), ("s2", T0, "bad", 3),
            (None, T0, "96385074", 4), ("s2", None, A, 5), ("s2", T0, None, 6)]
    df = spark.createDataFrame(rows, "scanner_id string, ts timestamp_ntz, barcode string, scan_id long")
    df.write.parquet(os.path.join(scratch, "scans"))
    products, inventory = _tables(spark, scratch)
    stream = spark.readStream.schema(df.schema).parquet(os.path.join(scratch, "scans"))
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = jobs.drain(jobs.scan_stream(stream, products, inventory, 2.0), "t_shuffled").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    assert sorted((r.scan_id, r.scanner_id, r.ts, r.barcode, r.code, r.status, r.sku) for r in out) == [
        (1, "s1", T0, A, A, "found", "SKU001"),
        (2, "s1", T0 + dt.timedelta(seconds=1), "590-1234123457", A, "duplicate", "SKU001"),
        (3, "s2", T0, "bad", "", "invalid", None), (4, None, T0, "96385074", "96385074", "not_found", None),
        (5, "s2", None, A, A, "found", "SKU001"), (6, "s2", T0, None, None, "invalid", None)]


def test_rows_of_a_key_come_in_order_from_runs_on_disk():
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(30)]), str(k)) for k in range(1000)]
    whole = pd.DataFrame(rows, columns=["_us", "scan_id", "code"])
    wanted = whole.sort_values(["_us", "scan_id"], kind="stable").reset_index(drop=True)
    for size, run_rows, piece_rows in ((37, 100, 7), (1, 10, 3), (250, 40, 100), (100, 5000, 10), (1000, 1000, 1)):
        batches = (whole.iloc[k:k + size] for k in range(0, len(whole), size))
        frames = list(jobs.in_order(batches, ["_us", "scan_id"], run_rows, piece_rows))
        pd.testing.assert_frame_equal(pd.concat(frames, ignore_index=True), wanted)
    assert list(jobs.in_order(iter([]), ["_us"])) == []


def test_a_busy_scanner_is_never_in_one_frame():
    class State:
        exists, value = False, None

        def getCurrentWatermarkMs(self):
            return 1_000

        def update(self, value):
            self.value = value

    n = 400_000
    order = [*range(n)]
    random.Random(6).shuffle(order)

    def batches():
        for k in range(0, n, 10_000):
            us = pd.Series(order[k:k + 10_000]) * 600_000
            yield pd.DataFrame({"scanner_id": "s1", "scan_id": us, "code": A, "_us": us, "_ms": us // 1000})

    state, rows = State(), []
    for pdf in jobs._dedupe_fn(2_000_000)(("s1",), batches(), state):
        assert len(pdf) <= 250_000
        rows += zip(pdf["scan_id"].tolist(), pdf["duplicate"].tolist(), pdf["late"].tolist())
    # two scans before the watermark, then a scan every 0.6 s: each fourth one counts
    assert rows == [(k * 600_000, k >= 2 and (k - 2) % 4 > 0, k < 2) for k in range(n)]
    assert state.value == (A, max(k for k in range(n - 4, n) if (k - 2) % 4 == 0) * 600_000)
