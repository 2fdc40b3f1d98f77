"""Streams kept as tables: event-time order, expiry, late scans, replays."""

import datetime as dt
import os
import random

import pytest

from stockfair.operators import ledger, scans
from stockfair.streaming import upkeep

T0 = dt.datetime(2024, 1, 1)
A, B = "5901234123457", "96385074"
SCHEMA = "scanner_id string, ts timestamp_ntz, barcode string, scan_id long"


def at(s):
    return T0 + dt.timedelta(seconds=s)


@pytest.fixture
def catalogue(spark):
    products = spark.createDataFrame([(1, "SKU001", A, "Helmet")], "id long, sku string, ean_upc string, name string")
    inventory = spark.createDataFrame([(1, 1, 5, None)], "id long, product_id long, quantity long, last_updated timestamp_ntz")
    return products, inventory


def keeper(spark, scratch, catalogue, **kw):
    return upkeep.ScanUpkeep(upkeep.Versions(spark, os.path.join(scratch, "kept")), *catalogue, **kw)


def statuses(df):
    return {r.scan_id: r.status for r in df.collect()}


def test_batches_out_of_order_equal_the_batch_job(spark, scratch, catalogue):
    rng = random.Random(1)
    rows, t = [], 0.0
    for i in range(200):
        t += rng.choice([0.0, 0.4, 0.9, 1.0, 1.9, 2.0, 5.0])
        rows.append((rng.choice(["s1", "s1", "s2"]), at(t), A if rng.random() < 0.8 else B if rng.random() < 0.8 else "bad", i))
    rows += [("s1", None, A, 900), (None, at(3), A, 901), (None, at(4), A, 902)]
    want = statuses(scans.scan_lookup(spark.createDataFrame(rows, SCHEMA), *catalogue, 2.0))
    # a scan arrives up to a minute after its time, so batches overlap in time
    arrive = sorted(rows, key=lambda r: ((r[1] or T0) - T0).total_seconds() + rng.random() * 60)
    k = keeper(spark, scratch, catalogue, delay_s=60)
    for b in range(3):
        k.process(spark.createDataFrame(arrive[b * 70:(b + 1) * 70], SCHEMA), b)
    early = k.v.all_of("outcomes", upkeep.OUTCOMES)
    assert 0 < early.count() < len(rows) and all(want[i] == s for i, s in statuses(early).items())
    out = k.finish()
    assert out.count() == len(rows) and statuses(out) == want
    assert k.v.read("waiting", k.v.last("waiting"), upkeep.SCANS).count() == 0


def test_late_scans_and_idle_scanners(spark, scratch, catalogue):
    k = keeper(spark, scratch, catalogue, delay_s=10)
    k.process(spark.createDataFrame([("s1", at(0), A, 1), ("s2", at(1), A, 2), ("s1", at(100), A, 3)], SCHEMA), 0)
    anchors = k.v.read("anchors", 0, upkeep.ANCHORS)
    assert anchors.count() == 0                      # released at 0 and 1, idle behind the watermark at 90
    assert statuses(k.v.all_of("outcomes", upkeep.OUTCOMES)) == {1: "found", 2: "found"}
    k.process(spark.createDataFrame([("s1", at(5), A, 4), ("s1", at(95), A, 5), ("s1", at(101), A, 6), ("s1", at(111), A, 7)], SCHEMA), 1)
    got = statuses(k.v.all_of("outcomes", upkeep.OUTCOMES))
    assert got == {1: "found", 2: "found", 4: "late", 5: "found", 3: "found"}
    assert [tuple(r) for r in k.v.read("anchors", 1, upkeep.ANCHORS).select("scanner_id", "code").collect()] == [("s1", A)]
    assert statuses(k.finish()) == {**got, 6: "duplicate", 7: "found"}


def test_replayed_batches_change_nothing(spark, scratch, catalogue):
    k = keeper(spark, scratch, catalogue, delay_s=1)
    batches = [spark.createDataFrame([("s1", at(10 * b + x), A, 10 * b + i) for i, x in enumerate((0, 1, 2.5, 4))], SCHEMA)
               for b in range(3)]
    for b, again in ((0, 2), (1, 1), (2, 3)):
        for _ in range(again):
            k.process(batches[b], b)
    out = k.finish()
    assert out.count() == 12
    whole = batches[0].unionByName(batches[1]).unionByName(batches[2])
    assert statuses(out) == statuses(scans.scan_lookup(whole, *catalogue, 2.0))


MOVES = "seq long, product_id long, transaction_type string, quantity long"


def moves(rng, lo, hi):
    return [(k, rng.choice([1, 1, 2, 9]), rng.choice(["in", "out", "out"]), rng.randint(1, 6)) for k in range(lo, hi)]


def test_kept_stock_survives_a_killed_batch(spark, scratch):
    """The stream is killed after a batch has written its tables; run again, it
    replays the batch and ends with the stock of one ordered batch job."""
    rng = random.Random(2)
    opening = spark.createDataFrame([(1, 5), (2, 0)], "product_id long, opening long")
    src, rows = os.path.join(scratch, "moves"), []
    for f in range(3):
        part = moves(rng, 40 * f, 40 * f + 40)
        rows += part
        spark.createDataFrame(part, MOVES).coalesce(1).write.parquet(f"{src}/f{f}")
    kept = upkeep.LedgerUpkeep(upkeep.Versions(spark, os.path.join(scratch, "stock")), opening)
    fail = [1]

    def process(batch, batch_id):
        kept.process(batch, batch_id)
        if batch_id == 1 and fail:
            fail.pop()
            raise RuntimeError("killed")

    def stream():
        return spark.readStream.schema(MOVES).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")

    checkpoint = os.path.join(scratch, "checkpoint")
    with pytest.raises(Exception, match="killed"):
        upkeep.run(stream(), process, checkpoint)
    upkeep.run(stream(), process, checkpoint)
    whole = ledger.apply_ledger(spark.createDataFrame(rows, MOVES), opening)
    want = {r.product_id: r.quantity for r in ledger.stock_on_hand(whole, opening).collect()}
    assert {r.product_id: r.quantity for r in kept.stock().collect()} == want
    got = kept.v.all_of("decisions", whole.schema)
    assert sorted(map(tuple, got.select("seq", "accepted", "balance_after").collect())) == sorted(
        map(tuple, whole.select("seq", "accepted", "balance_after").collect()))
    assert kept.v.last("stock") == 2
