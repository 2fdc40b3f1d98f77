import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stockfair.operators import scans

T0 = dt.datetime(2024, 1, 1)
A = "5901234123457"
B = "96385074"


def _scans(spark, rows):
    data = [("s1", T0 + dt.timedelta(seconds=t), code, i) for i, (t, code) in enumerate(rows)]
    return spark.createDataFrame(data, "scanner_id string, ts timestamp_ntz, barcode string, "
                                       "scan_id long")


def _flags(df):
    return [r.duplicate for r in df.orderBy("scan_id").collect()]


def test_anchor_rule_f7(spark):
    s = _scans(spark, [(0.0, A), (1.5, A), (2.5, A), (3.0, B), (3.5, A), (5.5, A)])
    assert _flags(scans.scan_dedupe(s, 2.0)) == [False, True, False, False, False, False]


def test_long_island_has_several_anchors(spark):
    # one code every second for 9 s with timeout 2 s: anchors at 0, 2, 4, 6, 8
    s = _scans(spark, [(float(t), A) for t in range(9)])
    assert _flags(scans.scan_dedupe(s, 2.0)) == [t % 2 == 1 for t in range(9)]


def test_invalid_scans_do_not_touch_the_anchor(spark):
    s = _scans(spark, [(0.0, A), (0.5, "123"), (1.0, A)])
    assert _flags(scans.scan_dedupe(s, 2.0)) == [False, None, True]


def test_bucket_edges(spark):
    # duplicates across the hourly bucket edge are still found
    base = 3600 - 1.0
    s = _scans(spark, [(base, A), (base + 1.5, A), (base + 2.5, A)])
    assert _flags(scans.scan_dedupe(s, 2.0)) == [False, True, False]


def _walk(rows, timeout):
    """The rule scan by scan: {scan_id: duplicate}."""
    out, last = {}, {}
    for key, t, code, i in sorted(rows, key=lambda r: (r[0], r[1], r[3])):
        anchor = last.get(key)
        out[i] = anchor is not None and anchor[0] == code and (t - anchor[1]).total_seconds() < timeout
        if not out[i]:
            last[key] = (code, t)
    return out


@pytest.mark.parametrize("block", [7, 100, 1 << 16])
def test_random_bursts_equal_the_walk(spark, block):
    rng = random.Random(block)
    rows, t = [], 0.0
    for i in range(600):
        t += rng.choice([0.0, 0.1, 0.4, 0.9, 1.0, 1.9, 2.0, 2.5, 9.0])
        rows.append((rng.choice(["s1"] * 5 + ["s2"]), T0 + dt.timedelta(seconds=t), A if rng.random() < 0.9 else B, i))
    s = scans.with_code(spark.createDataFrame(rows, "scanner_id string, ts timestamp_ntz, barcode string, scan_id long"))
    got = scans.duplicate_flags(s, 2.0, block_rows=block).collect()
    assert {r.scan_id: r.duplicate for r in got} == _walk(rows, 2.0)


def test_one_long_burst(spark):
    """One code every tenth of a second for 100 s: 50 anchors in one island, and no
    Python stage in the plan."""
    rows = [("s1", T0 + dt.timedelta(milliseconds=100 * i), A, i) for i in range(1000)]
    s = scans.with_code(spark.createDataFrame(rows, "scanner_id string, ts timestamp_ntz, barcode string, scan_id long"))
    flags = scans.duplicate_flags(s, 2.0, block_rows=50)
    assert [r.scan_id for r in flags.where("NOT duplicate").orderBy("scan_id").collect()] == list(range(0, 1000, 20))
    assert "InPandas" not in flags._jdf.queryExecution().toString()


def test_batch_summary_adds_up(spark):
    from stockfair.sources.driver import DriverTables

    t = DriverTables(spark, "/root/testdata/sf0.001")
    s = scans.batch_scan_summary(t.scans(), t.products(), t.inventory()).collect()
    for r in s:
        assert r.total == r.found + r.not_found + r.invalid


def test_scans_without_time_or_scanner_are_kept(spark):
    rows = [("s1", T0, A, 0), ("s1", None, A, 1), ("s1", T0 + dt.timedelta(seconds=1), A, 2),
            (None, T0, A, 3), (None, T0 + dt.timedelta(seconds=1), A, 4), ("s1", None, "x", 5)]
    s = spark.createDataFrame(rows, "scanner_id string, ts timestamp_ntz, barcode string, scan_id long")
    assert _flags(scans.scan_dedupe(s, 2.0)) == [False, False, True, False, True, None]
