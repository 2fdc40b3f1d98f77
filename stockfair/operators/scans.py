"""Barcode scan jobs: clean/validate codes, drop duplicate scans, look scans
up in the catalogue, and summarise scan batches.

Duplicate rule (per scanner, in time order, over valid scans only): a scan is
a duplicate when its code equals the code of the last *accepted* scan and it
came less than ``timeout`` seconds after it.  Duplicates do not move that
anchor, so for one code scanned at 0, 1.5 and 2.5 s (timeout 2 s) the flags
are no, yes, no -- a plain ``lag`` would call the third a duplicate too.

Plan for the duplicate flags, without a walk:

1. valid scans are numbered by (scanner, time, id); the previous scan of the
   scanner comes from blocks of numbers, so a busy scanner-hour is spread over tasks;
2. islands: a new island starts where the code changes or the gap to the
   previous scan is >= timeout (such a gap always exceeds the distance to the
   anchor, so the anchor resets there);
3. a scan less than the timeout after its island's start is settled: the start is
   an anchor, the others are its duplicates;
4. in longer islands each remaining scan points at the first one at or after its time
   plus the timeout, which is the anchor behind it if it is one itself.  The first
   remaining scan of an island is an anchor; the anchors are what its pointers reach.
   They are found by pointer doubling: every round doubles the reach, so rounds
   grow with the logarithm of an island's anchors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockfair.functions import barcode
from stockfair.operators import catalog, sequential
from stockfair.session import cut_lineage

# Scan outcomes.
INVALID, DUPLICATE, FOUND, NOT_FOUND = "invalid", "duplicate", "found", "not_found"

def _micros(c: str) -> Column:
    """Microseconds since 1970-01-01 of a wall-clock timestamp, without any
    time zone (the session time zone and its DST changes play no part)."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, F.col(c).cast("timestamp_ntz"))


def with_code(scans: DataFrame, col: str = "barcode") -> DataFrame:
    """B1 + B2: cleaned code and its validity."""
    return (scans.withColumn("code", barcode.clean(col))
            .withColumn("valid", barcode.is_valid(F.col("code"))))


def duplicate_flags(valid_scans: DataFrame, timeout_s: float = 2.0, key: str = "scanner_id",
                    ts: str = "ts", tie: str = "scan_id",
                    block_rows: int = sequential.DEFAULT_BUCKET) -> DataFrame:
    """B4.  ``valid_scans`` (with ``code``) gets a boolean ``duplicate``."""
    timed = valid_scans.withColumn("_time", _micros(ts))
    return flags_in_order(timed, timeout_s, key, "_time", tie, block_rows).drop("_time")


def flags_in_order(timed: DataFrame, timeout_s: float, key: str, time: str, tie: str,
                   block_rows: int = sequential.DEFAULT_BUCKET) -> DataFrame:
    """``duplicate_flags`` of scans whose time is the microseconds column ``time``."""
    t_us = int(round(timeout_s * 1_000_000))
    keep = list(timed.columns)
    p = sequential.numbered(timed.withColumn("_us", F.col(time)), [key, "_us", tie], "_n")
    p = sequential.neighbours(p, [key], "_n", ["code", "_us"], "_prev", block_rows=block_rows)
    new_island = (F.col("_prev").isNull() | (F.col("code") != F.col("_prev.code"))
                  | (F.col("_us") - F.col("_prev._us") >= t_us))
    p = p.withColumn("_start", F.when(new_island, F.struct("_n", "_us")))
    # the first valid scan of a scanner starts an island, so every row finds one;
    # read twice below (settled rows, anchors of long islands): materialise once
    p = cut_lineage(sequential.carried(p, [key], "_n", "_start", "_island", block_rows=block_rows).drop("_prev", "_start"))
    near = F.col("_us") - F.col("_island._us") < t_us
    fast = p.where(near).select(*keep, (F.col("_n") != F.col("_island._n")).alias("duplicate"))
    slow = p.where(~near).withColumn("_island", F.col("_island._n"))
    if slow.limit(1).count() == 0:
        return fast
    anchors = reached(next_after(slow.select("_island", "_n", "_us"), t_us, block_rows)).withColumn("_anchor", F.lit(True))
    slow = slow.join(anchors, "_n", "left").select(*keep, F.col("_anchor").isNull().alias("duplicate"))
    return fast.unionByName(slow)


def next_after(points: DataFrame, distance: int, block_rows: int = sequential.DEFAULT_BUCKET) -> DataFrame:
    """(_n, to, first) of points (_island, _n, _us): ``to`` is the first point of the
    island at or after ``_us`` + ``distance`` (NULL: none), ``first`` marks each island's
    first point.  Points and the places they ask about are put in one order, and each
    place takes the nearest point at or behind it."""
    both = points.select("_island", "_us", F.lit(1).alias("_kind"), "_n").unionByName(
        points.select("_island", (F.col("_us") + F.lit(distance)).alias("_us"), F.lit(0).alias("_kind"), "_n"))
    both = sequential.numbered(both, ["_island", "_us", "_kind", "_n"], "_m") \
        .withColumn("_point", F.when(F.col("_kind") == 1, F.col("_n")))
    found = sequential.carried(both, ["_island"], "_m", "_point", "to", after=True, block_rows=block_rows)
    first = points.groupBy("_island").agg(F.min("_n").alias("_n")).select("_n", F.lit(True).alias("first"))
    return found.where(F.col("_kind") == 0).select("_n", "to").join(first, "_n", "left").select(
        "_n", "to", F.coalesce("first", F.lit(False)).alias("first"))


def reached(pointers: DataFrame) -> DataFrame:
    """(_n) of what the ``first`` ones of (_n, to, first) reach by following ``to``,
    themselves included.  A round goes as far from all that is reached as has
    been gone so far, then doubles the pointers; it is written to the checkpoint folder."""
    jump = cut_lineage(pointers)
    while True:
        hops = jump.where("first AND to IS NOT NULL").select(F.col("to").alias("_n"), F.lit(True).alias("_hit")).distinct()
        far = jump.select(F.col("_n").alias("to"), F.col("to").alias("_far"))
        jump = cut_lineage(jump.join(hops, "_n", "left").join(far, "to", "left").select(
            "_n", F.col("_far").alias("to"), F.coalesce("_hit", "first").alias("first"),
            (F.col("_hit").isNotNull() & ~F.col("first")).alias("_new")))
        if jump.where("_new").limit(1).count() == 0:
            return jump.where("first").select("_n")
        jump = jump.drop("_new")


def scan_dedupe(scans: DataFrame, timeout_s: float = 2.0, key: str = "scanner_id",
                ts: str = "ts", tie: str = "scan_id") -> DataFrame:
    """B4 on raw scans: every scan with ``code``, ``valid`` and ``duplicate``
    (NULL for invalid scans, which do not touch the anchor; a valid scan
    without a time is no duplicate and no anchor)."""
    s = with_code(scans)
    ordered = F.coalesce(F.col("valid"), F.lit(False)) & F.col(ts).isNotNull()
    dup = duplicate_flags(s.where(ordered), timeout_s, key, ts, tie)
    rest = s.where(~ordered).withColumn("duplicate", F.when(F.col("valid"), F.lit(False)))
    return dup.unionByName(rest)


def scan_lookup(scans: DataFrame, products: DataFrame, inventory: DataFrame,
                timeout_s: float = 2.0, key: str = "scanner_id", ts: str = "ts",
                tie: str = "scan_id") -> DataFrame:
    """B5.  Outcome of every scan: invalid, duplicate (with the product of the
    anchor scan, which has the same code), found or not_found."""
    d = scan_dedupe(scans, timeout_s, key, ts, tie)
    sp = catalog.stocked_products(products, inventory).select(
        F.col("ean_upc").alias("_ean"), F.col("id").alias("product_id"), "sku", "name",
        "quantity")
    j = d.join(sp, d.code == sp._ean, "left")
    status = (F.when(~F.col("valid"), F.lit(INVALID))
              .when(F.col("duplicate"), F.lit(DUPLICATE))
              .when(F.col("product_id").isNotNull(), F.lit(FOUND))
              .otherwise(F.lit(NOT_FOUND)))
    prod = F.col("valid")
    return j.select(*scans.columns, "code", status.alias("status"),
                    *[F.when(prod, F.col(c)).alias(c)
                      for c in ("product_id", "sku", "name", "quantity")])


def batch_scan(scans: DataFrame, products: DataFrame, inventory: DataFrame,
               col: str = "barcode") -> DataFrame:
    """B6 rows: each scan of a batch, cleaned, validated and looked up (no
    duplicate check; a code scanned twice yields its product twice)."""
    s = with_code(scans, col)
    sp = catalog.stocked_products(products, inventory).select(
        F.col("ean_upc").alias("_ean"), F.col("id").alias("product_id"), "sku", "name",
        "quantity")
    return s.join(sp, F.col("valid") & (s.code == sp._ean), "left").drop("_ean")


def batch_scan_summary(scans: DataFrame, products: DataFrame, inventory: DataFrame,
                       batch_col: str = "scanner_id") -> DataFrame:
    """B6 counters per batch: total = found + not_found + invalid."""
    r = batch_scan(scans, products, inventory)
    return r.groupBy(batch_col).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("valid") & F.col("product_id").isNotNull()).alias("found"),
        F.count_if(F.col("valid") & F.col("product_id").isNull()).alias("not_found"),
        F.count_if(~F.col("valid")).alias("invalid"),
    )


def batch_scan_products(scans: DataFrame, products: DataFrame, inventory: DataFrame) -> DataFrame:
    """B6 product list: one row per found scan."""
    r = batch_scan(scans, products, inventory)
    return r.where(F.col("product_id").isNotNull())
