"""Structured Streaming forms of the scan and ledger jobs.

* ``scan_stream`` (R1): scans arrive on a stream; each is cleaned and
  validated, duplicate scans are dropped per scanner with the anchor rule of
  ``operators.scans`` (state per scanner: last accepted code and its time),
  and the survivors are looked up in the (static) catalogue.  Every scan gets a
  row: a valid one older than the watermark has status ``late`` and leaves the
  state alone.  So there is no event-time timeout, under which Spark discards
  rows behind the watermark before the fold sees them, and the state keeps two
  values for each scanner ever seen.
* ``ledger_stream`` (R2): stock movement requests arrive on a stream; the
  opening stock is joined on from the static stock table, and a per-product
  state holds the running balance, so a rejected 'out' does not consume.

Both use ``applyInPandasWithState``.  Within a micro-batch the rows of a key
are sorted by event order before the fold; across micro-batches the order is
arrival order, so the stream equals the batch job for in-order input.  The
rows of one key in one micro-batch are bounded by the source's
``maxFilesPerTrigger`` / ``maxBytesPerTrigger``.  A scanner's are sorted in
runs, which are merged from a temporary file of the task when there are several.
"""

from __future__ import annotations

import os
import pickle
import tempfile
from bisect import bisect_left
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stockfair.functions import barcode
from stockfair.operators import catalog, ledger

SCAN_STATE = T.StructType([T.StructField("code", T.StringType()),
                           T.StructField("anchor_us", T.LongType())])
BALANCE_STATE = T.StructType([T.StructField("balance", T.LongType()),
                              T.StructField("known", T.BooleanType())])

#: Rows of a key that a task sorts in memory at a time, and rows of a piece of such a sorted run on disk.
RUN_ROWS, PIECE_ROWS = 100_000, 1_000


def _place(pdf: pd.DataFrame, order: list[str], row: int) -> tuple:
    """What the rows of sorted frames are compared by (NULLs last)."""
    values = [pdf[c].iat[row] for c in order]
    return tuple((True, None) if pd.isna(v) else (False, v) for v in values)


def _runs(batches: Iterator[pd.DataFrame], order: list[str], run_rows: int) -> Iterator[pd.DataFrame]:
    """Sorted frames of ``run_rows`` rows and up to a batch more; ``_turn`` numbers the rows as they came."""
    held, rows, turn = [], 0, 0
    for pdf in batches:
        held.append(pdf.assign(_turn=range(turn, turn + len(pdf))))
        rows, turn = rows + len(pdf), turn + len(pdf)
        if rows >= run_rows:
            run, held, rows = pd.concat(held), [], 0
            yield run.sort_values(order, ignore_index=True)
    if held:
        yield pd.concat(held).sort_values(order, ignore_index=True)


def _written(run: pd.DataFrame, order: list[str], piece_rows: int, file: BinaryIO) -> list[tuple]:
    """Appends a sorted run to ``file`` in pieces: (place of its first row, offset) of each."""
    pieces = []
    for k in range(0, len(run), piece_rows):
        pieces.append((_place(run, order, k), file.tell()))
        pickle.dump(run.iloc[k:k + piece_rows], file, pickle.HIGHEST_PROTOCOL)
    return pieces


def _read(file: BinaryIO, offset: int) -> pd.DataFrame:
    file.seek(offset)
    return pickle.load(file)


def in_order(batches: Iterator[pd.DataFrame], order: list[str], run_rows: int = RUN_ROWS,
             piece_rows: int = PIECE_ROWS) -> Iterator[pd.DataFrame]:
    """The rows of ``batches`` by ``order`` (NULLs last, ties as they came) in consecutive
    frames.  Runs of ``run_rows`` are sorted in memory; when there are several, they go to a
    temporary file in pieces.  Pieces come back in the order of their first rows, and what
    lies before the next piece's first row is complete.  A few runs are held at a time, and
    of each run on disk at most one piece that is not yet given out."""
    order, last, pieces, rest = [*order, "_turn"], None, [], None
    folders = os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()).split(",")
    with tempfile.TemporaryFile(dir=folders[os.getpid() % len(folders)]) as file:
        for run in _runs(batches, order, run_rows):
            if last is not None:
                pieces += _written(last, order, piece_rows, file)
            last = run
        if not pieces:
            if last is not None:
                yield last.drop(columns="_turn")
            return
        pieces += _written(last, order, piece_rows, file)
        last = run = None
        pieces.sort()
        step = -(-run_rows // piece_rows)
        for k in range(0, len(pieces), step):
            rest = pd.concat([rest, *(_read(file, at) for _, at in pieces[k:k + step])]).sort_values(order, ignore_index=True)
            whole = len(rest)
            if k + step < len(pieces):
                whole = bisect_left(range(len(rest)), pieces[k + step][0], key=lambda i: _place(rest, order, i))
            if whole:
                yield rest.iloc[:whole].drop(columns="_turn")
            rest = rest.iloc[whole:]


def _dedupe_fn(timeout_us: int):
    def fn(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        code, anchor = (state.get if state.exists else (None, None))
        watermark = state.getCurrentWatermarkMs()
        for pdf in in_order(batches, ["_us", "scan_id"]):
            flags, lates = [], []
            for c, t, ms in zip(pdf["code"].tolist(), pdf["_us"].tolist(), pdf["_ms"].tolist()):
                # a scan without a time is no duplicate and no anchor
                late, dup = not pd.isna(ms) and ms < watermark, False
                if not late and not pd.isna(t):
                    dup = code is not None and c == code and abs(t - anchor) < timeout_us
                    # a scan of an earlier time, from a later file, does not move the anchor back
                    if not dup and (anchor is None or t >= anchor):
                        code, anchor = c, int(t)
                flags.append(dup)
                lates.append(late)
            yield pdf.drop(columns=["_us", "_ms"]).assign(duplicate=flags, late=lates)
        if anchor is not None:
            state.update((code, anchor))
    return fn


def scan_stream(scans: DataFrame, products: DataFrame, inventory: DataFrame,
                timeout_s: float = 2.0, watermark: str = "1 hour") -> DataFrame:
    """R1.  ``scans`` is a streaming DataFrame (scanner_id, ts, barcode,
    scan_id); returns the streaming outcome rows (append mode): invalid, late
    (valid, older than the watermark), duplicate, found or not_found."""
    t_us = int(round(timeout_s * 1_000_000))
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    s = (scans.withColumn("_us", F.timestamp_diff("MICROSECOND", epoch,
                                                  F.col("ts").cast("timestamp_ntz")))
         .withColumn("ts", F.col("ts").cast("timestamp"))
         .withColumn("_ms", F.unix_millis("ts"))
         .withWatermark("ts", watermark)
         .withColumn("code", barcode.clean("barcode"))
         .withColumn("valid", barcode.is_valid(F.col("code"))))
    # a group's rows wait in the JVM until all are there, so only what is needed, and a barcode
    # that is its code is not sent twice
    valid = s.where(F.col("valid")).select(
        "scanner_id", "ts", F.when(F.col("barcode") != F.col("code"), F.col("barcode")).alias("barcode"),
        "scan_id", "code", "_us", "_ms")
    out_schema = T.StructType([f for f in valid.schema.fields if f.name not in ("_us", "_ms")]
                              + [T.StructField("duplicate", T.BooleanType()),
                                 T.StructField("late", T.BooleanType())])
    flagged = valid.groupBy("scanner_id").applyInPandasWithState(
        _dedupe_fn(t_us), out_schema, SCAN_STATE, "append", GroupStateTimeout.NoTimeout)
    # the operator gives rows of an Arrow batch, which a shuffle (a join that is no broadcast)
    # cannot write; a projection makes them rows that it can
    flagged = flagged.select(
        "scanner_id", "ts", F.coalesce("barcode", "code").alias("barcode"), "scan_id", "code", F.lit(True).alias("valid"),
        F.when(F.col("late"), F.lit("late")).when(F.col("duplicate"), F.lit("duplicate")).alias("_outcome"))
    invalid = s.where(~F.col("valid")).select("scanner_id", "ts", "barcode", "scan_id", "code", "valid",
                                              F.lit("invalid").alias("_outcome"))
    sp = catalog.stocked_products(products, inventory).select(
        F.col("ean_upc").alias("_ean"), F.col("id").alias("product_id"), "sku", "name", "quantity")
    both = flagged.unionByName(invalid)
    j = both.join(sp, both.code == sp._ean, "left")
    status = F.coalesce("_outcome", F.when(F.col("product_id").isNotNull(), F.lit("found"))
                        .otherwise(F.lit("not_found")))
    return j.select("scanner_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "barcode",
                    "scan_id", "code", status.alias("status"),
                    *[F.when(F.col("valid"), F.col(c)).alias(c)
                      for c in ("product_id", "sku", "name", "quantity")])


def _ledger_fn(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    # the batch job's order: without a seq first, equal ones by type and quantity
    pdf = pd.concat(list(batches), ignore_index=True).sort_values(
        ["seq", "transaction_type", "quantity"], kind="stable", na_position="first")
    if state.exists:
        bal, known = state.get
    else:
        first = pdf["_open"].iloc[0]
        known = not pd.isna(first)
        bal = int(first) if known else None
    accepted, reasons, after = [], [], []
    for typ, q in zip(pdf["transaction_type"].tolist(), pdf["quantity"].tolist()):
        reason = None
        if typ not in ("in", "out"):
            reason = ledger.INVALID_TYPE
        elif q is None or pd.isna(q) or q <= 0:
            reason = ledger.INVALID_QUANTITY
        elif not known:
            reason = ledger.UNKNOWN_PRODUCT if typ == "out" else None
        elif typ == "in":
            bal += int(q)
        elif bal >= q:
            bal -= int(q)
        else:
            reason = ledger.INSUFFICIENT_STOCK
        accepted.append(reason is None)
        reasons.append(reason)
        after.append(bal if known else None)
    state.update((bal, known))
    out = pdf.drop(columns=["_open"]).assign(accepted=accepted, reason=reasons,
                                             balance_after=pd.array(after, dtype="Int64"))
    yield out


def ledger_stream(movements: DataFrame, opening: DataFrame) -> DataFrame:
    """R2.  ``movements`` is a streaming DataFrame (seq, product_id,
    transaction_type, quantity, ...); ``opening`` the static (product_id,
    opening) snapshot.  Output: the movement columns plus accepted, reason,
    balance_after (append mode)."""
    o = opening.select("product_id", F.col("opening").alias("_open"))
    m = movements.join(o, "product_id", "left")
    out_schema = T.StructType(
        list(movements.schema.fields)
        + [T.StructField("accepted", T.BooleanType()), T.StructField("reason", T.StringType()),
           T.StructField("balance_after", T.LongType())])
    return m.groupBy("product_id").applyInPandasWithState(
        _ledger_fn, out_schema, BALANCE_STATE, "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream with an ``availableNow`` trigger into a parquet sink in the
    shared checkpoint folder and return the written rows as a batch
    DataFrame (nothing goes through the driver)."""
    import uuid

    from stockfair.session import ensure_checkpoint_dir

    base = ensure_checkpoint_dir(stream.sparkSession).rstrip("/")
    run = f"{base}/streams/{name}-{uuid.uuid4().hex}"
    q = (stream.writeStream.format("parquet").outputMode("append")
         .option("path", f"{run}/out").option("checkpointLocation", f"{run}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{run}/out")
