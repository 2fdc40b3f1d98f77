"""Streams whose state is a set of tables, kept micro-batch by micro-batch.

``scan_upkeep`` (R1) releases scans in event-time order: valid scans wait in a table
until the watermark has passed them, then they are decided together with each scanner's
last accepted scan by the batch operator.  ``ledger_upkeep`` (R2) keeps the stock table
itself: a micro-batch's movements are decided against the stock of the batch before.

Every table is written anew per batch id (``<folder>/<table>/batch=<id>``) from the
version before, so a micro-batch that is run again after a failure reads what it read
the first time and overwrites what it wrote: nothing is applied twice.  The work of a
micro-batch is Spark jobs over its rows and the tables, so a scanner or product with
most of the rows is spread over tasks as in the batch jobs.  Versions older than the
one before are removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockfair.operators import catalog, ledger, scans
from stockfair.session import cut_lineage

LATE = "late"


class Versions:
    """Tables of one stream by batch id, under ``folder`` (on the shared file system)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, table: str, batch: int) -> str:
        return f"{self.folder}/{table}/batch={batch}"

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def last(self, table: str) -> int:
        """The newest batch with a complete version of the table, -1 without one."""
        fs, p = self._at(f"{self.folder}/{table}/batch=*/_SUCCESS")
        found = fs.globStatus(p) or []
        return max((int(f.getPath().getParent().getName().split("=")[1]) for f in found), default=-1)

    def read(self, table: str, batch: int, schema: T.StructType) -> DataFrame:
        if batch < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._path(table, batch))

    def write(self, table: str, batch: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self._path(table, batch))

    def forget(self, table: str, batch: int) -> None:
        """Remove the version of ``batch`` where there is one."""
        fs, p = self._at(self._path(table, batch))
        if batch >= 0 and fs.exists(p):
            fs.delete(p, True)

    def all_of(self, table: str, schema: T.StructType) -> DataFrame:
        """The rows of every batch of an output table."""
        if self.last(table) < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{table}")


ANCHORS = T.StructType([T.StructField("scanner_id", T.StringType()), T.StructField("code", T.StringType()),
                        T.StructField("_us", T.LongType())])
CLOCK = T.StructType([T.StructField("us", T.LongType())])
SCANS = T.StructType([T.StructField("scanner_id", T.StringType()), T.StructField("ts", T.TimestampNTZType()),
                      T.StructField("barcode", T.StringType()), T.StructField("scan_id", T.LongType())])
OUTCOMES = T.StructType([*SCANS.fields, T.StructField("code", T.StringType()), T.StructField("status", T.StringType()),
                         T.StructField("product_id", T.LongType()), T.StructField("sku", T.StringType()),
                         T.StructField("name", T.StringType()), T.StructField("quantity", T.LongType())])


class ScanUpkeep:
    """Event-time scan outcomes.  Tables: ``waiting`` (valid scans the watermark has
    not passed), ``anchors`` (each scanner's last accepted scan, while it can still make a
    duplicate), ``clock`` (the latest scan time so far) and ``outcomes`` (one row per scan:
    invalid, late, duplicate, found or not_found).

    The watermark of a micro-batch is the latest time of the batches before it, less
    ``delay_s``.  A valid scan older than that is late and touches nothing; a scan without
    a time is looked up at once and is no anchor.  Scans older than the new watermark
    are decided in time order (then scan id): no later scan can come before them."""

    def __init__(self, versions: Versions, products: DataFrame, inventory: DataFrame, timeout_s: float = 2.0,
                 delay_s: float = 3600.0):
        self.v, self.products, self.inventory = versions, products, inventory
        self.timeout_s = timeout_s
        self.timeout_us, self.delay_us = (int(round(x * 1_000_000)) for x in (timeout_s, delay_s))

    def process(self, batch: DataFrame, batch_id: int, finish: bool = False) -> None:
        """Decide micro-batch ``batch_id``; with ``finish`` nothing waits any longer."""
        before = batch_id - 1
        rows = scans.with_code(batch.select(
            F.col("scanner_id").cast("string").alias("scanner_id"), F.col("ts").cast("timestamp_ntz").alias("ts"),
            "barcode", F.col("scan_id").cast("long").alias("scan_id"))).withColumn("_us", scans._micros("ts"))
        rows = cut_lineage(rows)
        old = self.v.read("clock", before, CLOCK).agg(F.max("us")).first()[0]
        seen = rows.where("valid").agg(F.max("_us")).first()[0]
        latest = max((x for x in (old, seen) if x is not None), default=None)
        mark = None if old is None else old - self.delay_us
        ordered = rows.where(F.col("valid") & F.col("_us").isNotNull())
        late = F.lit(False) if mark is None else F.col("_us") < mark
        waiting = self.v.read("waiting", before, SCANS)
        waiting = scans.with_code(waiting).withColumn("_us", scans._micros("ts"))
        everyone = cut_lineage(waiting.unionByName(ordered.where(~late)))
        done = F.lit(True) if finish else F.lit(False) if latest is None else F.col("_us") < latest - self.delay_us
        ready = everyone.where(done)
        anchors = self.v.read("anchors", before, ANCHORS)
        # each scanner's anchor goes first: it is older than every scan released now
        marked = anchors.select("scanner_id", F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(None).cast("string").alias("barcode"),
                                F.lit(None).cast("long").alias("scan_id"), "code", F.lit(True).alias("valid"), "_us")
        flagged = scans.flags_in_order(ready.unionByName(marked), self.timeout_s, "scanner_id", "_us", "scan_id")
        flagged = cut_lineage(flagged)
        decided = flagged.where(F.col("ts").isNotNull()).withColumn("late", F.lit(False)) \
            .unionByName(rows.where(~F.coalesce("valid", F.lit(False)) | F.col("_us").isNull())
                         .withColumns({"duplicate": F.lit(False), "late": F.lit(False)})) \
            .unionByName(ordered.where(late).withColumns({"duplicate": F.lit(False), "late": F.lit(True)}))
        self.v.write("outcomes", batch_id, self._outcomes(decided))
        last = flagged.where(~F.col("duplicate")).groupBy("scanner_id").agg(
            F.max_by(F.struct("code", "_us"), F.struct("_us", F.coalesce("scan_id", F.lit(-(1 << 63))))).alias("a"))
        last = last.select("scanner_id", "a.code", "a._us")
        if latest is not None:
            # a scan from now on is at the watermark or behind it: older anchors are idle
            last = last.where(F.col("_us") + self.timeout_us > latest - self.delay_us)
        self.v.write("anchors", batch_id, last)
        self.v.write("waiting", batch_id, everyone.where(~done).select(*SCANS.names))
        self.v.write("clock", batch_id, self.v.spark.createDataFrame([(latest,)], CLOCK))
        for table in ("anchors", "waiting", "clock"):
            self.v.forget(table, batch_id - 2)

    def _outcomes(self, decided: DataFrame) -> DataFrame:
        stocked = catalog.stocked_products(self.products, self.inventory).select(
            F.col("ean_upc").alias("_ean"), F.col("id").alias("product_id"), "sku", "name", "quantity")
        j = decided.join(stocked, decided.code == stocked._ean, "left")
        status = (F.when(~F.col("valid"), F.lit(scans.INVALID)).when(F.col("late"), F.lit(LATE))
                  .when(F.col("duplicate"), F.lit(scans.DUPLICATE)).when(F.col("product_id").isNotNull(), F.lit(scans.FOUND))
                  .otherwise(F.lit(scans.NOT_FOUND)))
        looked_up = [F.when(F.col("valid"), F.col(c)).cast(OUTCOMES[c].dataType).alias(c)
                     for c in ("product_id", "sku", "name", "quantity")]
        return j.select("scanner_id", "ts", "barcode", "scan_id", "code", status.alias("status"), *looked_up)

    def finish(self) -> DataFrame:
        """Release what waits (the stream has ended) and return every outcome."""
        empty = self.v.spark.createDataFrame([], SCANS)
        self.process(empty, self.v.last("clock") + 1, finish=True)
        return self.v.all_of("outcomes", OUTCOMES).select(*OUTCOMES.names)


class LedgerUpkeep:
    """The stock table of ordered movements.  Tables: ``stock`` (product_id, quantity)
    after each batch and ``decisions`` (the movements with accepted, reason and
    balance_after).  Movements of a micro-batch are applied by seq; across batches in
    arrival order."""

    STOCK = T.StructType([T.StructField("product_id", T.LongType()), T.StructField("quantity", T.LongType())])

    def __init__(self, versions: Versions, opening: DataFrame):
        self.v, self.opening = versions, opening

    def stock(self, batch_id: int | None = None) -> DataFrame:
        """On-hand stock after a batch (the newest one by default)."""
        at = self.v.last("stock") if batch_id is None else batch_id
        if at < 0:
            return self.opening.select(F.col("product_id").cast("long").alias("product_id"),
                                       F.col("opening").cast("long").alias("quantity"))
        return self.v.read("stock", at, self.STOCK)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        now = self.stock(batch_id - 1).withColumnRenamed("quantity", "opening")
        decided = cut_lineage(ledger.apply_ledger(batch, now))
        self.v.write("decisions", batch_id, decided)
        self.v.write("stock", batch_id, ledger.stock_on_hand(decided, now))
        self.v.forget("stock", batch_id - 2)


def run(stream: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Feed a stream's micro-batches to ``process`` until nothing new is there."""
    q = (stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
