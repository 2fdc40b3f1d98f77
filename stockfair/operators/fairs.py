"""Edits of the yearly event table and of fair sales (M10-M12).

Tables are immutable DataFrames: every edit returns the new table, and the
caller writes it (``sources.sinks``).  Column names given by callers are
checked against the schema instead of being spliced into SQL text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockfair import schemas


def update_event(annual_events: DataFrame, event_id, column: str, value) -> DataFrame:
    """M10.  Set ``column`` of the event ``event_id`` to ``value`` (cast to the
    column's type; a value that does not fit becomes NULL)."""
    fields = {f.name: f.dataType for f in annual_events.schema.fields}
    if column not in fields or column == "id":
        raise ValueError(f"unknown or read-only column: {column!r}")
    new = F.lit(value).try_cast(fields[column])
    return annual_events.withColumn(
        column, F.when(F.col("id") == F.lit(event_id), new).otherwise(F.col(column)))


def delete_event(annual_events: DataFrame, event_id) -> DataFrame:
    """M11.  Drop the event (dependent rows elsewhere are not touched); rows
    without an id stay, whatever ``event_id`` is."""
    return annual_events.where(~F.col("id").eqNullSafe(F.lit(event_id)) | F.col("id").isNull())


def create_events(annual_events: DataFrame, new_rows: DataFrame) -> DataFrame:
    """M12 (create_event): append rows conformed to the table schema; ids
    continue after the current maximum, in the order of ``new_rows.seq`` when
    given."""
    start = annual_events.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    order = "seq" if "seq" in new_rows.columns else new_rows.columns[0]
    numbered = dense_ids(new_rows, order, "_n")
    rows = numbered.withColumn("id", F.lit(start) + F.col("_n"))
    return annual_events.unionByName(schemas.conform(rows, "annual_events"))


def create_fairs(fairs: DataFrame, new_rows: DataFrame) -> DataFrame:
    """M12 (create_event on the event calendar): append fairs with name, dates,
    location and description; ids continue after the current maximum, in the
    order of (start_date, name)."""
    start = fairs.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    rows = new_rows.select("name", "start_date", "end_date", "location", "description")
    numbered = dense_ids(rows.withColumn("_o", F.struct("start_date", "name")), "_o", "_n")
    added = numbered.select((F.lit(start) + F.col("_n")).alias("id"), *rows.columns)
    return fairs.select("id", *rows.columns).unionByName(added)


def assign_products(assignments: DataFrame, requests: DataFrame) -> DataFrame:
    """M12 (assign_product_to_event): append one assignment per request row
    (event_id, product_id, quantity, sale_price); ids continue after the
    current maximum, in (event, product) order.  Stock is not checked: that is
    what the allocation jobs do."""
    start = assignments.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    rows = requests.select("event_id", "product_id", F.col("quantity").cast("long").alias("quantity_assigned"),
                           F.col("sale_price").cast("double").alias("event_sale_price"))
    numbered = dense_ids(rows.withColumn("_o", F.struct("event_id", "product_id")), "_o", "_n")
    added = numbered.select((F.lit(start) + F.col("_n")).alias("id"), *rows.columns)
    return assignments.select("id", *rows.columns).unionByName(added)


def dense_ids(df: DataFrame, order: str | list[str], out: str) -> DataFrame:
    """1, 2, 3 ... in ``order`` without a single-partition window and without
    Python: range-partition and sort by ``order``, store (so partition
    membership is fixed), count rows per partition (a table with one row per
    partition), prefix-sum those counts, and add each row's position inside
    its partition (from ``monotonically_increasing_id``).  Ties in ``order``
    are numbered in an arbitrary but fixed way."""
    from pyspark.sql import Window

    from stockfair.session import stored

    by = [order] if isinstance(order, str) else order
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
                    .withColumn("_pid", F.spark_partition_id())
                    .withColumn("_mono", F.monotonically_increasing_id()))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    # ``offsets`` has one row per partition: a proven size bound for broadcast
    j = ranged.join(F.broadcast(offsets), "_pid", "inner")
    within = F.col("_mono") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return j.withColumn(out, (F.col("_off") + within + 1).cast("long")).drop(
        "_pid", "_mono", "_off")


def record_sales(sales: DataFrame, assignments: DataFrame) -> DataFrame:
    """M12 (record_sale): decide new sale rows.  A sale needs an assignment of
    its product to its fair (own rule: the original only names the call);
    quantity must be positive."""
    keys = assignments.select("event_id", "product_id").distinct().withColumn("_assigned",
                                                                              F.lit(True))
    j = sales.join(keys, ["event_id", "product_id"], "left")
    reason = (F.when(F.col("quantity").isNull() | (F.col("quantity") <= 0), F.lit("invalid_quantity"))
              .when(F.col("_assigned").isNull(), F.lit("not_assigned")))
    return j.select(*sales.columns, reason.isNull().alias("accepted"), reason.alias("reason"))


def append_sales(event_sales: DataFrame, decisions: DataFrame) -> DataFrame:
    """The sales table with the accepted new sales appended."""
    new = decisions.where(F.col("accepted")).select(*event_sales.columns)
    return event_sales.unionByName(new)
