"""Stock movements (stock in / stock out) applied as an ordered batch.

Rules of a single movement, applied in ``seq`` order per product (rows without a
seq first; rows of equal seq by their other columns, type and quantity first):

* quantity NULL or <= 0 -> rejected (``invalid_quantity``), balance unchanged;
  a type other than 'in'/'out' -> rejected (``invalid_type``);
* 'in'  -> accepted, balance += quantity;
* 'out' -> accepted and balance -= quantity if balance >= quantity, otherwise
  rejected (``insufficient_stock``) and the balance is unchanged;
* a product without any stock row (unknown): 'in' is accepted but there is no
  balance to change (NULL); 'out' is rejected (``unknown_product``).

A rejection feeds back into later decisions, so this is not a plain running
sum.  Plan:

1. static checks per row (no order needed);
2. an exact prefix sum of the signed quantities per product;
3. rows of a product before its first would-be-negative balance are final
   (the running sum is the real balance there) - usually almost all rows;
4. only the rows from that point on are walked in order, starting from the
   balance just before it.

Rows are dealt out by product once; the sum is a window over a product's rows and the
walk streams them.  Products with very many rows (``sequential.apart``) are numbered
instead and summed (``sequential.running_sum``) and walked (``sequential.block_fold``) in
blocks, from guessed balances and again where a block's start was wrong.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockfair.operators import sequential
from stockfair.session import stored

# Rejection reasons.
INVALID_TYPE = "invalid_type"
INVALID_QUANTITY = "invalid_quantity"
UNKNOWN_PRODUCT = "unknown_product"
INSUFFICIENT_STOCK = "insufficient_stock"


def opening_balances(inventory: DataFrame) -> DataFrame:
    """On-hand stock per product (several stock rows of a product are summed)."""
    return inventory.groupBy("product_id").agg(F.sum("quantity").cast("long").alias("opening"))


def apply_ledger(movements: DataFrame, opening: DataFrame | None = None,
                 bucket_width: int = sequential.DEFAULT_BUCKET,
                 order: tuple[str, ...] = ("seq", "transaction_type", "quantity"),
                 is_stored: bool = False) -> DataFrame:
    """M1-M3.  Decide every movement.  ``opening`` has (product_id, opening);
    when None, every product starts known with 0.  A product's rows run by ``order``, then
    by the other columns.  ``movements`` are stored first unless they come from stored rows
    (``is_stored``).  Returns the movement columns plus ``accepted``, ``reason`` and
    ``balance_after``."""
    light, heavy = sequential.apart(movements if is_stored else stored(movements), ["product_id"], bucket_width)
    m = _checked(light, opening)
    rest = [f.name for f in m.schema.fields
            if f.name not in ("product_id", *order) and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    upto = Window.partitionBy("product_id").orderBy(*order, *rest).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    m = m.withColumn("_bal", F.col("_open") + F.sum("_delta").over(upto)).withColumn("_n", F.row_number().over(upto))
    fell = F.col("product_id").isNotNull() & (F.col("_bal") < 0)
    m = m.withColumn("_start", F.first(F.when(fell, F.col("_bal") - F.col("_delta")), ignorenulls=True).over(upto))
    # read twice below (final rows, ordered walk): materialise once
    out = _decided(stored(m), movements.schema)
    return out if heavy is None else out.unionByName(_decided_in_blocks(heavy, opening, bucket_width, order))


def _checked(movements: DataFrame, opening: DataFrame | None) -> DataFrame:
    """The movements with their static checks, opening balance and signed quantity."""
    q, typ = F.col("quantity"), F.col("transaction_type")
    if opening is None:
        m = movements.withColumn("_open", F.lit(0).cast("long")).withColumn("_known", F.lit(True))
    else:
        o = opening.select("product_id", F.col("opening").alias("_open"))
        m = (movements.join(o, "product_id", "left")
             .withColumn("_known", F.col("_open").isNotNull()))
    static = (F.when(typ.isNull() | ~typ.isin("in", "out"), F.lit(INVALID_TYPE))
              .when(q.isNull() | (q <= 0), F.lit(INVALID_QUANTITY))
              .when(~F.col("_known") & (typ == "out"), F.lit(UNKNOWN_PRODUCT)))
    m = m.withColumn("_static", static)
    delta = F.when(F.col("_static").isNull() & F.col("_known"),
                   F.when(typ == "in", q).otherwise(-q)).otherwise(F.lit(0).cast("long"))
    return m.withColumn("_delta", delta)


def _decided(m: DataFrame, in_schema: T.StructType, block_rows: int | None = None) -> DataFrame:
    """The decisions on the stored rows ``m`` with their balance if nothing fails
    (``_bal``), their number ``_n`` and, from a product's first would-be-negative balance
    on, the balance before it (``_start``); in blocks of ``block_rows`` numbers when given."""
    in_cols = in_schema.names
    fast_out = m.where(F.col("_start").isNull()).select(
        *in_cols,
        F.col("_static").isNull().alias("accepted"),
        F.col("_static").alias("reason"),
        F.when(F.col("_known"), F.col("_bal")).alias("balance_after"),
    )
    slow = m.where(F.col("_start").isNotNull()).select(*in_cols, "_static", "_start", "_delta", "_n")
    out_schema = T.StructType(
        [f for f in in_schema.fields]
        + [T.StructField("accepted", T.BooleanType()), T.StructField("reason", T.StringType()),
           T.StructField("balance_after", T.LongType())])
    n_slow = slow.count()
    if n_slow == 0:
        return fast_out

    def step(b, v):
        typ, qty, static = v[0], v[1], v[2]
        if static is not None:
            return b, (False, static, b)
        if typ == "in":
            b += int(qty)
        elif b >= qty:
            b -= int(qty)
        else:
            return b, (False, INSUFFICIENT_STOCK, b)
        return b, (True, None, b)

    inputs, outputs = ["transaction_type", "quantity", "_static"], ["accepted", "reason", "balance_after"]
    if block_rows is None:
        slow_out = sequential.sorted_fold(slow, ["product_id"], ["_n"], lambda v: int(v[-1]), step, out_schema,
                                          inputs=[*inputs, "_start"], outputs=outputs,
                                          num_partitions=sequential.parts_for(slow, n_slow))
    else:
        slow_out = sequential.block_fold(slow, "product_id", "_n", "_start", "_delta", step, out_schema,
                                         inputs=inputs, outputs=outputs, end="balance_after", block_rows=block_rows)
    return fast_out.unionByName(slow_out)


def _decided_in_blocks(movements: DataFrame, opening: DataFrame | None, bucket_width: int,
                       order: tuple[str, ...]) -> DataFrame:
    """The decisions on products with very many rows."""
    m = sequential.numbered(_checked(movements, opening), ["product_id", *order], "_n")
    m = sequential.running_sum(m, ["product_id"], "_n", "_delta", "_cum", bucket_width)
    m = m.withColumn("_bal", F.col("_open") + F.col("_cum"))
    first_neg = (m.where(F.col("_bal") < 0).groupBy("product_id")
                 .agg(F.min("_n").alias("_first_neg"),
                      F.min_by(F.col("_bal") - F.col("_delta"), F.col("_n")).alias("_from")))
    m = m.join(first_neg, "product_id", "left").withColumn(
        "_start", F.when(F.col("_n") >= F.col("_first_neg"), F.col("_from")))
    return _decided(stored(m), movements.schema, bucket_width)


def stock_on_hand(decisions: DataFrame, opening: DataFrame) -> DataFrame:
    """New on-hand stock per known product: opening + accepted ins - accepted
    outs (one partial aggregate and one join)."""
    net = (decisions.where(F.col("accepted"))
           .groupBy("product_id")
           .agg(F.sum(F.when(F.col("transaction_type") == "in", F.col("quantity"))
                      .otherwise(-F.col("quantity"))).alias("_net")))
    return (opening.join(net, "product_id", "left")
            .select("product_id",
                    (F.col("opening") + F.coalesce(F.col("_net"), F.lit(0))).cast("long")
                    .alias("quantity")))


def ledger_rows(decisions: DataFrame, ts_col: str | None = "ts") -> DataFrame:
    """K1.  ``inventory_transactions`` rows for the accepted movements (the
    transaction id is the movement's ``seq``)."""
    a = decisions.where(F.col("accepted"))
    when = F.col(ts_col) if ts_col and ts_col in decisions.columns else F.localtimestamp()
    opt = {c: (F.col(c) if c in decisions.columns else F.lit(None).cast("string"))
           for c in ("reference", "notes", "user")}
    return a.select(F.col("seq").alias("id"), "product_id", "transaction_type", "quantity",
                    opt["reference"].alias("reference"), opt["notes"].alias("notes"),
                    when.alias("transaction_date"), opt["user"].alias("user"))


def stock_log_rows(decisions: DataFrame, ts_col: str | None = "ts") -> DataFrame:
    """M4.  Audit rows for the accepted movements: 'stock_in' / 'stock_out'
    with 'Added {q} units to stock' / 'Removed {q} units from stock', linked
    to the transaction id."""
    a = decisions.where(F.col("accepted"))
    is_in = F.col("transaction_type") == "in"
    when = F.col(ts_col) if ts_col and ts_col in decisions.columns else F.localtimestamp()
    user = F.col("user") if "user" in decisions.columns else F.lit(None).cast("string")
    return a.select(
        F.col("seq").alias("id"),
        F.when(is_in, "stock_in").otherwise("stock_out").alias("event_type"),
        F.when(is_in, F.format_string("Added %d units to stock", F.col("quantity")))
        .otherwise(F.format_string("Removed %d units from stock", F.col("quantity")))
        .alias("description"),
        F.col("seq").alias("related_id"),
        when.alias("event_date"),
        user.alias("user"),
    )
