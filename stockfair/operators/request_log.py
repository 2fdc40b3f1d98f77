"""Mixed calls on one stock as one ordered log (M5, M7, M9 interleaved).

A log row is one call: ``allocate`` quantity to a fair (added to its assignment),
``change`` an assignment to quantity, or ``remove`` it.  Each call sees what the ones
before it left.  Rules by product, in the order of seq (without one first), then event,
action and quantity:

* allocate: quantity NULL or <= 0 -> ``invalid_quantity``; a product without stock rows ->
  ``unknown_product``; more than available -> ``insufficient_stock``; else the assignment
  grows and available shrinks by quantity;
* change: no assignment -> ``not_assigned``; quantity NULL or < 0 -> ``invalid_quantity``;
  an increase needs that much available, a decrease releases it;
* remove: no assignment -> ``not_assigned``; else its quantity is released.

Plan: as long as no call on a product fails for lack of stock, the assignment before a
call is what the calls on it say (the last one that set it plus what was added since,
nothing after a removal), the change of available stock follows, and a running sum tells
where it first falls short.  All calls before that are settled.  Only the calls on a
product from there on are walked in order, with available stock and the assignments
touched since as state.  Calls are dealt out by product once; products with very many
calls (``sequential.apart``) are summed over blocks of numbers instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockfair.operators import sequential
from stockfair.operators.allocation import INSUFFICIENT, INVALID_QUANTITY, NOT_ASSIGNED, UNKNOWN_PRODUCT
from stockfair.session import stored

# The calls.
ALLOCATE, CHANGE, REMOVE = "allocate", "change", "remove"
UNKNOWN_CALL = "unknown_call"

COLUMNS = ["seq", "action", "event_id", "product_id", "quantity"]


def decide(calls: DataFrame, assignments: DataFrame, available: DataFrame,
           block_rows: int = sequential.DEFAULT_BUCKET) -> DataFrame:
    """``calls`` (seq, action, event_id, product_id, quantity) with accepted, reason,
    ``held`` (the assignment before the call, NULL without one), ``delta`` (what an accepted
    call takes, negative: releases) and ``available_after``."""
    a = assignments.groupBy("event_id", "product_id").agg(F.sum("quantity_assigned").cast("long").alias("_start"))
    c = calls.select(F.col("seq").cast("long").alias("seq"), "action", *[
        F.col(x).cast("long").alias(x) for x in ("event_id", "product_id", "quantity")])
    c = stored(c.join(a, ["event_id", "product_id"], "left"))
    light, heavy = sequential.apart(c, ["product_id"], block_rows)
    c = sequential.side_by_side(_in_windows(light.join(available, "product_id", "left")),
                                None if heavy is None else _in_blocks(heavy.join(available, "product_id", "left"), block_rows))
    c = stored(c)
    settled = F.col("_first").isNull() | (F.col("_n") < F.col("_first"))
    valid = F.col("_reason").isNull()
    fast = c.where(settled).select(
        *COLUMNS, valid.alias("accepted"), F.col("_reason").alias("reason"), F.col("_held").alias("held"),
        F.when(valid, F.col("delta")).alias("delta"), F.col("_left").cast("long").alias("available_after"))
    rest = c.where(~settled)
    n = rest.count()
    return fast if n == 0 else fast.unionByName(_walked(rest, fast.schema, sequential.parts_for(rest, n)))


USED = [*COLUMNS, "_static", "_reason", "_held", "delta", "_left", "_n", "_first", "_from"]


def _static() -> Column:
    q, act = F.col("quantity"), F.col("action")
    known = F.coalesce(act.isin(ALLOCATE, CHANGE, REMOVE), F.lit(False))
    return (F.when(~known, UNKNOWN_CALL)
            .when((act == ALLOCATE) & (q.isNull() | (q <= 0)), INVALID_QUANTITY)
            .when((act == ALLOCATE) & F.col("available").isNull(), UNKNOWN_PRODUCT))


def _planned(c: DataFrame, before, added) -> DataFrame:
    """``c`` with what each call finds and takes as long as nothing falls short;
    ``before(df, value, out)`` adds the nearest known value of the calls before on the same
    assignment, ``added(df)`` the running sum ``_added`` of ``_add``."""
    q, act = F.col("quantity"), F.col("action")
    c = c.withColumn("_static", _static())
    # is there an assignment before the call: the last allocation or removal says so
    sets = F.when(F.col("_static").isNull(), F.when(act == ALLOCATE, F.lit(1)).when(act == REMOVE, F.lit(0)))
    c = before(c.withColumn("_sets", sets), "_sets", "_exists")
    c = c.withColumn("_exists", F.coalesce(F.col("_exists") == 1, F.col("_start").isNotNull()))
    reason = (F.when(F.col("_static").isNotNull(), F.col("_static"))
              .when((act != ALLOCATE) & ~F.col("_exists"), NOT_ASSIGNED)
              .when((act == CHANGE) & (q.isNull() | (q < 0)), INVALID_QUANTITY))
    c = c.withColumn("_reason", reason)
    # its quantity: the last value that was set, plus what was allocated since
    valid = F.col("_reason").isNull()
    c = added(c.withColumn("_add", F.when(valid & (act == ALLOCATE), q).otherwise(0)))
    base = F.when(valid & (act == CHANGE), q - F.col("_added")).when(valid & (act == REMOVE), -F.col("_added"))
    c = before(c.withColumn("_base", base), "_base", "_last")
    held = F.coalesce("_last", "_start", F.lit(0)) + F.col("_added") - F.col("_add")
    c = c.withColumn("_held", F.when(F.col("_exists"), held))
    delta = (F.when(~valid, 0).when(act == ALLOCATE, q).when(act == CHANGE, q - F.col("_held")).otherwise(-F.col("_held")))
    return c.withColumn("delta", delta.cast("long"))


def _short() -> Column:
    return (F.col("delta") > 0) & F.coalesce(F.col("_left") < 0, F.lit(True))


def _in_windows(c: DataFrame) -> DataFrame:
    """The calls, dealt out by product, by windows over the calls of an assignment and of
    a product: sorts, but no further shuffle."""
    own = Window.partitionBy("product_id", "event_id").orderBy("seq", "action", "quantity")
    past = own.rowsBetween(Window.unboundedPreceding, -1)
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = _planned(c, lambda df, value, out: df.withColumn(out, F.last(value, ignorenulls=True).over(past)).drop(value),
                 lambda df: df.withColumn("_added", F.sum("_add").over(upto)).withColumn("_k", F.row_number().over(own)))
    # equal calls keep the order (_k) in which the assignment saw them
    turn = Window.partitionBy("product_id").orderBy("seq", "event_id", "action", "quantity", "_k")
    upto = turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = c.withColumns({"_left": F.col("available") - F.sum("delta").over(upto), "_n": F.row_number().over(turn).cast("long")})
    c = c.withColumn("_short", _short())
    from_ = F.first(F.when(F.col("_short"), F.struct((F.col("_left") + F.col("delta")).alias("v"))), ignorenulls=True)
    return c.withColumns({"_first": F.min(F.when(F.col("_short"), F.col("_n"))).over(upto),
                          "_from": from_.over(upto)["v"]}).select(*USED)


def _in_blocks(c: DataFrame, block_rows: int) -> DataFrame:
    """The same for products with very many calls, over blocks of numbers."""
    key = ["event_id", "product_id"]
    c = sequential.numbered(c, ["product_id", "seq", "event_id", "action", "quantity"], "_n")
    c = _planned(c, lambda df, value, out: _before(df, key, value, out, block_rows),
                 lambda df: sequential.running_sum(df, key, "_n", "_add", "_added", block_rows))
    c = sequential.running_sum(c, ["product_id"], "_n", "delta", "_taken", block_rows)
    c = c.withColumn("_left", F.col("available") - F.col("_taken"))
    first = c.where(_short()).groupBy("product_id").agg(
        F.min("_n").alias("_first"), F.min_by(F.col("_left") + F.col("delta"), "_n").alias("_from"))
    return sequential.null_safe_join(c, first, ["product_id"], "left").select(*USED)


def _before(df: DataFrame, keys: list[str], value: str, out: str, block_rows: int) -> DataFrame:
    """The nearest non-NULL ``value`` of the rows before, by ``_n``."""
    df = sequential.carried(df, keys, "_n", value, "_upto", block_rows=block_rows)
    return sequential.neighbours(df, keys, "_n", ["_upto"], "_prev", block_rows=block_rows) \
        .withColumn(out, F.col("_prev._upto")).drop("_upto", "_prev", value)


def _walked(rows: DataFrame, schema: T.StructType, parts: int) -> DataFrame:
    """The calls of a product from its first shortage on, one after the other."""
    def init(v):
        return (None if v[-1] is None or v[-1] != v[-1] else int(v[-1])), {}

    def step(state, v):
        action, event, q, before, static = v[0], v[1], v[2], v[3], v[4]
        left, touched = state
        event = None if event is None or event != event else event
        held = touched.get(event, None if before is None or before != before else int(before))
        q = None if q is None or q != q else int(q)
        reason, delta = static if isinstance(static, str) else None, 0
        if reason is None and action != ALLOCATE and held is None:
            reason = NOT_ASSIGNED
        elif reason is None and action == CHANGE and (q is None or q < 0):
            reason = INVALID_QUANTITY
        if reason is None:
            delta = q if action == ALLOCATE else q - held if action == CHANGE else -held
            if delta > 0 and left is None:
                reason = UNKNOWN_PRODUCT
            elif delta > 0 and delta > left:
                reason = INSUFFICIENT
        if reason is None:
            left = None if left is None else left - delta
            touched[event] = (held or 0) + q if action == ALLOCATE else q if action == CHANGE else None
        else:
            touched[event] = held                              # later calls see this, not what was assumed
        return (left, touched), (reason is None, reason, held, delta if reason is None else None, left)

    return sequential.sorted_fold(
        rows.withColumns({"_event": F.col("event_id"), "_call": F.col("action"), "_q": F.col("quantity")}),
        ["product_id"], ["_n"], init, step, schema, inputs=["_call", "_event", "_q", "_held", "_static", "_from"],
        outputs=["accepted", "reason", "held", "delta", "available_after"], num_partitions=parts)


def assignments_after(decisions: DataFrame, assignments: DataFrame) -> DataFrame:
    """(event_id, product_id, quantity_assigned) after the accepted calls."""
    last = decisions.where("accepted").groupBy("event_id", "product_id").agg(
        F.max_by(F.struct("action", (F.coalesce("held", F.lit(0)) + F.col("delta")).alias("now")),
                 F.struct("seq", "event_id", "action", "quantity")).alias("l"))
    a = assignments.groupBy("event_id", "product_id").agg(F.sum("quantity_assigned").cast("long").alias("_was"))
    j = a.join(last, ["event_id", "product_id"], "full_outer")
    return j.where(F.col("l").isNull() | (F.col("l.action") != REMOVE)).select(
        "event_id", "product_id", F.coalesce("l.now", "_was").cast("long").alias("quantity_assigned"))


def available_after(decisions: DataFrame, available: DataFrame) -> DataFrame:
    """(product_id, available) after the accepted calls."""
    took = decisions.where("accepted").groupBy("product_id").agg(F.sum("delta").alias("_took"))
    return available.join(took, "product_id", "left").select(
        "product_id", (F.col("available") - F.coalesce("_took", F.lit(0))).cast("long").alias("available"))
