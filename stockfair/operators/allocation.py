"""Allocation of stock to fairs (event assignments) as batch jobs.

Available stock of a product = on-hand quantity - reserved quantity, summed
over its stock rows.  Each job takes a snapshot (assignments, stock) and a
request DataFrame and returns decisions; the ``*_snapshot`` helpers build the
new assignment / stock tables from the accepted requests.

* ``allocate_batch`` (all or nothing per batch): every request row of a batch
  must fit in what is left of its product after the earlier rows of the same
  batch; one failing row rejects the whole batch.  Each batch is decided
  against the given snapshot, as one call decides one batch.
* ``allocate_in_turn``: the same rule over many batches, one after the other:
  what an accepted batch takes is gone for the batches after it.
* ``allocate_rows`` (best effort per row, sheet import): rows run in order,
  an accepted row consumes stock seen by later rows -- the same greedy rule
  as a stock 'out' movement, so it runs on ``ledger.apply_ledger``.
* ``reassign_quantity``: set a new assigned quantity; the increase must be
  available, a decrease releases stock.  Also a per-product greedy fold.
* ``unassign_product``: delete an assignment and release its quantity.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockfair.operators import ledger, sequential
from stockfair.operators.components import components
from stockfair.operators.fairs import dense_ids
from stockfair.session import stored as cut_lineage

# Decision reasons and the error texts of the sheet import.
NOT_ASSIGNED = "not_assigned"
INSUFFICIENT = ledger.INSUFFICIENT_STOCK
INVALID_QUANTITY = ledger.INVALID_QUANTITY
UNKNOWN_PRODUCT = ledger.UNKNOWN_PRODUCT
UNKNOWN_SKU = "unknown_sku"
MSG_UNKNOWN_SKU = "Product with SKU '{sku}' not found"
MSG_BAD_QUANTITY = "Error importing SKU '{sku}': invalid literal for int() with base 10: '{q}'"
MSG_NOT_POSITIVE = "Error importing SKU '{sku}': quantity must be positive"
MSG_SHORTAGE = ("Error importing SKU '{sku}': Not enough stock for product ID {pid}. "
                "Available: {avail}, Requested: {q}")
MSG_MISSING_COLUMNS = "Missing required columns: {cols}"
REQUIRED_SHEET_COLUMNS = ("SKU", "Quantity")

#: (batch, product) totals of one component that a single task walks.
WALK_ROWS = 5_000_000


def available_stock(inventory: DataFrame) -> DataFrame:
    """(product_id, available) = sum(quantity) - sum(reserved) per product."""
    reserved = F.coalesce(F.col("reserved"), F.lit(0)) if "reserved" in inventory.columns else F.lit(0)
    return inventory.groupBy("product_id").agg(
        (F.sum("quantity") - F.sum(reserved)).cast("long").alias("available"))


# -- M5 / M6 -------------------------------------------------------------------

def allocate_batch(requests: DataFrame, available: DataFrame,
                   block_rows: int = sequential.DEFAULT_BUCKET, kept: bool = False) -> DataFrame:
    """Decide every request row and its batch.  ``requests`` has batch_id,
    seq, event_id, product_id, quantity (and optionally sale_price).  ``kept``:
    they are read from stored rows, so they need not be stored with their stock."""
    r = requests.join(available, "product_id", "left")
    if not kept:
        r = cut_lineage(r)
    # batches are dealt out whole and summed there; the rows of a huge one are numbered and
    # summed over blocks of numbers, so it is not a single window task
    light, heavy = sequential.apart(r, ["batch_id"], block_rows, requests if kept else None)
    order = [x for x in ("seq", "quantity") if x in r.columns]
    rest = [f.name for f in r.schema.fields if f.name not in ("batch_id", "product_id", *order)
            and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    upto = Window.partitionBy("batch_id", "product_id").orderBy(*order, *rest).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    fits = F.bool_and(F.col("reason").isNull())
    out = light.withColumn("cum_quantity", F.sum("quantity").over(upto)).withColumn("reason", _batch_reason()) \
        .withColumn("batch_accepted", fits.over(Window.partitionBy("batch_id")))
    if heavy is None:
        return out
    heavy = sequential.numbered(heavy, ["batch_id", "product_id", "seq", "quantity"], "_n")
    heavy = sequential.running_sum(heavy, ["batch_id", "product_id"], "_n", "quantity", "cum_quantity", block_rows).drop("_n")
    heavy = heavy.withColumn("reason", _batch_reason())
    ok = heavy.groupBy("batch_id").agg(fits.alias("batch_accepted"))
    return sequential.side_by_side(out, sequential.null_safe_join(heavy, ok, ["batch_id"], "inner"))


def _batch_reason() -> F.Column:
    return (F.when(F.col("quantity").isNull() | (F.col("quantity") <= 0), F.lit(INVALID_QUANTITY))
            .when(F.col("available").isNull(), F.lit(UNKNOWN_PRODUCT))
            .when(F.col("cum_quantity") > F.col("available"), F.lit(INSUFFICIENT)))


def allocate_in_turn(requests: DataFrame, available: DataFrame, walk_rows: int = WALK_ROWS) -> DataFrame:
    """Decide the batches in the order of their first ``seq`` (then batch_id),
    each against what the accepted ones before it leave.

    Two batches affect each other only through products that are short, directly
    or through others.  So totals per (batch, product) are formed first; products
    whose requests all fit and batches that alone ask for too much are settled
    without order.  More than ``walk_rows`` totals are first brought down by rounds that
    decide all batches whose bounds settle them (``_rounds``).  The others fall into
    connected components of the graph of batches and short products, decided side by side,
    each by one streamed walk that keeps what is left of its products.  A component of more
    than ``walk_rows`` totals is decided by rounds to the end, with the same result.

    Returns the request columns, ``available`` (of the snapshot), ``reason`` of
    the row and ``batch_accepted``.  In a batch without invalid rows a row's reason is
    a shortage when it does not fit, with the batch's earlier rows, in what is left
    at the batch's turn.  Every request row is returned, also those with a NULL
    product or batch."""
    static = (F.when(F.col("quantity").isNull() | (F.col("quantity") <= 0), F.lit(INVALID_QUANTITY))
              .when(F.col("available").isNull(), F.lit(UNKNOWN_PRODUCT)))
    r = cut_lineage(requests.join(available, "product_id", "left").withColumn("_static", static))
    # a batch's turn is its number by (first seq, batch), numbered without one big window
    batches = dense_ids(r.groupBy("batch_id").agg(F.min("seq").alias("_from"), F.max(F.col("_static").isNotNull()).alias("_bad")),
                        ["_from", "batch_id"], "_turn").drop("_from")
    r = cut_lineage(sequential.null_safe_join(r, batches, ["batch_id"], "inner"))
    asked = cut_lineage(r.where(~F.col("_bad")).groupBy("_turn", "product_id").agg(
        F.sum("quantity").alias("total"), F.first("available").alias("available")))
    verdicts = _verdicts(asked, walk_rows)
    # what accepted batches before it leave of a product, per (batch, product)
    took = cut_lineage(asked.join(verdicts, "_turn").withColumn(
        "_took", F.when(F.col("accepted"), F.col("total")).otherwise(F.lit(0))))
    took = sequential.sums_by_key(took, ["product_id"], "_turn", {"_took": "_sum"})
    left = took.select("_turn", "product_id", (F.col("available") - F.col("_sum") + F.col("_took")).alias("_left"), "accepted")
    light, heavy = sequential.apart(r.where(~F.col("_bad")), ["_turn", "product_id"])
    rest = [f.name for f in r.schema.fields if f.name not in ("_turn", "product_id", "batch_id", "seq", "quantity")
            and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    upto = Window.partitionBy("_turn", "product_id").orderBy("seq", "quantity", *rest).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    own = light.withColumn("_own", F.sum("quantity").over(upto))
    if heavy is not None:
        heavy = sequential.numbered(heavy, ["_turn", "product_id", "seq", "quantity"], "_n")
        own = sequential.side_by_side(own, sequential.running_sum(heavy, ["_turn", "product_id"], "_n", "quantity", "_own"))
    good = own.join(left, ["_turn", "product_id"]).select(
        *requests.columns, "available", F.when(F.col("_own") > F.col("_left"), F.lit(INSUFFICIENT)).alias("reason"),
        F.col("accepted").alias("batch_accepted"))
    return good.unionByName(r.where("_bad").select(
        *requests.columns, "available", F.col("_static").alias("reason"), F.lit(False).alias("batch_accepted")))


def _verdicts(asked: DataFrame, walk_rows: int) -> DataFrame:
    """(_turn, accepted) of every batch of ``asked`` (_turn, product_id, total,
    available)."""
    over = F.col("total") > F.col("available")
    # what the batches that fit alone ask of a product; the others take nothing
    alone = cut_lineage(asked.groupBy("_turn").agg(F.max(over).alias("_over")))
    asked = asked.join(alone.where(~F.col("_over")).select("_turn"), "_turn")
    short = asked.groupBy("product_id").agg(
        F.sum("total").alias("_all"), F.first("available").alias("_av")).where("_all > _av").select("product_id")
    # 0 open, 1 accepted, 2 rejected
    rows = cut_lineage(asked.join(short, "product_id", "left_semi").withColumns({"_state": F.lit(0), "_new": F.lit(False)}))
    decided, rows = _rounds(rows, walk_rows)
    if decided is None and rows is None:
        return alone.select("_turn", (~F.col("_over")).alias("accepted"))
    if rows is not None:
        rest = _by_components(rows, walk_rows)
        decided = rest if decided is None else decided.unionByName(rest)
    # batches without a short product are accepted, those that ask too much are not
    return cut_lineage(alone.join(decided, "_turn", "left").select(
        "_turn", (~F.col("_over") & F.coalesce("accepted", F.lit(True))).alias("accepted")))


def _rounds(rows: DataFrame, enough: int, slowest: float = 0.9) -> tuple[DataFrame | None, DataFrame | None]:
    """Decides what can be decided without a walk, until at most ``enough`` open rows are left
    or a round leaves more than ``slowest`` of them open: ((_turn, accepted) decided or
    None, the rows that are left or None).  ``rows`` (stored) has ``_state`` and ``_new``.

    A batch is accepted if its totals fit even when every open earlier batch is counted as
    accepted, and rejected if one fails counting accepted earlier batches alone.  The first
    open batch is always decided.  Decided rows leave once no open batch needs them: rejected
    ones at once, accepted ones when no earlier batch on the product is open (what they took
    is taken from ``available``)."""
    done, n = None, rows.where("_state = 0").count()
    while n > enough:
        cols = rows.columns
        light, heavy = sequential.apart(rows.where("_state < 2"), ["product_id"])
        by = Window.partitionBy("product_id")
        upto = by.orderBy("_turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        is_open = F.col("_state") == 0
        taken = F.when(F.col("_state") == 1, F.col("total")).otherwise(0)
        light = light.withColumn("_seen", F.count_if(is_open).over(upto))
        settled = F.sum(F.when(F.col("_seen") == 0, taken).otherwise(0)).over(by)
        light = light.withColumns({"_open": F.count_if(is_open).over(by), "available": F.col("available") - settled}) \
            .where((F.col("_open") > 0) & (F.col("_seen") > 0)).drop("_open", "_seen").withColumn("_taken", taken) \
            .withColumns({"_upper": F.sum("total").over(upto), "_lower": F.sum("_taken").over(upto)})
        if heavy is not None:
            heavy = sequential.running_sums(heavy.withColumn("_taken", taken), ["product_id"], "_turn",
                                            {"total": "_upper", "_taken": "_lower"})
        both = cut_lineage(sequential.side_by_side(light, heavy))
        # an open batch's own totals add nothing to _lower
        verdict = both.where(is_open).groupBy("_turn").agg(
            F.bool_and(F.col("_upper") <= F.col("available")).alias("_yes"),
            F.max(F.col("_lower") + F.col("total") > F.col("available")).alias("_no"))
        new = is_open & (F.col("_yes") | F.col("_no"))
        rows = cut_lineage(both.drop("_new").join(verdict, "_turn", "left").withColumn("_new", F.coalesce(new, F.lit(False)))
                      .withColumn("_state", F.when(F.col("_new") & F.col("_no"), F.lit(2)).when(F.col("_new"), F.lit(1))
                                  .otherwise(F.col("_state"))).select(*cols))
        told = rows.where("_new").groupBy("_turn").agg((F.first("_state") == 1).alias("accepted"))
        done = told if done is None else done.unionByName(told)
        before, n = n, rows.where("_state = 0").count()
        if n > slowest * before:
            break
    return done, rows.where("_state < 2") if n else None


def _by_components(rows: DataFrame, walk_rows: int) -> DataFrame:
    """(_turn, accepted) of the open batches of ``rows`` (stored): open batches and their
    products as one graph, each of its components walked; those with more than
    ``walk_rows`` open rows are decided by rounds to the end."""
    # batches and products as the nodes of one graph: even and odd numbers
    is_open = F.col("_state") == 0
    edges = rows.where(is_open).select((F.col("_turn") * 2).alias("a"), (F.col("product_id") * 2 + 1).alias("b"))
    # accepted batches still count on products that open ones ask for
    rows = cut_lineage(rows.join(components(edges), F.col("product_id") * 2 + 1 == F.col("node")).drop("node"))
    large = cut_lineage(rows.where(is_open).groupBy("root").agg(F.count(F.lit(1)).alias("_k"))
                   .where(F.col("_k") > walk_rows).select("root"))
    if large.limit(1).count() == 0:
        return _decided_by_walk(rows)
    rounds, _ = _rounds(cut_lineage(rows.join(large, "root", "left_semi").drop("root")), 0, 1.0)
    return _decided_by_walk(rows.join(large, "root", "left_anti")).unionByName(rounds)


def _decided_by_walk(rows: DataFrame) -> DataFrame:
    """(_turn, accepted) of open batches by one walk per component (``root``), batches by
    ``_turn``: a batch is accepted if all its totals fit in what is left."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = ["root", "_turn", "product_id", "total", "available", "_state"]
    ordered = rows.select(*cols) \
        .repartition(parts, "root").sortWithinPartitions("root", "_turn")

    def run(batches):
        root = turn = None
        known = False
        left: dict[int, int] = {}
        wants: list[tuple[int, int]] = []

        def verdict():
            fits = known or all(q <= left[p] for p, q in wants)
            for p, q in wants if fits else ():
                left[p] -= q
            return fits

        for batch in batches:
            turns, fits = [], []
            for g, t, p, q, have, state in zip(*[batch[c].tolist() for c in cols]):
                if (g, t) != (root, turn):
                    if turn is not None:
                        ok = verdict()
                        if not known:
                            turns.append(turn)
                            fits.append(ok)
                    turn, wants, known = t, [], state == 1
                if g != root:
                    root, left = g, {}
                left.setdefault(p, have)
                wants.append((p, q))
            yield pd.DataFrame({"_turn": turns, "accepted": fits})
        if turn is not None and not known:
            yield pd.DataFrame({"_turn": [turn], "accepted": [verdict()]})

    return ordered.mapInPandas(run, "_turn long, accepted boolean")


def allocation_snapshot(decisions: DataFrame, assignments: DataFrame) -> DataFrame:
    """New assignments after the accepted batches: quantities added to an
    existing (event, product) row, new rows otherwise (ids after the largest
    one, in (event, product) order); a supplied fair price
    overrides (the last non-NULL one in request order wins)."""
    acc = decisions.where(F.col("batch_accepted"))
    price = (F.max_by("sale_price", F.when(F.col("sale_price").isNotNull(), F.struct("seq", "sale_price")))
             if "sale_price" in decisions.columns else F.lit(None).cast("double"))
    # product first: the rows are sorted for the sums and the join, and there are few fairs.
    # Dealt out before the sums: few requests share a key, and the last price needs sorted
    # rows, which would otherwise be sorted before the shuffle too
    add = acc.repartition("product_id", "event_id").groupBy("product_id", "event_id").agg(
        F.sum("quantity").alias("_add"), price.alias("_price"))
    a = assignments.select("id", "event_id", "product_id", "quantity_assigned", "event_sale_price")
    j = a.join(add, ["product_id", "event_id"], "full_outer").select(
        "id", "event_id", "product_id",
        (F.coalesce(F.col("quantity_assigned"), F.lit(0)) + F.coalesce(F.col("_add"), F.lit(0)))
        .cast("long").alias("quantity_assigned"),
        F.coalesce(F.col("_price"), F.col("event_sale_price")).alias("event_sale_price"),
    )
    j = cut_lineage(j)
    # every assignment is in the join, new rows have no id
    start = j.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = dense_ids(j.where(F.col("id").isNull()).drop("id"), ["event_id", "product_id"], "_n") \
        .withColumn("id", F.lit(start) + F.col("_n"))
    return j.where(F.col("id").isNotNull()).unionByName(new.select(*j.columns))


def rows_snapshot(decisions: DataFrame, assignments: DataFrame) -> DataFrame:
    """New assignments after a row-by-row sheet import (``allocate_rows``)."""
    return allocation_snapshot(decisions.withColumnRenamed("accepted", "batch_accepted"), assignments)


def reserve(inventory_available: DataFrame, decisions: DataFrame) -> DataFrame:
    """Available stock after the accepted batches."""
    used = (decisions.where(F.col("batch_accepted")).groupBy("product_id")
            .agg(F.sum("quantity").alias("_used")))
    return (inventory_available.join(used, "product_id", "left")
            .select("product_id",
                    (F.col("available") - F.coalesce(F.col("_used"), F.lit(0))).cast("long")
                    .alias("available")))


# -- M8 ------------------------------------------------------------------------

def missing_sheet_columns(df: DataFrame) -> list[str]:
    """S6.  Required sheet columns that are absent (checked before any job)."""
    return [c for c in REQUIRED_SHEET_COLUMNS if c not in df.columns]


def parse_quantity(c) -> F.Column:
    """Integer quantity of a sheet cell: an integer text, or a decimal number
    truncated toward zero (a numeric cell); anything else NULL."""
    t = F.trim(c)
    as_int = t.try_cast("long")
    as_num = F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"),
                    t.try_cast("double").try_cast("long"))
    return F.coalesce(as_int, as_num)


def allocate_rows(sheet: DataFrame, products: DataFrame, available: DataFrame,
                  event_id=None) -> DataFrame:
    """Sheet import into fairs, row by row: ``sheet`` has seq, SKU, Quantity
    (text), optionally 'Sale Price', and either an ``event_id`` column (the
    sheets of many fairs, one after the other by event_id) or the ``event_id``
    parameter.  The rows of a sheet run by seq (those without one first), rows of
    equal seq by sku and then their other cells.  A row is rejected for a bad quantity, an unknown sku (several
    products with one sku: the smallest id is used) or a shortage; accepted
    rows consume stock for later rows."""
    by_sku = products.where(F.col("sku").isNotNull()).groupBy("sku").agg(
        F.min("id").alias("product_id"))
    price = (F.col("`Sale Price`").try_cast("double") if "Sale Price" in sheet.columns
             else F.lit(None).cast("double"))
    fair = (F.col("event_id") if "event_id" in sheet.columns else F.lit(event_id)).cast("long")
    s = sheet.select(fair.alias("event_id"), "seq", F.col("SKU").alias("sku"),
                     F.col("Quantity").alias("raw_quantity"), price.alias("sale_price"))
    s = s.withColumn("quantity", parse_quantity(F.col("raw_quantity")))
    s = s.join(by_sku, "sku", "left")
    static = (F.when(F.col("quantity").isNull(), F.lit(INVALID_QUANTITY))
              .when(F.col("product_id").isNull(), F.lit(UNKNOWN_SKU))
              .when(F.col("quantity") <= 0, F.lit("not_positive")))
    s = cut_lineage(s.withColumn("_static", static))
    # Known-sku rows with a positive quantity go through the greedy fold as
    # stock 'out' movements; a product without stock rows has 0 available.
    opening = (products.select(F.col("id").alias("product_id"))
               .join(available, "product_id", "left")
               .select("product_id", F.coalesce("available", F.lit(0)).cast("long")
                       .alias("opening")))
    # sheets may all count from 1 and repeat a seq: the whole row is the order, and goes along
    moves = s.where(F.col("_static").isNull()).drop("_static").withColumn("transaction_type", F.lit("out"))
    d = ledger.apply_ledger(moves, opening, order=("event_id", "seq", "sku", "raw_quantity", "sale_price"), is_stored=True)
    none = F.lit(None)
    j = d.select(*s.columns[:-1], none.cast("string").alias("_static"), "accepted", F.col("balance_after").alias("_after")) \
        .unionByName(s.where(F.col("_static").isNotNull()).select(
            *s.columns, none.cast("boolean").alias("accepted"), none.cast("long").alias("_after")))
    avail_before = F.when(F.col("accepted"), F.col("_after") + F.col("quantity")).otherwise(
        F.col("_after"))
    sku_txt = F.coalesce(F.col("sku"), F.lit("nan"))
    msg = (F.when(F.col("_static") == INVALID_QUANTITY,
                  F.format_string(_fmt(MSG_BAD_QUANTITY), sku_txt,
                                  F.coalesce(F.col("raw_quantity"), F.lit("nan"))))
           .when(F.col("_static") == UNKNOWN_SKU, F.format_string(_fmt(MSG_UNKNOWN_SKU), sku_txt))
           .when(F.col("_static") == "not_positive",
                 F.format_string(_fmt(MSG_NOT_POSITIVE), sku_txt))
           .when(~F.col("accepted"),
                 F.format_string(_fmt(MSG_SHORTAGE), sku_txt, F.col("product_id").cast("string"),
                                 avail_before.cast("string"), F.col("quantity").cast("string"))))
    return j.select(
        "event_id", "seq", "sku", "raw_quantity", "quantity",
        "sale_price", "product_id",
        F.coalesce(F.col("accepted"), F.lit(False)).alias("accepted"),
        F.when(F.col("_static").isNotNull(), F.col("_static"))
        .when(~F.col("accepted"), F.lit(INSUFFICIENT)).alias("reason"),
        msg.alias("error"),
    )


def _fmt(template: str) -> str:
    """Turn a ``{name}`` message template into a ``format_string`` one."""
    out, i = [], 0
    while i < len(template):
        if template[i] == "{":
            j = template.index("}", i)
            out.append("%s")
            i = j + 1
        else:
            out.append(template[i].replace("%", "%%"))
            i += 1
    return "".join(out)


def allocate_rows_summary(decisions: DataFrame) -> DataFrame:
    """A21 / M8 counters: rows imported and rows in error (the error texts
    stay rows of ``decisions``: the list is as long as the sheet)."""
    return decisions.agg(
        F.count_if(F.col("accepted")).alias("imported"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )


# -- M7 ------------------------------------------------------------------------

def _changes(rows: DataFrame, own: Window) -> DataFrame:
    """``rows`` with the quantity before each request, if none is rejected, and its change."""
    rows = rows.withColumn("current_quantity", F.coalesce(F.lag("new_quantity").over(own), F.col("_assigned")).cast("long"))
    return rows.withColumn("delta", (F.col("new_quantity") - F.col("current_quantity")).cast("long"))


def reassign_quantity(requests: DataFrame, assignments: DataFrame, available: DataFrame,
                      block_rows: int = sequential.DEFAULT_BUCKET) -> DataFrame:
    """``requests``: seq, event_id, product_id, new_quantity.  Every request is
    decided, those on one product in seq order (without a seq first, equal ones by
    event and quantity): unknown assignment ->
    ``not_assigned``; an increase over the assignment's quantity at that time
    needs that much available stock; a decrease releases stock.

    As long as nothing of a product is rejected, a request's change is measured
    from the request before it, so a running sum settles those rows; only rows
    from a product's first rejection on are walked in order."""
    a = assignments.select("event_id", "product_id",
                           F.col("quantity_assigned").alias("_assigned"))
    r = cut_lineage(requests.join(a, ["event_id", "product_id"], "left"))
    open_row = F.col("_assigned").isNotNull() & F.col("new_quantity").isNotNull()
    closed = r.where(~open_row)
    light, heavy = sequential.apart(r.where(open_row), ["product_id"], block_rows)
    light = light.join(available, "product_id", "left")
    rest = [f.name for f in light.schema.fields if f.name not in ("event_id", "product_id", "seq", "new_quantity")
            and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    own = Window.partitionBy("product_id", "event_id").orderBy("seq", "new_quantity", *rest)
    all_rows = Window.partitionBy("product_id").orderBy("seq", "event_id", "new_quantity", *rest, "_k")
    upto = all_rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # rows equal in every column keep one order (_k)
    light = _changes(light.withColumn("_k", F.row_number().over(own)), own)
    light = light.withColumns({"_cum": F.sum("delta").over(upto), "_n": F.row_number().over(all_rows)})
    fails = F.when(F.col("available").isNull(), F.col("delta") > 0).otherwise(F.col("_left") < 0) & (F.col("delta") > 0)
    light = light.withColumn("_left", F.col("available") - F.col("_cum")).withColumn("_fails", fails).withColumns({
        "_first": F.min(F.when(F.col("_fails"), F.col("_n"))).over(upto),
        "_start": F.first(F.when(F.col("_fails"), F.struct((F.col("_left") + F.col("delta")).alias("v"))),
                          ignorenulls=True).over(upto)["v"]})
    used = ["seq", "event_id", "product_id", "current_quantity", "new_quantity", "delta", "_left", "_n", "_first", "_start"]
    light = light.select(*used)
    if heavy is not None:
        heavy = sequential.numbered(heavy.join(available, "product_id", "left"),
                                    ["product_id", "seq", "event_id", "new_quantity"], "_n")
        heavy = _changes(heavy, Window.partitionBy("event_id", "product_id").orderBy("_n"))
        heavy = sequential.running_sum(heavy, ["product_id"], "_n", "delta", "_cum", block_rows)
        heavy = heavy.withColumn("_left", F.col("available") - F.col("_cum"))
        first = (heavy.where(fails).groupBy("product_id")
                 .agg(F.min("_n").alias("_first"),
                      F.min_by(F.col("_left") + F.col("delta"), F.col("_n")).alias("_start")))
        heavy = heavy.join(first, "product_id", "left")
    r = cut_lineage(sequential.side_by_side(light, heavy))
    cols = ["seq", "event_id", "product_id", "current_quantity", "new_quantity", "delta"]
    fast = r.where(F.col("_first").isNull() | (F.col("_n") < F.col("_first"))).select(
        *cols, F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("reason"),
        F.when(F.col("delta") != 0, F.col("_left")).cast("long").alias("available_after"))
    types = {f.name: f.dataType for f in requests.schema.fields}
    schema = T.StructType(
        [T.StructField(c, types[c]) for c in ("seq", "event_id", "product_id")]
        + [T.StructField("current_quantity", T.LongType()), T.StructField("new_quantity", types["new_quantity"]),
           T.StructField("delta", T.LongType()), T.StructField("accepted", T.BooleanType()),
           T.StructField("reason", T.StringType()), T.StructField("available_after", T.LongType())])

    def init(v):
        return (None if v[3] is None or v[3] != v[3] else int(v[3])), {}

    def step(state, v):
        left, held = state
        event, before, new = v[0], int(v[1]), int(v[2])
        now = held.get(event, before)          # the last accepted quantity of the fair
        change = new - now
        if change > 0 and left is None:
            return state, (now, change, False, UNKNOWN_PRODUCT, None)
        if change > 0 and change > left:
            held[event] = now                  # later rows measure from here
            return state, (now, change, False, INSUFFICIENT, left)
        held[event] = new
        left = None if left is None else left - change
        return (left, held), (now, change, True, None, left if change else None)

    slow = r.where(F.col("_n") >= F.col("_first")).withColumnRenamed("current_quantity", "_before")
    slow_out = sequential.sorted_fold(
        slow.withColumns({"current_quantity": F.col("_before"), "_event": F.col("event_id")}),
        ["product_id"], ["_n"], init, step, schema, inputs=["_event", "_before", "new_quantity", "_start"],
        outputs=["current_quantity", "delta", "accepted", "reason", "available_after"], skip_if_empty=True)
    rest = closed.select(
        "seq", "event_id", "product_id", F.col("_assigned").cast("long").alias("current_quantity"),
        "new_quantity", F.lit(None).cast("long").alias("delta"), F.lit(False).alias("accepted"),
        F.when(F.col("_assigned").isNull(), F.lit(NOT_ASSIGNED)).otherwise(F.lit(INVALID_QUANTITY)).alias("reason"),
        F.lit(None).cast("long").alias("available_after"))
    return fast.unionByName(slow_out.select(*fast.columns)).unionByName(rest)


def reassigned(decisions: DataFrame, assignments: DataFrame) -> DataFrame:
    """The assignments with each one's last accepted quantity."""
    last = (decisions.where("accepted").groupBy("event_id", "product_id")
            .agg(F.max_by("new_quantity", F.struct("seq", "new_quantity")).alias("_new")))
    return assignments.join(last, ["event_id", "product_id"], "left").select(
        *[F.coalesce(F.col("_new"), F.col(c)).cast("long").alias(c) if c == "quantity_assigned" else F.col(c)
          for c in assignments.columns])


# -- M9 ------------------------------------------------------------------------

def unassign_product(requests: DataFrame, assignments: DataFrame) -> DataFrame:
    """``requests``: event_id, product_id.  Returns each request with the
    quantity it releases (NULL and ``not_assigned`` when there is no such
    assignment, or an earlier request by ``seq`` has released it)."""
    a = assignments.select("event_id", "product_id", "quantity_assigned")
    order = ["seq"] if "seq" in requests.columns else list(requests.columns)
    turn = F.row_number().over(Window.partitionBy("event_id", "product_id").orderBy(*order))
    j = requests.withColumn("_turn", turn).join(a, ["event_id", "product_id"], "left")
    ok = F.col("quantity_assigned").isNotNull() & (F.col("_turn") == 1)
    return j.select(*requests.columns,
                    F.when(ok, F.col("quantity_assigned")).alias("released"),
                    ok.alias("accepted"),
                    F.when(~ok, F.lit(NOT_ASSIGNED)).alias("reason"))


def unassign_snapshot(requests: DataFrame, assignments: DataFrame,
                      available: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New assignments (the removed ones dropped) and new available stock
    (released quantities added back)."""
    keys = requests.select("event_id", "product_id").distinct()
    removed = assignments.join(keys, ["event_id", "product_id"], "left_semi")
    kept = assignments.join(keys, ["event_id", "product_id"], "left_anti")
    back = removed.groupBy("product_id").agg(F.sum("quantity_assigned").alias("_back"))
    avail = (available.join(back, "product_id", "left")
             .select("product_id", (F.col("available") + F.coalesce(F.col("_back"), F.lit(0)))
                     .cast("long").alias("available")))
    return kept, avail
