"""Catalogue and stock read queries (product lookups, search, stock pages,
ledger history, fair lookups).

Every function takes DataFrames plus parameters and returns a lazy DataFrame.
Joins are left to Catalyst/AQE (which broadcasts a side only when its measured
size is under ``spark.sql.autoBroadcastJoinThreshold``); filters are written
on the scanned columns so they reach the Parquet reader.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockfair.functions import text

PRODUCT_COLUMNS = ["id", "supplier_id", "sku", "ean_upc", "name", "description", "category",
                   "purchase_price", "selling_price"]


def _product_cols(products: DataFrame, alias: str = "p"):
    return [F.col(f"{alias}.{c}") for c in PRODUCT_COLUMNS if c in products.columns]


def first_inventory_row(inventory: DataFrame) -> DataFrame:
    """One inventory row per product: the one with the smallest id (the row
    a single-row lookup returns).  A partial aggregate, so only one row per
    product and map task crosses the shuffle."""
    return inventory.groupBy("product_id").agg(
        F.min_by("quantity", "id").alias("quantity"),
        F.min_by("last_updated", "id").alias("last_updated"),
    )


def stocked_products(products: DataFrame, inventory: DataFrame) -> DataFrame:
    """products INNER JOIN (first inventory row per product)."""
    inv = first_inventory_row(inventory).alias("i")
    p = products.alias("p")
    return p.join(inv, F.col("p.id") == F.col("i.product_id"), "inner").select(
        *_product_cols(products), F.col("i.quantity"))


def lookup_products(products: DataFrame, inventory: DataFrame, keys: DataFrame,
                    key_col: str, by: str = "ean_upc") -> DataFrame:
    """Batch form of the single-code lookups: each row of ``keys`` gets the
    product whose ``by`` column equals ``keys[key_col]`` (inner: unknown keys
    and products without inventory drop out)."""
    sp = stocked_products(products, inventory).alias("sp")
    k = keys.alias("k")
    return k.join(sp, F.col(f"k.{key_col}") == F.col(f"sp.{by}"), "inner").select(
        F.col(f"k.{key_col}"), *[F.col(f"sp.{c}") for c in sp.columns
                                 if c != key_col or key_col != by])


def product_by_barcode(products: DataFrame, inventory: DataFrame, barcode) -> DataFrame:
    """Q1.  ``barcode`` is a code string (one lookup) or a DataFrame with a
    ``barcode`` column (batch lookup)."""
    if isinstance(barcode, DataFrame):
        return lookup_products(products, inventory, barcode, "barcode", "ean_upc")
    return stocked_products(products.where(F.col("ean_upc") == F.lit(barcode)), inventory)


def product_by_sku(products: DataFrame, inventory: DataFrame, sku) -> DataFrame:
    """Q2.  Like Q1 on ``sku``; several products may share a sku, all are
    returned (callers wanting one take the smallest id)."""
    if isinstance(sku, DataFrame):
        return lookup_products(products, inventory, sku, "sku", "sku")
    return stocked_products(products.where(F.col("sku") == F.lit(sku)), inventory)


def search_products(products: DataFrame, inventory: DataFrame, term: str) -> DataFrame:
    """Q3.  ``%term%`` on name, description, sku or barcode.  Case folds for
    ASCII letters only; ``%`` and ``_`` in the term act as wildcards; there is
    no escape character.  One row per matching inventory row."""
    pattern = "%" + text.ascii_lower_literal(term).replace("\\", "\\\\") + "%"
    cond = None
    for c in ("name", "description", "sku", "ean_upc"):
        m = text.ascii_lower(F.col(f"p.{c}")).like(pattern)
        cond = m if cond is None else (cond | m)
    p = products.alias("p").where(cond)
    i = inventory.alias("i")
    return p.join(i, F.col("p.id") == F.col("i.product_id"), "inner").select(
        *_product_cols(products), F.col("i.quantity"))


def _stock_rows(products: DataFrame, inventory: DataFrame, suppliers: DataFrame) -> DataFrame:
    p, i, s = products.alias("p"), inventory.alias("i"), suppliers.alias("s")
    return (p.join(i, F.col("p.id") == F.col("i.product_id"), "inner")
            .join(s, F.col("p.supplier_id") == F.col("s.id"), "left"))


_STOCK_COLS = ["p.id", "p.sku", "p.ean_upc", "p.name", "p.description", "p.purchase_price",
               "p.selling_price", "i.quantity", "i.last_updated"]


def inventory_status(products: DataFrame, inventory: DataFrame, suppliers: DataFrame,
                     limit: int = 100, offset: int = 0) -> DataFrame:
    """Q4.  One page of stock rows ordered by product name (ties: product id,
    inventory id).  Spark plans this as a top-(offset+limit) per partition
    followed by a merge, so no full sort of the table happens."""
    j = _stock_rows(products, inventory, suppliers)
    ordered = j.orderBy(F.col("p.name").asc_nulls_first(), F.col("p.id"), F.col("i.id"))
    return (ordered.select(*[F.col(c) for c in _STOCK_COLS], F.col("s.name").alias("supplier_name"))
            .offset(offset).limit(limit))


def low_stock_items(products: DataFrame, inventory: DataFrame, suppliers: DataFrame,
                    threshold: int = 5) -> DataFrame:
    """Q5.  Stock rows with quantity <= threshold, lowest first."""
    i = inventory.where(F.col("quantity") <= threshold)
    j = _stock_rows(products, i, suppliers)
    return (j.select(*[F.col(c) for c in _STOCK_COLS], F.col("s.name").alias("supplier_name"))
            .orderBy(F.col("quantity").asc(), F.col("id")))


def _as_ts(v):
    if v is None or isinstance(v, _dt.datetime):
        return v
    if isinstance(v, _dt.date):
        return _dt.datetime(v.year, v.month, v.day)
    return _dt.datetime.fromisoformat(str(v))


def transaction_history(transactions: DataFrame, products: DataFrame, product_id=None,
                        start_date=None, end_date=None, limit: int | None = 100) -> DataFrame:
    """Q6.  Ledger rows with product name/sku/barcode, newest first.  Filters
    are optional and AND-ed; ``product_id`` 0 is a real key.  Ledger rows of
    unknown products drop out (inner join)."""
    t = transactions
    if product_id is not None:
        t = t.where(F.col("product_id") == F.lit(product_id))
    if start_date is not None:
        t = t.where(F.col("transaction_date") >= F.lit(_as_ts(start_date)))
    if end_date is not None:
        t = t.where(F.col("transaction_date") <= F.lit(_as_ts(end_date)))
    t, p = t.alias("t"), products.alias("p")
    out = t.join(p, F.col("t.product_id") == F.col("p.id"), "inner").select(
        "t.*", F.col("p.name").alias("product_name"), F.col("p.sku"), F.col("p.ean_upc"))
    out = out.orderBy(F.col("transaction_date").desc_nulls_last(), F.col("id").desc())
    return out.limit(limit) if limit is not None else out


def stock_log_query(stock_log: DataFrame, event_type=None, start_date=None, end_date=None,
                    limit: int | None = 100) -> DataFrame:
    """Q7.  Audit rows, optional filters, newest first."""
    s = stock_log
    if event_type is not None:
        s = s.where(F.col("event_type") == F.lit(event_type))
    if start_date is not None:
        s = s.where(F.col("event_date") >= F.lit(_as_ts(start_date)))
    if end_date is not None:
        s = s.where(F.col("event_date") <= F.lit(_as_ts(end_date)))
    s = s.orderBy(F.col("event_date").desc_nulls_last(), F.col("id").desc())
    return s.limit(limit) if limit is not None else s


def available_products(products: DataFrame, inventory: DataFrame, suppliers: DataFrame,
                       category=None, supplier=None, min_stock: int = 1) -> DataFrame:
    """Q8.  Products with stock >= min_stock; inner joins to inventory and
    suppliers, so products without a supplier do not appear."""
    p, i, s = products.alias("p"), inventory.alias("i"), suppliers.alias("s")
    i = i.where(F.col("quantity") >= min_stock)
    if category is not None:
        p = p.where(F.col("category") == F.lit(category))
    if supplier is not None:
        s = s.where(F.col("name") == F.lit(supplier))
    j = (p.join(i, F.col("p.id") == F.col("i.product_id"), "inner")
         .join(s, F.col("p.supplier_id") == F.col("s.id"), "inner"))
    return j.select(
        F.col("p.id"), F.col("p.sku"), F.col("p.name"), F.col("p.description"),
        F.col("p.category"), F.col("s.name").alias("supplier"), F.col("p.purchase_price"),
        F.col("p.selling_price"), F.col("i.quantity"),
    ).orderBy(F.col("category").asc_nulls_first(), F.col("name").asc_nulls_first(), F.col("id"))


def event_products(assignments: DataFrame, products: DataFrame, suppliers: DataFrame,
                   inventory: DataFrame, event_id=None) -> DataFrame:
    """Q9.  Products assigned to a fair (all fairs when ``event_id`` is None)
    with the fair price (``event_sale_price`` or the list price)."""
    ep = assignments.alias("ep")
    if event_id is not None:
        ep = ep.where(F.col("event_id") == F.lit(event_id))
    p, s, i = products.alias("p"), suppliers.alias("s"), inventory.alias("i")
    j = (ep.join(p, F.col("ep.product_id") == F.col("p.id"))
         .join(s, F.col("p.supplier_id") == F.col("s.id"))
         .join(i, F.col("p.id") == F.col("i.product_id")))
    return j.select(
        F.col("ep.event_id"), F.col("p.id"), F.col("p.sku"), F.col("p.name"),
        F.col("p.description"), F.col("p.category"), F.col("s.name").alias("supplier"),
        F.col("p.purchase_price"),
        F.coalesce(F.col("ep.event_sale_price"), F.col("p.selling_price")).alias("sale_price"),
        F.col("ep.quantity_assigned"), F.col("i.quantity").alias("available_stock"),
    )


def event_by_name(annual_events: DataFrame, name=None) -> DataFrame:
    """Q10.  The first (smallest id) yearly event with the given name; with
    ``name`` None, the first event of every name."""
    a = annual_events
    if name is not None:
        a = a.where(F.col("nome") == F.lit(name))
    first = a.groupBy("nome").agg(F.min("id").alias("_first_id"))
    return a.join(first, (a.nome == first.nome) & (a.id == first._first_id), "left_semi")


def event_details(fairs: DataFrame, event_id) -> DataFrame:
    """Q11.  Fair row by id (empty if unknown)."""
    return fairs.where(F.col("id") == F.lit(event_id)).select(
        "id", "name", "start_date", "end_date", "location", "description")


def year_bounds(year: int):
    return _dt.date(year, 1, 1), _dt.date(year + 1, 1, 1)


def fairs_in_year(fairs: DataFrame, year: int) -> DataFrame:
    """Fairs starting in ``year`` (unsorted, for use inside joins), as a
    half-open date range, which keeps the predicate pushable to the scan."""
    lo, hi = year_bounds(year)
    return fairs.where((F.col("start_date") >= F.lit(lo)) & (F.col("start_date") < F.lit(hi)))


def events_in_year(fairs: DataFrame, year: int) -> DataFrame:
    """Q12.  Fairs starting in ``year``, ordered by start date."""
    return (fairs_in_year(fairs, year)
            .select("id", "name", "start_date", "end_date", "location", "description")
            .orderBy("start_date", "id"))


def year_products(products: DataFrame, assignments: DataFrame, fairs: DataFrame,
                  suppliers: DataFrame, year: int) -> DataFrame:
    """Distinct products assigned to any fair of ``year`` (unsorted).  Written
    as semi joins (EXISTS), so no wide DISTINCT over the joined rows."""
    fy = fairs_in_year(fairs, year).select(F.col("id").alias("event_id"))
    assigned = assignments.join(fy, "event_id", "left_semi").select(
        F.col("product_id").alias("pid"))
    p, s = products.alias("p"), suppliers.alias("s")
    p = p.join(assigned, F.col("p.id") == assigned.pid, "left_semi")
    return p.join(s, F.col("p.supplier_id") == F.col("s.id")).select(
        F.col("p.id"), F.col("p.sku"), F.col("p.name"), F.col("p.description"),
        F.col("p.category"), F.col("s.name").alias("supplier"),
    )


def products_in_year(products: DataFrame, assignments: DataFrame, fairs: DataFrame,
                     suppliers: DataFrame, year: int) -> DataFrame:
    """Q13.  ``year_products`` ordered by category and name."""
    return year_products(products, assignments, fairs, suppliers, year).orderBy(
        F.col("category").asc_nulls_first(), F.col("name").asc_nulls_first(), F.col("id"))
