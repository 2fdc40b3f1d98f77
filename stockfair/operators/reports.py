"""Fair reports: per-fair performance table, summary metrics, category and
supplier roll-ups with a TOTAL row, top-k lists, and the yearly programme
(product x fair pivot, fair list, offer counts, prize template).

All sections derive from one ``event_performance`` DataFrame, so a caller can
cache or checkpoint it once and build every section from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockfair.functions import text
from stockfair.operators import catalog


def _ratio(num: Column, den: Column, scale: float = 1.0) -> Column:
    return F.when(den > 0, num / den * scale).otherwise(F.lit(0.0))


def _cents(c: Column, exact: bool) -> Column:
    return c if exact else F.round(c, 2)


def event_product_sales(sales: DataFrame, products: DataFrame, event_id=None,
                        exact: bool = False) -> DataFrame:
    """A8.  Quantity and revenue per (fair, product); sales of unknown
    products drop out.  A partial (map-side) aggregate before the shuffle."""
    g = _sold(sales if event_id is None else sales.where(F.col("event_id") == F.lit(event_id)))
    p = products.select(F.col("id").alias("pid"), "sku")
    return g.join(p, g.product_id == p.pid, "inner").select(
        "event_id", "product_id", "sku", "quantity_sold",
        _cents(F.col("_revenue"), exact).alias("total_revenue"))


def _sold(sales: DataFrame) -> DataFrame:
    return sales.groupBy("event_id", "product_id").agg(
        F.sum("quantity").alias("quantity_sold"),
        F.sum(F.col("quantity") * F.col("sale_price")).alias("_revenue"),
    )


def event_performance(assignments: DataFrame, products: DataFrame, suppliers: DataFrame,
                      sales: DataFrame, event_id=None, exact: bool = False) -> DataFrame:
    """A9.  Assigned products of each fair with what was sold: sold and
    revenue default to 0, remaining = assigned - sold, profit = revenue -
    sold * purchase price (NULL when the purchase price is unknown).  Sales
    of products never assigned to the fair are left out.  Amounts are rounded
    for printing; with ``exact`` they are not, which is what the summary and
    the breakdowns sum."""
    ep = assignments if event_id is None else assignments.where(F.col("event_id") == F.lit(event_id))
    sold = _sold(sales if event_id is None else sales.where(F.col("event_id") == F.lit(event_id))).select(
        F.col("event_id").alias("s_event_id"), F.col("product_id").alias("s_product_id"),
        "quantity_sold", F.col("_revenue").alias("total_revenue"))
    # what was sold goes to the narrow assignments: names and texts are joined last, so
    # that the shuffles by (fair, product) do not carry them
    ep = ep.select("event_id", "product_id", "event_sale_price", "quantity_assigned") \
        .withColumnRenamed("event_id", "a_event_id")
    ep = ep.join(sold, (F.col("a_event_id") == F.col("s_event_id"))
                 & (F.col("product_id") == F.col("s_product_id")), "left").withColumnRenamed("a_event_id", "event_id")
    # a product listed k times has its sales k times, as in ``event_product_sales``
    times = F.count(F.lit(1)).over(Window.partitionBy("id"))
    ep, p, s = ep.alias("ep"), products.withColumn("_times", times).alias("p"), suppliers.alias("s")
    j = (ep.join(p, F.col("ep.product_id") == F.col("p.id"))
                .join(s, F.col("p.supplier_id") == F.col("s.id"))
                .select(
                    F.col("ep.event_id"), F.col("p.id"), F.col("p.sku"), F.col("p.name"),
                    F.col("p.description"), F.col("p.category"),
                    F.col("s.name").alias("supplier"), F.col("p.purchase_price"),
                    F.coalesce(F.col("ep.event_sale_price"), F.col("p.selling_price"))
                    .alias("sale_price"),
                    F.col("ep.quantity_assigned"), "quantity_sold", "total_revenue",
                    F.explode(F.array_repeat(F.lit(0), F.when(F.col("s_product_id").isNull(), F.lit(1))
                                             .otherwise(F.col("_times")).cast("int"))).alias("_copy")))
    q_sold = F.coalesce(F.col("quantity_sold"), F.lit(0).cast("long"))
    revenue = F.coalesce(F.col("total_revenue"), F.lit(0.0))
    return j.select(
        "event_id", "id", "sku", "name", "description", "category", "supplier",
        "purchase_price", "sale_price", "quantity_assigned",
        q_sold.alias("quantity_sold"), _cents(revenue, exact).alias("total_revenue"),
        (F.col("quantity_assigned") - q_sold).alias("remaining"),
        _cents(revenue - q_sold * F.col("purchase_price"), exact).alias("profit"),
    )


def event_summary(performance: DataFrame, fairs: DataFrame | None = None) -> DataFrame:
    """A10.  Headline metrics per fair (divisions by zero give 0), with the
    fair's name, start date, location and description when ``fairs`` is
    given."""
    g = performance.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("total_products"),
        F.sum("quantity_assigned").alias("total_assigned"),
        F.sum("quantity_sold").alias("total_sold"),
        F.sum("total_revenue").alias("_rev"),
        F.coalesce(F.sum("profit"), F.lit(0.0)).alias("_profit"),
    )
    # sums of doubles differ in their last digits by the order of the rows, which would decide ties
    rev, profit = F.round("_rev", 6), F.round("_profit", 6)
    out = g.select(
        "event_id", "total_products", "total_assigned", "total_sold",
        F.round(_ratio(F.col("total_sold"), F.col("total_assigned"), 100.0), 2)
        .alias("sell_through_pct"),
        F.round("_rev", 2).alias("total_revenue"),
        F.round("_profit", 2).alias("total_profit"),
        F.round(_ratio(rev, F.col("total_sold")), 2).alias("average_price"),
        F.round(_ratio(profit, rev, 100.0), 2).alias("profit_margin_pct"),
    )
    if fairs is None:
        return out
    f = fairs.select(F.col("id").alias("f_id"), F.col("name").alias("event_name"),
                     F.col("start_date").alias("event_date"), F.col("location"),
                     F.col("description"))
    return out.join(f, out.event_id == f.f_id, "left").drop("f_id")


def _breakdown(performance: DataFrame, key: str) -> DataFrame:
    """Per-fair roll-up by ``key`` plus one TOTAL row per fair (a ROLLUP
    grouping set, one aggregate job).  Rows whose key is NULL are left out of
    both, as a pandas group-by drops them."""
    g = (performance.where(F.col(key).isNotNull())
         .rollup("event_id", key)
         .agg(F.count(F.lit(1)).alias("products"),
              F.sum("quantity_assigned").alias("assigned"),
              F.sum("quantity_sold").alias("sold"),
              F.sum("total_revenue").alias("_rev"),
              F.coalesce(F.sum("profit"), F.lit(0.0)).alias("_profit"),
              F.grouping(key).alias("_is_total"),
              F.grouping("event_id").alias("_no_event"))
         .where(F.col("_no_event") == 0))
    return g.select(
        "event_id",
        F.when(F.col("_is_total") == 1, F.lit("TOTAL")).otherwise(F.col(key)).alias(key),
        (F.col("_is_total") == 1).alias("is_total"),
        "products", "assigned", "sold",
        F.round("_rev", 2).alias("revenue"),
        F.round("_profit", 2).alias("profit"),
        F.round(_ratio(F.col("sold"), F.col("assigned"), 100.0), 2).alias("sell_through_pct"),
    )


def category_breakdown(performance: DataFrame) -> DataFrame:
    """A11."""
    return _breakdown(performance, "category")


def supplier_breakdown(performance: DataFrame) -> DataFrame:
    """A12."""
    return _breakdown(performance, "supplier")


def top_products(performance: DataFrame, by: str = "quantity_sold", k: int = 10) -> DataFrame:
    """A13 / A14.  Top ``k`` products of each fair by ``by`` (ties by product
    id), only for fairs that sold something.  ``row_number() <= k`` is planned
    with a per-partition group limit before the shuffle, so a fair holding
    most rows still moves at most k rows per map task.  ``performance`` is read
    twice: callers materialise it once."""
    sold_any = (performance.groupBy("event_id").agg(F.sum("quantity_sold").alias("_s"))
                .where(F.col("_s") > 0).select("event_id"))
    w = Window.partitionBy("event_id").orderBy(F.col(by).desc_nulls_last(), F.col("id"))
    ranked = (performance.join(sold_any, "event_id", "left_semi")
              .withColumn("rank", F.row_number().over(w).cast("long"))
              .where(F.col("rank") <= k))
    return ranked.select("event_id", "rank", "sku", "name", "category", "supplier",
                         "quantity_sold", "total_revenue", "profit")


def year_event_product_sales(sales: DataFrame, products: DataFrame, fairs: DataFrame,
                             year: int) -> DataFrame:
    """A15.  Sales per (fair, product) for the fairs starting in ``year``."""
    fy = catalog.fairs_in_year(fairs, year).select(F.col("id").alias("f_id"),
                                                   F.col("name").alias("event_name"))
    s = sales.join(fy, sales.event_id == fy.f_id, "inner")
    g = s.groupBy("event_id", "event_name", "product_id").agg(
        F.sum("quantity").alias("quantity_sold"),
        F.sum(F.col("quantity") * F.col("sale_price")).alias("_rev"))
    p = products.select(F.col("id").alias("pid"), "sku")
    return g.join(p, g.product_id == p.pid, "inner").select(
        "event_id", "event_name", "product_id", "sku", "quantity_sold",
        F.round("_rev", 2).alias("total_revenue"))


def programme_cells(products: DataFrame, assignments: DataFrame, fairs: DataFrame,
                    suppliers: DataFrame, sales: DataFrame, year: int) -> DataFrame:
    """A16, long form: one row per product of ``year`` and fair that sold it,
    (id, event_id, event_name, quantity_sold, total), and one row with a NULL
    fair for each product that sold nothing.  Nothing is collected and no
    column depends on the data, so it is the form for many fairs."""
    rows = catalog.year_products(products, assignments, fairs, suppliers, year)
    ys = year_event_product_sales(sales, products, fairs, year).select(
        F.col("product_id").alias("pid"), "event_id", "event_name", "quantity_sold")
    total = F.coalesce(F.sum("quantity_sold").over(Window.partitionBy("id")), F.lit(0)).cast("long")
    return (rows.select("id").join(ys, F.col("id") == F.col("pid"), "left")
            .withColumn("totali", total)
            .select("id", "event_id", "event_name",
                    F.coalesce("quantity_sold", F.lit(0)).cast("long").alias("quantity_sold"),
                    "totali"))


def quoted(name: str) -> str:
    """A column name as an identifier, whatever it contains."""
    return "`" + name.replace("`", "``") + "`"


def pivot_column_name(event_id: Column, name: Column) -> Column:
    return F.concat_ws("_", event_id.cast("string"), name)


def programme_pivot(products: DataFrame, assignments: DataFrame, fairs: DataFrame,
                    suppliers: DataFrame, sales: DataFrame, year: int,
                    max_columns: int = 1000) -> DataFrame:
    """A16 / A17.  Products assigned in ``year`` x fairs of ``year``: quantity
    sold per cell (0 when none), plus a ``TOTALI`` column.  Only fairs with
    sales become columns; when the year has no sales at all every fair of the
    year becomes a 0 column.

    A wide table needs its columns known: the fairs of one year are collected,
    at most ``max_columns`` (``programme_cells`` is the form without a bound;
    beyond the bound this one raises instead of planning ever more columns).
    """
    rows = catalog.year_products(products, assignments, fairs, suppliers, year)
    fy = catalog.fairs_in_year(fairs, year).select(F.col("id").alias("f_id"), "name", "start_date")
    ys = year_event_product_sales(sales, products, fairs, year)
    with_sales = fy.join(ys.select(F.col("event_id").alias("f_id")), "f_id", "left_semi")
    def first(f: DataFrame):
        return f.orderBy("start_date", "f_id").limit(max_columns + 1).collect()

    cols = first(with_sales) or first(fy)
    if len(cols) > max_columns:
        raise ValueError(f"more than {max_columns} fairs in {year}: use programme_cells")
    names = [f"{r.f_id}_{r.name}" if r.name is not None else str(r.f_id) for r in cols]
    cells = ys.withColumn("col", pivot_column_name(F.col("event_id"), F.col("event_name")))
    piv = cells.groupBy(F.col("product_id").alias("pid")).pivot("col", names).agg(
        F.sum("quantity_sold"))
    out = rows.join(piv, rows.id == piv.pid, "left")
    filled = [F.coalesce(F.col(quoted(n)), F.lit(0)).cast("long") for n in names]
    return out.select(
        "id", "sku", "name", "description", "category", "supplier",
        *[c.alias(n) for c, n in zip(filled, names)],
        sum(filled, F.lit(0).cast("long")).alias("TOTALI"))


def event_list(fairs: DataFrame, year: int) -> DataFrame:
    """A18.  Fairs of the year with the English month name of the start."""
    e = catalog.events_in_year(fairs, year)
    return e.select(
        F.date_format("start_date", "MMMM").alias("periodo"),
        F.col("start_date").alias("data_inizio"), F.col("end_date").alias("data_fine"),
        F.col("name").alias("nome"), F.col("location").alias("localita"),
        F.col("description").alias("descrizione"), "id",
    )


def offer_counts(year_products: DataFrame, helmets: str = "Helmets",
                 sunglasses: str = "Sunglasses") -> DataFrame:
    """A19.  Number of the year's products in the helmet and sunglasses
    categories (category names are parameters)."""
    return year_products.agg(
        F.count_if(F.col("category") == F.lit(helmets)).alias("caschi"),
        F.count_if(F.col("category") == F.lit(sunglasses)).alias("occhiali"),
    )


def prize_template(fairs: DataFrame, year: int) -> DataFrame:
    """A20.  One row per fair of the year, with empty prize columns."""
    e = catalog.events_in_year(fairs, year)
    empty = F.lit(None).cast("string")
    return e.select(F.col("name").alias("nome"), empty.alias("modello"),
                    empty.alias("modello_1"), empty.alias("prezzo"), empty.alias("totale"))


def report_name(fairs: DataFrame) -> DataFrame:
    """K3.  Default file name of each fair report: the name with every
    non-alphanumeric character replaced by '_', then '_<id>.xlsx'."""
    return fairs.select("id", F.concat(text.safe_name("name"), F.lit("_"),
                                       F.col("id").cast("string"), F.lit(".xlsx"))
                        .alias("report_name"))


def programme_name(year: int) -> str:
    """K3, yearly form."""
    return f"PROGRAMMA_ANNUALE_{year}.xlsx"
