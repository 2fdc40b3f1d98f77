"""Registered queries over the driver tables: one callable ``(spark, sf_dir)

Each reads the driver's parquet tables through ``DriverTables`` and applies
the operator to whole tables; parameters (year, fair id, search term ...) are
fixed values from ``PARAMS`` so the SQL oracle in ``stockfair.oracle`` can
state the same query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockfair.functions import barcode
from stockfair.operators import (allocation, catalog, fairs, ingest, ledger, reports, request_log,
                                 scans, sheet_import, stats)
from stockfair.plans import catalogue_import, fair_reports
from stockfair.streaming import jobs, upkeep
from stockfair.sources import sheets, sinks
from stockfair.session import stored
from stockfair.sources.driver import DriverTables, padded

# Fixed query parameters shared with the SQL oracles.
PARAMS = {
    "year": 1997,
    "event_id": 199707,
    "search_term": "Ring",
    "low_stock": 5,
    "page_limit": 100,
    "page_offset": 50,
    "history_product": 7,
    "history_start": "2024-01-03",
    "history_end": "2024-01-25",
    "log_type": "stock_out",
    "log_start": "2024-01-10",
    "min_stock": 10,
    "offer_helmets": "PROMO",
    "offer_sunglasses": "SMALL",
    "top_n": 5,
    "top_k": 10,
}

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def _t(spark, sf_dir) -> DriverTables:
    return DriverTables(spark, sf_dir)


# -- catalogue reads (Q1-Q13) -------------------------------------------------

@register("product_by_barcode")
def q_product_by_barcode(spark, sf_dir):
    t = _t(spark, sf_dir)
    keys = t.scans().select(barcode.clean("barcode").alias("barcode")).distinct()
    return catalog.product_by_barcode(t.products(), t.inventory(), keys)


@register("product_by_sku")
def q_product_by_sku(spark, sf_dir):
    t = _t(spark, sf_dir)
    keys = t.movements().select(
        F.concat(F.lit("SKU"), padded(F.col("product_id"), 6)).alias("sku")
    ).distinct()
    return catalog.product_by_sku(t.products(), t.inventory(), keys)


@register("search_products")
def q_search_products(spark, sf_dir):
    t = _t(spark, sf_dir)
    return catalog.search_products(t.products(), t.inventory(), PARAMS["search_term"])


@register("inventory_status")
def q_inventory_status(spark, sf_dir):
    t = _t(spark, sf_dir)
    return catalog.inventory_status(t.products(), t.inventory(), t.suppliers(),
                                    PARAMS["page_limit"], PARAMS["page_offset"])


@register("low_stock_items")
def q_low_stock_items(spark, sf_dir):
    t = _t(spark, sf_dir)
    return catalog.low_stock_items(t.products(), t.inventory(), t.suppliers(), PARAMS["low_stock"])


@register("transaction_history")
def q_transaction_history(spark, sf_dir):
    t = _t(spark, sf_dir)
    return catalog.transaction_history(t.inventory_transactions(), t.products(),
                                       PARAMS["history_product"], PARAMS["history_start"],
                                       PARAMS["history_end"], limit=100)


@register("stock_log_query")
def q_stock_log_query(spark, sf_dir):
    t = _t(spark, sf_dir)
    return catalog.stock_log_query(t.stock_log(), PARAMS["log_type"], PARAMS["log_start"],
                                   None, limit=100)


@register("available_products")
def q_available_products(spark, sf_dir):
    t = _t(spark, sf_dir)
    return catalog.available_products(t.products(), t.inventory(), t.suppliers(),
                                      min_stock=PARAMS["min_stock"])


@register("event_products")
def q_event_products(spark, sf_dir):
    t = _t(spark, sf_dir)
    return catalog.event_products(t.event_products(), t.products(), t.suppliers(), t.inventory())


@register("event_by_name")
def q_event_by_name(spark, sf_dir):
    return catalog.event_by_name(_t(spark, sf_dir).annual_events())


@register("event_details")
def q_event_details(spark, sf_dir):
    return catalog.event_details(_t(spark, sf_dir).fairs(), PARAMS["event_id"])


@register("events_in_year")
def q_events_in_year(spark, sf_dir):
    return catalog.events_in_year(_t(spark, sf_dir).fairs(), PARAMS["year"])


@register("products_in_year")
def q_products_in_year(spark, sf_dir):
    t = _t(spark, sf_dir)
    return catalog.products_in_year(t.products(), t.event_products(), t.fairs(), t.suppliers(),
                                    PARAMS["year"])


# -- yearly statistics (A1-A7) --------------------------------------------------

@register("event_totals")
def q_event_totals(spark, sf_dir):
    return stats.event_totals(_t(spark, sf_dir).annual_events())


@register("events_per_region")
def q_events_per_region(spark, sf_dir):
    return stats.events_per_region(_t(spark, sf_dir).annual_events())


@register("income_by_year")
def q_income_by_year(spark, sf_dir):
    return stats.income_by_year(_t(spark, sf_dir).annual_events(), PARAMS["year"])


@register("cost_by_year")
def q_cost_by_year(spark, sf_dir):
    return stats.cost_by_year(_t(spark, sf_dir).annual_events(), PARAMS["year"])


@register("region_counts_year")
def q_region_counts_year(spark, sf_dir):
    return stats.events_per_region(_t(spark, sf_dir).annual_events(), PARAMS["year"])


@register("top_events")
def q_top_events(spark, sf_dir):
    return stats.top_events(_t(spark, sf_dir).annual_events(), PARAMS["year"], PARAMS["top_n"])


@register("top_events_per_year")
def q_top_events_per_year(spark, sf_dir):
    return stats.top_events_per_year(_t(spark, sf_dir).annual_events(), PARAMS["top_n"])


@register("product_line_sales")
def q_product_line_sales(spark, sf_dir):
    return stats.product_line_sales(_t(spark, sf_dir).annual_events(), PARAMS["year"])


@register("annual_summary")
def q_annual_summary(spark, sf_dir):
    return stats.annual_summary(_t(spark, sf_dir).annual_events())


# -- fair reports (A8-A20, K3) -------------------------------------------------

def performance(spark, sf_dir, exact: bool = False) -> DataFrame:
    t = _t(spark, sf_dir)
    return reports.event_performance(t.event_products(), t.products(), t.suppliers(),
                                      t.event_sales(), exact=exact)


@register("event_product_sales")
def q_event_product_sales(spark, sf_dir):
    t = _t(spark, sf_dir)
    return reports.event_product_sales(t.event_sales(), t.products())


@register("event_performance")
def q_event_performance(spark, sf_dir):
    return performance(spark, sf_dir)


@register("event_summary")
def q_event_summary(spark, sf_dir):
    return reports.event_summary(performance(spark, sf_dir, exact=True), _t(spark, sf_dir).fairs())


@register("category_breakdown")
def q_category_breakdown(spark, sf_dir):
    return reports.category_breakdown(performance(spark, sf_dir, exact=True))


@register("supplier_breakdown")
def q_supplier_breakdown(spark, sf_dir):
    return reports.supplier_breakdown(performance(spark, sf_dir, exact=True))


@register("top_products_qty")
def q_top_products_qty(spark, sf_dir):
    return reports.top_products(stored(performance(spark, sf_dir)), "quantity_sold",
                                PARAMS["top_k"])


@register("top_products_revenue")
def q_top_products_revenue(spark, sf_dir):
    return reports.top_products(stored(performance(spark, sf_dir)), "total_revenue",
                                PARAMS["top_k"])


@register("year_event_product_sales")
def q_year_event_product_sales(spark, sf_dir):
    t = _t(spark, sf_dir)
    return reports.year_event_product_sales(t.event_sales(), t.products(), t.fairs(),
                                            PARAMS["year"])


@register("programme_pivot")
def q_programme_pivot(spark, sf_dir):
    t = _t(spark, sf_dir)
    return reports.programme_pivot(t.products(), t.event_products(), t.fairs(), t.suppliers(),
                                   t.event_sales(), PARAMS["year"])


@register("programme_no_sales")
def q_programme_no_sales(spark, sf_dir):
    """The pivot of a year none of whose fairs sold anything: every fair is a
    column of zeros."""
    t = _t(spark, sf_dir)
    ids = catalog.fairs_in_year(t.fairs(), PARAMS["year"]).select(F.col("id").alias("event_id"))
    other = t.event_sales().join(ids, "event_id", "left_anti")
    return reports.programme_pivot(t.products(), t.event_products(), t.fairs(), t.suppliers(), other,
                                   PARAMS["year"])


@register("programme_cells")
def q_programme_cells(spark, sf_dir):
    t = _t(spark, sf_dir)
    return reports.programme_cells(t.products(), t.event_products(), t.fairs(), t.suppliers(),
                                   t.event_sales(), PARAMS["year"])


@register("event_list")
def q_event_list(spark, sf_dir):
    return reports.event_list(_t(spark, sf_dir).fairs(), PARAMS["year"])


@register("offer_counts")
def q_offer_counts(spark, sf_dir):
    t = _t(spark, sf_dir)
    yp = catalog.year_products(t.products(), t.event_products(), t.fairs(), t.suppliers(),
                               PARAMS["year"])
    return reports.offer_counts(yp, PARAMS["offer_helmets"], PARAMS["offer_sunglasses"])


@register("prize_template")
def q_prize_template(spark, sf_dir):
    return reports.prize_template(_t(spark, sf_dir).fairs(), PARAMS["year"])


@register("safe_report_name")
def q_safe_report_name(spark, sf_dir):
    return reports.report_name(_t(spark, sf_dir).fairs())


# -- stock ledger (M1-M4) --------------------------------------------------------

def ledger_decisions(spark, sf_dir) -> DataFrame:
    t = _t(spark, sf_dir)
    return ledger.apply_ledger(t.movements(), ledger.opening_balances(t.inventory()))


@register("apply_ledger")
def q_apply_ledger(spark, sf_dir):
    return ledger_decisions(spark, sf_dir)


@register("stock_on_hand")
def q_stock_on_hand(spark, sf_dir):
    t = _t(spark, sf_dir)
    return ledger.stock_on_hand(ledger_decisions(spark, sf_dir),
                                ledger.opening_balances(t.inventory()))


@register("stock_log_rows")
def q_stock_log_rows(spark, sf_dir):
    return ledger.stock_log_rows(ledger_decisions(spark, sf_dir))


@register("ledger_from_zero")
def q_ledger_from_zero(spark, sf_dir):
    """Outcome counts of the fold with every product opening at 0."""
    d = ledger.apply_ledger(_t(spark, sf_dir).movements())
    return d.groupBy("transaction_type", "accepted", "reason").agg(
        F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("units"))


@register("ledger_by_day")
def q_ledger_by_day(spark, sf_dir):
    """Movements that share a seq."""
    t = _t(spark, sf_dir)
    return ledger.apply_ledger(t.daily_movements(), ledger.opening_balances(t.inventory()))


# -- barcodes and scans (B1-B6) -------------------------------------------------

SCAN_TIMEOUT_S = 1800.0


def code_variants(products: DataFrame) -> DataFrame:
    """Codes of several lengths cut from each product's EAN-13: 13, 12 (UPC-A
    shape), 8 (EAN-8 shape), 14 (GTIN-14 shape) and 6 digits (too short)."""
    e = products.where(F.col("ean_upc").isNotNull()).select("id", "ean_upc")
    variants = [("ean13", F.col("ean_upc")), ("upc12", F.substring("ean_upc", 2, 12)),
                ("ean8", F.substring("ean_upc", 6, 8)),
                ("gtin14", F.concat(F.lit("1"), F.col("ean_upc"))),
                ("short", F.substring("ean_upc", 8, 6))]
    out = None
    for name, c in variants:
        part = e.select("id", F.lit(name).alias("variant"), c.alias("raw"))
        out = part if out is None else out.unionByName(part)
    return out


@register("barcode_clean")
def q_barcode_clean(spark, sf_dir):
    s = _t(spark, sf_dir).scans()
    return s.select("scan_id", "barcode", barcode.clean("barcode").alias("code"))


@register("barcode_valid")
def q_barcode_valid(spark, sf_dir):
    v = code_variants(_t(spark, sf_dir).products())
    return v.select("id", "variant", "raw", barcode.is_valid(barcode.clean("raw")).alias("valid"))


@register("barcode_check_digit")
def q_barcode_check_digit(spark, sf_dir):
    p = _t(spark, sf_dir).products().where(F.col("ean_upc").isNotNull())
    return p.select(
        "id",
        barcode.check_digit(F.substring("ean_upc", 1, 12)).alias("cd_body12"),
        barcode.check_digit(F.substring("ean_upc", 2, 11)).alias("cd_body11"),
        barcode.check_digit(F.substring("ean_upc", 6, 7)).alias("cd_body7"),
    )


@register("scan_dedupe")
def q_scan_dedupe(spark, sf_dir):
    return scans.scan_dedupe(_t(spark, sf_dir).scans(), SCAN_TIMEOUT_S)


@register("scan_lookup")
def q_scan_lookup(spark, sf_dir):
    t = _t(spark, sf_dir)
    return scans.scan_lookup(t.scans(), t.products(), t.inventory(), SCAN_TIMEOUT_S)


@register("batch_scan_summary")
def q_batch_scan_summary(spark, sf_dir):
    t = _t(spark, sf_dir)
    return scans.batch_scan_summary(t.scans(), t.products(), t.inventory())


@register("batch_scan_products")
def q_batch_scan_products(spark, sf_dir):
    t = _t(spark, sf_dir)
    return scans.batch_scan_products(t.scans(), t.products(), t.inventory())


# -- allocation to fairs and fair edits (M5-M12) ------------------------------------

PARAMS.update({"edit_event_id": 42, "edit_column": "regione", "edit_value": "Lazio"})


def _available(t: DriverTables) -> DataFrame:
    return allocation.available_stock(t.inventory())


def batch_decisions(spark, sf_dir) -> DataFrame:
    t = _t(spark, sf_dir)
    return allocation.allocate_batch(t.allocation_requests(), _available(t))


@register("allocate_batch")
def q_allocate_batch(spark, sf_dir):
    return batch_decisions(spark, sf_dir)


@register("allocate_batches")
def q_allocate_batches(spark, sf_dir):
    t = _t(spark, sf_dir)
    return allocation.allocate_in_turn(t.allocation_requests(), _available(t))


@register("allocation_snapshot")
def q_allocation_snapshot(spark, sf_dir):
    t = _t(spark, sf_dir)
    # requests and assignments come from the same lines: put together and stored once
    lines = stored(t.summed_lines())
    decisions = allocation.allocate_batch(t.allocation_requests(lines), _available(t), kept=True)
    return allocation.allocation_snapshot(decisions, t.event_products(lines))


@register("allocate_rows")
def q_allocate_rows(spark, sf_dir):
    t = _t(spark, sf_dir)
    return allocation.allocate_rows(t.allocation_sheet(), t.products(), _available(t))


@register("allocate_sheets")
def q_allocate_sheets(spark, sf_dir):
    """Sheets that each count from 1 and repeat their numbers."""
    t = _t(spark, sf_dir)
    return allocation.allocate_rows(t.line_sheets(), t.products(), _available(t))


@register("allocate_rows_summary")
def q_allocate_rows_summary(spark, sf_dir):
    return allocation.allocate_rows_summary(q_allocate_rows(spark, sf_dir))


@register("allocate_rows_assignments")
def q_allocate_rows_assignments(spark, sf_dir):
    return allocation.rows_snapshot(q_allocate_rows(spark, sf_dir), _t(spark, sf_dir).event_products())


@register("reassigned_assignments")
def q_reassigned_assignments(spark, sf_dir):
    t = _t(spark, sf_dir)
    return allocation.reassigned(q_reassign_quantity(spark, sf_dir), t.event_products())


@register("unassign_assignments")
def q_unassign_assignments(spark, sf_dir):
    t = _t(spark, sf_dir)
    kept, _ = allocation.unassign_snapshot(_unassign_requests(t), t.event_products(), _available(t))
    return kept


@register("reassign_quantity")
def q_reassign_quantity(spark, sf_dir):
    t = _t(spark, sf_dir)
    return allocation.reassign_quantity(t.quantity_true_up(), t.event_products(), _available(t))


def _unassign_requests(t: DriverTables) -> DataFrame:
    return t.event_sales().select("event_id", "product_id").distinct()


@register("unassign_product")
def q_unassign_product(spark, sf_dir):
    t = _t(spark, sf_dir)
    return allocation.unassign_product(_unassign_requests(t), t.event_products())


@register("unassign_available")
def q_unassign_available(spark, sf_dir):
    t = _t(spark, sf_dir)
    _, avail = allocation.unassign_snapshot(_unassign_requests(t), t.event_products(),
                                            _available(t))
    return avail


def _calls(spark, sf_dir) -> DataFrame:
    t = _t(spark, sf_dir)
    return request_log.decide(t.request_log(), t.event_products(), _available(t))


@register("request_log")
def q_request_log(spark, sf_dir):
    """Allocations, changes and removals on one stock, one after the other."""
    return _calls(spark, sf_dir)


@register("request_log_assignments")
def q_request_log_assignments(spark, sf_dir):
    return request_log.assignments_after(stored(_calls(spark, sf_dir)), _t(spark, sf_dir).event_products())


@register("update_event")
def q_update_event(spark, sf_dir):
    return fairs.update_event(_t(spark, sf_dir).annual_events(), PARAMS["edit_event_id"],
                              PARAMS["edit_column"], PARAMS["edit_value"])


@register("delete_event")
def q_delete_event(spark, sf_dir):
    return fairs.delete_event(_t(spark, sf_dir).annual_events(), PARAMS["edit_event_id"])


@register("create_events")
def q_create_events(spark, sf_dir):
    t = _t(spark, sf_dir)
    rows = t.fairs().select(F.col("id").alias("seq"), F.col("name").alias("nome"),
                            F.date_format("start_date", "yyyy-MM-dd").alias("data"),
                            F.col("location").alias("localita"))
    return fairs.create_events(t.annual_events(), rows)


@register("create_fairs")
def q_create_fairs(spark, sf_dir):
    """Every fair is offered again for the year after."""
    f = _t(spark, sf_dir).fairs()
    again = f.select(F.concat_ws(" ", "name", F.lit("again")).alias("name"),
                     F.add_months("start_date", 12).alias("start_date"),
                     F.add_months("end_date", 12).alias("end_date"), "location", "description")
    return fairs.create_fairs(f, again)


@register("assign_products")
def q_assign_products(spark, sf_dir):
    """Products sold at a fair without an assignment get one."""
    t = _t(spark, sf_dir)
    sold = t.event_sales().groupBy("event_id", "product_id").agg(F.sum("quantity").alias("quantity"))
    missing = sold.join(t.event_products(), ["event_id", "product_id"], "left_anti")
    return fairs.assign_products(t.event_products(), missing.withColumn("sale_price", F.lit(None).cast("double")))


@register("append_sales")
def q_append_sales(spark, sf_dir):
    t = _t(spark, sf_dir)
    return fairs.append_sales(t.event_sales(), q_record_sales(spark, sf_dir))


@register("record_sales")
def q_record_sales(spark, sf_dir):
    t = _t(spark, sf_dir)
    return fairs.record_sales(t.returned_sales(), t.event_products())


# -- price-list import (S2, S3, S7, I1-I11) and event sheet import (I12-I18, K5) --------

def _import(t: DriverTables):
    return catalogue_import.plan_import(t.price_list_lines(), t.suppliers())


def _facts(t: DriverTables) -> DataFrame:
    return ingest.file_facts(t.price_list_lines())


@register("detect_header_row")
def q_detect_header_row(spark, sf_dir):
    return _facts(_t(spark, sf_dir)).select("file", "header_row", "header_line")


@register("guess_supplier")
def q_guess_supplier(spark, sf_dir):
    return _facts(_t(spark, sf_dir)).select("file", "supplier")


@register("detect_columns")
def q_detect_columns(spark, sf_dir):
    return ingest.mapping_of(_facts(_t(spark, sf_dir)))


@register("drop_empty")
def q_drop_empty(spark, sf_dir):
    t = _t(spark, sf_dir)
    return ingest.filled_cells(t.price_list_lines(), _facts(t))


@register("clean_products")
def q_clean_products(spark, sf_dir):
    rows = _import(_t(spark, sf_dir)).rows
    return rows.withColumn("mapped", F.array_join("mapped", ","))


@register("get_or_create_supplier")
def q_get_or_create_supplier(spark, sf_dir):
    return _import(_t(spark, sf_dir)).suppliers


@register("match_products")
def q_match_products(spark, sf_dir):
    t = _t(spark, sf_dir)
    m = ingest.match_products(t.products(), _import(t).rows)
    return m.select("file", "line_no", "ean_upc", "sku", "name", "pid")


@register("upsert_products")
def q_upsert_products(spark, sf_dir):
    t = _t(spark, sf_dir)
    return _import(t).products(t.products())


@register("upsert_recoded")
def q_upsert_recoded(spark, sf_dir):
    """An import in which codes move from product to product."""
    t = _t(spark, sf_dir)
    return catalogue_import.plan_import(t.recoded_lines(), t.suppliers()).products(t.products())


@register("import_stats_recoded")
def q_import_stats_recoded(spark, sf_dir):
    t = _t(spark, sf_dir)
    return catalogue_import.plan_import(t.recoded_lines(), t.suppliers()).stats(t.products())


@register("import_stats")
def q_import_stats(spark, sf_dir):
    t = _t(spark, sf_dir)
    return _import(t).stats(t.products())


@register("init_inventory")
def q_init_inventory(spark, sf_dir):
    t = _t(spark, sf_dir)
    return ingest.init_inventory(t.products(), _import(t).products(t.products()))


@register("ingest_annual_events")
def q_ingest_annual_events(spark, sf_dir):
    return sheet_import.ingest_annual_events(_t(spark, sf_dir).event_sheet(), "_row")


@register("ingest_rejects")
def q_ingest_rejects(spark, sf_dir):
    return sheet_import.ingest_rejects(_t(spark, sf_dir).event_sheet(), "_row")


@register("normalise_event_date")
def q_normalise_event_date(spark, sf_dir):
    s = _t(spark, sf_dir).event_sheet()
    return s.select(F.col("_row").alias("id"), F.col("Data").alias("raw"),
                    sheet_import.normalise_event_date(F.col("Data")).alias("data"))


@register("profile_table")
def q_profile_table(spark, sf_dir):
    return sheet_import.profile_table(_t(spark, sf_dir).event_sheet().drop("_row"))


@register("profile_columns")
def q_profile_columns(spark, sf_dir):
    return sheet_import.profile_columns(_t(spark, sf_dir).event_sheet().drop("_row"))


@register("profile_types")
def q_profile_types(spark, sf_dir):
    return sheet_import.infer_column_types(_t(spark, sf_dir).event_sheet().drop("_row"))


@register("profile_sheet_types")
def q_profile_sheet_types(spark, sf_dir):
    t = _t(spark, sf_dir)
    return sheet_import.infer_sheet_types(ingest.filled_cells(t.price_list_lines(), _facts(t)))


@register("sample_rows")
def q_sample_rows(spark, sf_dir):
    return sheet_import.sample_rows(_t(spark, sf_dir).event_sheet(), "Periodo", "_row")


@register("scan_annual_events")
def q_scan_annual_events(spark, sf_dir):
    return _t(spark, sf_dir).annual_events()


@register("constraint_report")
def q_constraint_report(spark, sf_dir):
    t = _t(spark, sf_dir)
    return sheet_import.constraint_report(t.suppliers(), t.products(), t.inventory(),
                                          t.inventory_transactions(), t.stock_log())


# -- streams (R1, R2): rows-only checks against the batch jobs ------------------------

@register("scan_stream")
def q_scan_stream(spark, sf_dir):
    t = _t(spark, sf_dir)
    stream = jobs.scan_stream(t.scans(t.raw_stream("events")), t.products(), t.inventory(),
                              SCAN_TIMEOUT_S)
    return jobs.drain(stream, "scan_stream")


@register("ledger_stream")
def q_ledger_stream(spark, sf_dir):
    t = _t(spark, sf_dir)
    stream = jobs.ledger_stream(t.movements(t.raw_stream("events")),
                                ledger.opening_balances(t.inventory()))
    return jobs.drain(stream, "ledger_stream")


# -- streams kept as tables (R1 in event-time order, R2 with a stock table) -------------

DELIVERIES, DELAY_S = 3, 2 * 86400.0


@register("scan_upkeep")
def q_scan_upkeep(spark, sf_dir):
    """Deliveries that overlap in time by a day, decided in event-time order."""
    t = _t(spark, sf_dir)
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) + F.col("event_id") % 2
    piece = F.least(F.greatest(F.floor(day / 11), F.lit(0)), F.lit(DELIVERIES - 1))
    keeper = None
    for stream, folder in t.landed_events(F.coalesce(piece, F.lit(0)), DELIVERIES):
        keeper = keeper or upkeep.ScanUpkeep(upkeep.Versions(spark, f"{folder}/scans"), t.products(), t.inventory(),
                                             SCAN_TIMEOUT_S, DELAY_S)
        upkeep.run(t.scans(stream), keeper.process, f"{folder}/checkpoint")
    return keeper.finish()


def _kept_ledger(spark, sf_dir) -> upkeep.LedgerUpkeep:
    t = _t(spark, sf_dir)
    last = t.raw("events").agg(F.coalesce(F.max("event_id"), F.lit(0))).first()[0]
    piece = F.floor(F.col("event_id") * DELIVERIES / F.lit(last + 1))
    keeper = None
    for stream, folder in t.landed_events(F.coalesce(piece, F.lit(0)), DELIVERIES):
        keeper = keeper or upkeep.LedgerUpkeep(upkeep.Versions(spark, f"{folder}/ledger"),
                                               ledger.opening_balances(t.inventory()))
        upkeep.run(t.movements(stream), keeper.process, f"{folder}/checkpoint")
    return keeper


@register("ledger_upkeep")
def q_ledger_upkeep(spark, sf_dir):
    """The stock table after every delivery of movements."""
    return _kept_ledger(spark, sf_dir).stock()


# -- files: sheets read from where they landed, tables and reports written and read back ----

@register("src_price_list")
def q_src_price_list(spark, sf_dir):
    """S1, S2, S4: every cell of a folder of price lists, with cells over lines."""
    return sheets.sheet_cells(sheets.read_sheet_lines(spark, _t(spark, sf_dir).landed_lists()))


@register("src_event_sheet")
def q_src_event_sheet(spark, sf_dir):
    """S5: the event sheets of a folder, imported."""
    t = _t(spark, sf_dir)
    sheet = sheets.read_event_sheet(spark, t.landed_csv(t.event_sheet()))
    return sheet_import.ingest_annual_events(sheet.withColumn("_row", F.col("_row").cast("long")), "_row")


@register("src_allocation_sheet")
def q_src_allocation_sheet(spark, sf_dir):
    """S6, M8: landed allocation sheets, checked for their columns and decided."""
    t = _t(spark, sf_dir)
    sheet = sheets.read_event_sheet(spark, t.landed_csv(t.allocation_sheet()))
    missing = allocation.missing_sheet_columns(sheet)
    if missing:
        raise ValueError(allocation.MSG_MISSING_COLUMNS.format(cols=", ".join(missing)))
    return allocation.allocate_rows(sheet.withColumn("seq", F.col("seq").cast("long")), t.products(), _available(t))


@register("written_transactions")
def q_written_transactions(spark, sf_dir):
    """K1: the transactions table after two appends."""
    t = _t(spark, sf_dir)
    path, moves = f"{t.landing()}/inventory_transactions", t.inventory_transactions()
    for rest in (0, 1):
        sinks.append_table(moves.where(F.col("id") % 2 == rest), path, "inventory_transactions")
    return spark.read.parquet(path)


@register("written_report")
def q_written_report(spark, sf_dir):
    """K2: the category section of the fair report, as written."""
    t = _t(spark, sf_dir)
    out = sinks.write_report(fair_reports.event_report(t.event_products(), t.products(), t.suppliers(), t.event_sales(),
                                                       t.fairs()), f"{t.landing()}/report")
    return spark.read.parquet(out["category_breakdown"])
