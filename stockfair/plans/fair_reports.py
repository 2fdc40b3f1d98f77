"""The fair report and the yearly programme as sets of sections (K2): the
performance table is computed once and checkpointed, then every section
derives from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockfair.operators import catalog, reports
from stockfair.session import stored


def event_report(assignments: DataFrame, products: DataFrame, suppliers: DataFrame,
                 sales: DataFrame, fairs: DataFrame, event_id=None,
                 top_k: int = 10) -> dict[str, DataFrame]:
    """Sections of the per-fair report (all fairs when ``event_id`` is None):
    products & sales, summary, category and supplier breakdowns, top products
    by quantity and by revenue."""
    exact = stored(reports.event_performance(assignments, products, suppliers, sales,
                                                  event_id, exact=True))
    perf = exact.withColumns({c: F.round(c, 2) for c in ("total_revenue", "profit")})
    return {
        "products_sales": perf,
        "summary": reports.event_summary(exact, fairs),
        "category_breakdown": reports.category_breakdown(exact),
        "supplier_breakdown": reports.supplier_breakdown(exact),
        "top_products": reports.top_products(perf, "quantity_sold", top_k),
        "top_products_revenue": reports.top_products(perf, "total_revenue", top_k),
    }


def annual_programme(products: DataFrame, assignments: DataFrame, fairs: DataFrame,
                     suppliers: DataFrame, sales: DataFrame, year: int,
                     helmets: str = "Helmets", sunglasses: str = "Sunglasses") -> dict[str, DataFrame]:
    """Sections of the yearly programme: the product x fair pivot, the fair
    list, the offer counts and the prize template.  No fair in the year is an
    error, as in the original."""
    if catalog.fairs_in_year(fairs, year).limit(1).count() == 0:
        raise ValueError(f"No events found for year {year}")
    yp = catalog.year_products(products, assignments, fairs, suppliers, year)
    return {
        "programme": reports.programme_pivot(products, assignments, fairs, suppliers, sales, year),
        "events": reports.event_list(fairs, year),
        "offer": reports.offer_counts(yp, helmets, sunglasses),
        "prizes": reports.prize_template(fairs, year),
    }
