import datetime as dt

from pyspark.sql import functions as F

from stockfair.operators import catalog, reports

D = dt.date


def _f1(spark):
    """FIXTURES.md F1 with hand-written assignments and sales."""
    suppliers = spark.createDataFrame([(1, "Bollé"), (2, "FFWD"), (3, "B.I.S. Srl")],
                                      "id long, name string")
    products = spark.createDataFrame([
        (1, 1, "SKU001", "1234567890123", "Bollé Helmet X1", "Helmet", "Helmets", 80.0, 150.0),
        (2, 1, "SKU002", "1234567890124", "Bollé Sunglasses Pro", "Glasses", "Eyewear", 60.0, 120.0),
        (3, 2, "SKU003", "1234567890125", "FFWD Wheels F4R", "Wheels", "Wheels", 800.0, 1200.0),
        (4, 2, "SKU004", "1234567890126", "FFWD Handlebar", "Bar", "Components", 200.0, 350.0),
        (5, 3, "SKU005", "1234567890127", "BIS Premium Saddle", "Saddle", "Components", None, 180.0),
    ], "id long, supplier_id long, sku string, ean_upc string, name string, description string, "
       "category string, purchase_price double, selling_price double")
    fairs = spark.createDataFrame([
        (1, "Bike Expo 2025", D(2025, 3, 15), D(2025, 3, 17), "Milan", None),
        (2, "Summer Sports Fair", D(2025, 6, 20), D(2025, 6, 22), "Rome", None),
        (3, "Mountain Bike Festival", D(2025, 9, 5), D(2025, 9, 7), "Alps", None),
    ], "id long, name string, start_date date, end_date date, location string, description string")
    assignments = spark.createDataFrame([
        (11, 1, 1, 5, None), (12, 1, 2, 4, 100.0), (13, 1, 4, 2, None), (14, 1, 5, 3, None),
        (21, 2, 3, 1, None),
    ], "id long, event_id long, product_id long, quantity_assigned long, event_sale_price double")
    sales = spark.createDataFrame([
        (1, 1, 2, 150.0, D(2025, 3, 15)), (1, 1, 1, 140.0, D(2025, 3, 16)),
        (1, 2, 4, 100.0, D(2025, 3, 16)), (1, 5, 1, 180.0, D(2025, 3, 17)),
        (1, 3, 1, 1200.0, D(2025, 3, 17)),  # not assigned to fair 1: left out
    ], "event_id long, product_id long, quantity long, sale_price double, sale_date date")
    return suppliers, products, fairs, assignments, sales


def test_performance_and_summary(spark):
    suppliers, products, fairs, assignments, sales = _f1(spark)
    perf = reports.event_performance(assignments, products, suppliers, sales)
    p = {(r.event_id, r.id): r for r in perf.collect()}
    assert p[(1, 1)].quantity_sold == 3 and p[(1, 1)].total_revenue == 440.0
    assert p[(1, 1)].remaining == 2 and p[(1, 1)].profit == 440.0 - 3 * 80.0
    assert p[(1, 4)].quantity_sold == 0 and p[(1, 4)].profit == 0.0
    assert p[(1, 5)].profit is None                  # unknown purchase price
    assert p[(1, 2)].sale_price == 100.0             # fair price override
    s = {r.event_id: r for r in reports.event_summary(perf, fairs).collect()}
    assert s[1].total_products == 4 and s[1].total_sold == 8 and s[1].total_assigned == 14
    assert s[1].sell_through_pct == round(8 / 14 * 100, 2)
    assert s[2].total_sold == 0 and s[2].average_price == 0.0 and s[2].profit_margin_pct == 0.0


def test_breakdown_total_is_sum_of_rows(spark):
    suppliers, products, fairs, assignments, sales = _f1(spark)
    perf = reports.event_performance(assignments, products, suppliers, sales)
    for key, fn in (("category", reports.category_breakdown), ("supplier", reports.supplier_breakdown)):
        rows = fn(perf).where(F.col("event_id") == 1).collect()
        total = [r for r in rows if r.is_total][0]
        parts = [r for r in rows if not r.is_total]
        assert total[key] == "TOTAL"
        assert total.products == sum(r.products for r in parts)
        assert total.sold == sum(r.sold for r in parts)
        assert round(total.revenue, 2) == round(sum(r.revenue for r in parts), 2)


def test_top_products_only_fairs_with_sales(spark):
    suppliers, products, fairs, assignments, sales = _f1(spark)
    perf = reports.event_performance(assignments, products, suppliers, sales)
    top = reports.top_products(perf, "quantity_sold", 2).collect()
    assert {r.event_id for r in top} == {1}
    assert [r.sku for r in sorted(top, key=lambda r: r.rank)] == ["SKU002", "SKU001"]


def test_programme_pivot_and_lists(spark):
    suppliers, products, fairs, assignments, sales = _f1(spark)
    piv = reports.programme_pivot(products, assignments, fairs, suppliers, sales, 2025)
    assert "1_Bike Expo 2025" in piv.columns and "TOTALI" in piv.columns
    rows = {r.id: r for r in piv.collect()}
    assert rows[1]["1_Bike Expo 2025"] == 3 and rows[1].TOTALI == 3
    assert rows[3].TOTALI == 1                       # sales count even where unassigned
    assert rows[4].TOTALI == 0                       # assigned, never sold
    months = [r.periodo for r in reports.event_list(fairs, 2025).collect()]
    assert months == ["March", "June", "September"]
    assert reports.prize_template(fairs, 2025).count() == 3
    yp = catalog.year_products(products, assignments, fairs, suppliers, 2025)
    oc = reports.offer_counts(yp, "Helmets", "Eyewear").collect()[0]
    assert (oc.caschi, oc.occhiali) == (1, 1)


def test_report_name(spark):
    fairs = spark.createDataFrame([(7, "Bike Expo 2025/Milano")], "id long, name string")
    assert reports.report_name(fairs).collect()[0].report_name == "Bike_Expo_2025_Milano_7.xlsx"


def test_programme_without_sales_has_every_fair(spark):
    suppliers, products, fairs, assignments, sales = _f1(spark)
    no_sales = sales.where("false")
    piv = reports.programme_pivot(products, assignments, fairs, suppliers, no_sales, 2025)
    cols = [c for c in piv.columns if c[0].isdigit()]
    assert cols == ["1_Bike Expo 2025", "2_Summer Sports Fair", "3_Mountain Bike Festival"]
    assert all(r.TOTALI == 0 for r in piv.collect())


def test_pivot_of_fairs_with_odd_names(spark):
    products = spark.createDataFrame([(1, 1, "s", "n", "d", "c", 1.0, 2.0)],
                                     "id long, supplier_id long, sku string, name string, description string, "
                                     "category string, purchase_price double, selling_price double")
    suppliers = spark.createDataFrame([(1, "S")], "id long, name string")
    import datetime as dt

    fairs = spark.createDataFrame([(1, "B.I.S. Expo", dt.date(2025, 1, 1), None, None, None),
                                   (2, "a`b", dt.date(2025, 2, 1), None, None, None)],
                                  "id long, name string, start_date date, end_date date, location string, "
                                  "description string")
    assignments = spark.createDataFrame([(1, 1, 1, 5, None), (2, 2, 1, 5, None)],
                                        "id long, event_id long, product_id long, quantity_assigned long, "
                                        "event_sale_price double")
    sales = spark.createDataFrame([(1, 1, 2, 1.0), (2, 1, 3, 1.0)],
                                  "event_id long, product_id long, quantity long, sale_price double")
    row = reports.programme_pivot(products, assignments, fairs, suppliers, sales, 2025).collect()[0]
    assert (row["1_B.I.S. Expo"], row["2_a`b"], row["TOTALI"]) == (2, 3, 5)
    cells = reports.programme_cells(products, assignments, fairs, suppliers, sales, 2025).collect()
    assert sorted((c.event_id, c.quantity_sold, c.totali) for c in cells) == [(1, 2, 5), (2, 3, 5)]


def test_delete_event_keeps_rows_without_id(spark):
    from stockfair.operators import fairs

    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id long, nome string")
    assert sorted(r.nome for r in fairs.delete_event(df, 1).collect()) == ["b", "c"]


def test_summary_ratio_is_not_decided_by_the_last_digits_of_a_sum(spark):
    """0.01, 0.03 and 0.29 add up to less than 0.33 in doubles; half of 0.33 is 0.165, which rounds up."""
    perf = spark.createDataFrame([(1, 1, 1, 0.01, 0.01), (1, 1, 1, 0.03, 0.03), (1, 1, 0, 0.29, 0.29)],
                                 "event_id long, quantity_assigned long, quantity_sold long, total_revenue double, "
                                 "profit double").coalesce(1)
    row = reports.event_summary(perf).first()
    assert (row.total_revenue, row.average_price, row.profit_margin_pct) == (0.33, 0.17, 100.0)
