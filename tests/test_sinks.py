import os

import pytest

from stockfair.plans import fair_reports
from stockfair.sources import sinks
from stockfair.sources.driver import DriverTables

SF = "/root/testdata/sf0.001"


def test_report_sections_written(spark, scratch):
    t = DriverTables(spark, SF)
    sections = fair_reports.event_report(t.event_products(), t.products(), t.suppliers(),
                                         t.event_sales(), t.fairs(), event_id=199707)
    out = sinks.write_report(sections, os.path.join(scratch, "report"))
    assert set(out) == {"products_sales", "summary", "category_breakdown", "supplier_breakdown",
                        "top_products", "top_products_revenue"}
    summary = spark.read.parquet(out["summary"]).collect()
    assert len(summary) == 1 and summary[0].event_id == 199707
    prog = fair_reports.annual_programme(t.products(), t.event_products(), t.fairs(),
                                         t.suppliers(), t.event_sales(), 1997)
    assert prog["events"].count() == 25
    with pytest.raises(ValueError):
        fair_reports.annual_programme(t.products(), t.event_products(), t.fairs(), t.suppliers(),
                                      t.event_sales(), 1900)


def test_append_conforms(spark, scratch):
    df = spark.createDataFrame([(1, 5, "x")], "product_id long, quantity long, extra string")
    path = os.path.join(scratch, "inventory")
    df = df.withColumn("id", df.product_id)
    sinks.append_table(df, path, "inventory")
    got = spark.read.parquet(path)
    assert got.columns == ["id", "product_id", "quantity", "reserved", "location", "last_updated"]
    r = got.collect()[0]
    assert r.reserved == 0 and r.last_updated is not None
