"""Yearly event statistics over the ``annual_events`` sheet table.

The year of an event is the first four characters of its ``data`` text (dates
written in another format fall out of every year, as in the original store).
Money sums are rounded to cents on output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def year_of(c: str = "data") -> Column:
    return F.substring(F.col(c), 1, 4)


def _in_year(df: DataFrame, year) -> DataFrame:
    return df.where(year_of() == F.lit(str(year)))


def _money_sum(c: str) -> Column:
    return F.round(F.sum(c), 2)


def event_totals(annual_events: DataFrame) -> DataFrame:
    """A1.  All-time income and cost (NULL when the table is empty)."""
    return annual_events.agg(_money_sum("incassi").alias("total_incassi"),
                             _money_sum("costi_reali").alias("total_costi"))


def events_per_region(annual_events: DataFrame, year=None) -> DataFrame:
    """A1 / A4.  Number of events per region (NULL region is its own group),
    optionally for one year."""
    a = annual_events if year is None else _in_year(annual_events, year)
    return a.groupBy("regione").agg(F.count(F.lit(1)).alias("n_events"))


def income_by_year(annual_events: DataFrame, year) -> DataFrame:
    """A2.  Total income of a year; 0.0 when there is none."""
    return _in_year(annual_events, year).agg(
        F.coalesce(_money_sum("incassi"), F.lit(0.0)).alias("total_incassi"))


def cost_by_year(annual_events: DataFrame, year) -> DataFrame:
    """A3.  Total real cost of a year; 0.0 when there is none."""
    return _in_year(annual_events, year).agg(
        F.coalesce(_money_sum("costi_reali"), F.lit(0.0)).alias("total_costi"))


def top_events(annual_events: DataFrame, year, top_n: int = 5) -> DataFrame:
    """A5.  The ``top_n`` events of a year by income (NULL income last, ties by
    id).  Planned as TakeOrderedAndProject: a per-partition top-n, then merge."""
    return (_in_year(annual_events, year)
            .orderBy(F.col("incassi").desc_nulls_last(), F.col("id"))
            .limit(top_n).select("id", "nome", "incassi"))


def top_events_per_year(annual_events: DataFrame, top_n: int = 5) -> DataFrame:
    """A5 for every year at once.  ``row_number() <= n`` lets Spark insert a
    per-partition group limit before the shuffle, so a year with most of the
    rows still ships only n rows per map task."""
    w = Window.partitionBy("year").orderBy(F.col("incassi").desc_nulls_last(), F.col("id"))
    return (annual_events.withColumn("year", year_of())
            .withColumn("rank", F.row_number().over(w).cast("long"))
            .where(F.col("rank") <= top_n)
            .select("year", "rank", "id", "nome", "incassi"))


def product_line_sales(annual_events: DataFrame, year) -> DataFrame:
    """A6.  Helmets / eyewear / tyres sold in a year (0 when none)."""
    a = _in_year(annual_events, year)
    return a.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c)
                   for c in ("caschi", "occhiali", "pneumatici")])


def annual_summary(annual_events: DataFrame, year=None) -> DataFrame:
    """A7.  Scalar part of the yearly summary in one aggregate job: income,
    cost, net profit and the three product lines, one row per year (or for the
    given year, with zeros when it has no events).  The region counts and the
    top events are ``events_per_region`` and ``top_events(_per_year)``."""
    aggs = [
        F.coalesce(F.sum("incassi"), F.lit(0.0)).alias("_inc"),
        F.coalesce(F.sum("costi_reali"), F.lit(0.0)).alias("_cost"),
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("caschi", "occhiali", "pneumatici")],
        F.count(F.lit(1)).alias("n_events"),
    ]
    if year is None:
        g = annual_events.groupBy(year_of().alias("year")).agg(*aggs)
    else:
        g = _in_year(annual_events, year).agg(*aggs).withColumn("year", F.lit(str(year)))
    return g.select(
        "year",
        F.round("_inc", 2).alias("total_incassi"),
        F.round("_cost", 2).alias("total_costi"),
        F.round(F.col("_inc") - F.col("_cost"), 2).alias("net_profit"),
        "caschi", "occhiali", "pneumatici", "n_events",
    )
