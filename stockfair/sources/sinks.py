"""Sinks: append rows to a stored table (K1) and write a multi-section report
(K2), one dataset per section."""

from __future__ import annotations

from pyspark.sql import DataFrame

from stockfair import schemas


def append_table(df: DataFrame, path: str, table: str, fmt: str = "parquet") -> None:
    """K1.  Conform ``df`` to the schema of ``table`` (missing columns NULL or
    their DDL default, extra columns dropped) and append it to ``path``."""
    schemas.conform(df, table).write.mode("append").format(fmt).save(path)


def write_report(sections: dict[str, DataFrame], path: str, fmt: str = "parquet") -> dict[str, str]:
    """K2.  Write every section of a report to ``<path>/<section>``; returns the
    section -> location map.  Each section is written by the executors."""
    out = {}
    for name, df in sections.items():
        loc = f"{path.rstrip('/')}/{name}"
        df.write.mode("overwrite").format(fmt).save(loc)
        out[name] = loc
    return out
