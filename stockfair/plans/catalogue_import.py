"""Price-list import end to end: sheet lines -> header, columns, supplier ->
clean rows -> suppliers get-or-create -> product upsert -> zero-stock rows for
new products -> per-file counters.  Every step is one of the operators in
``stockfair.operators.ingest``; this module only wires them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockfair.operators import ingest
from stockfair.session import cut_lineage


@dataclass
class CatalogueImport:
    header: DataFrame
    mapping: DataFrame
    suppliers_guessed: DataFrame
    rows: DataFrame
    suppliers: DataFrame
    file_suppliers: DataFrame

    def products(self, products: DataFrame) -> DataFrame:
        return ingest.upsert_products(with_status(products), self.rows, self.file_suppliers)

    def stats(self, products: DataFrame) -> DataFrame:
        return ingest.import_stats(with_status(products), self.rows)


def with_status(products: DataFrame) -> DataFrame:
    return products if "status" in products.columns else products.withColumn(
        "status", F.lit(None).cast("string"))


def plan_import(lines: DataFrame, suppliers: DataFrame) -> CatalogueImport:
    lines = cut_lineage(lines)
    facts = ingest.file_facts(lines)
    header, guessed = facts.select("file", "header_row", "header_line"), facts.select("file", "supplier")
    # the cleaned rows feed the upsert, the counters and the inventory rows:
    # materialise them once in the shared checkpoint folder
    rows = cut_lineage(ingest.clean_rows(lines, facts))
    all_suppliers = ingest.get_or_create_suppliers(suppliers, guessed)
    # several suppliers of one name: the smallest id is the file's
    by_name = all_suppliers.groupBy(F.col("name").alias("supplier")).agg(F.min("id").alias("supplier_id"))
    file_suppliers = guessed.join(by_name, "supplier", "inner").select("file", "supplier_id")
    return CatalogueImport(header, ingest.mapping_of(facts), guessed, rows, all_suppliers, file_suppliers)
