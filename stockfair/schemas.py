"""Table schemas (StructTypes) and column defaults.

The stored tables of the stock and fair application, with the canonical names
the event calendar, ``annual_events`` for the yearly event sheet).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

L, S, D = T.LongType(), T.StringType(), T.DoubleType()
TS, DT = T.TimestampNTZType(), T.DateType()


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


SUPPLIERS = _schema(
    ("id", L, False), ("name", S, False), ("contact_person", S, True), ("email", S, True),
    ("phone", S, True), ("address", S, True), ("created_at", TS, True), ("updated_at", TS, True),
)

PRODUCTS = _schema(
    ("id", L, False), ("supplier_id", L, True), ("sku", S, True), ("ean_upc", S, True),
    ("name", S, False), ("description", S, True), ("category", S, True), ("subcategory", S, True),
    ("purchase_price", D, True), ("selling_price", D, True), ("status", S, True),
    ("created_at", TS, True), ("updated_at", TS, True),
)

# ``reserved`` is the stock held for fairs; available = quantity - reserved.
INVENTORY = _schema(
    ("id", L, False), ("product_id", L, False), ("quantity", L, True), ("reserved", L, True),
    ("location", S, True), ("last_updated", TS, True),
)

INVENTORY_TRANSACTIONS = _schema(
    ("id", L, False), ("product_id", L, False), ("transaction_type", S, False),
    ("quantity", L, False), ("reference", S, True), ("notes", S, True),
    ("transaction_date", TS, True), ("user", S, True),
)

STOCK_LOG = _schema(
    ("id", L, False), ("event_type", S, False), ("description", S, True),
    ("related_id", L, True), ("event_date", TS, True), ("user", S, True),
)

# The 32 columns of the yearly event sheet, in table order.
ANNUAL_EVENT_TEXT = ["periodo", "accordo", "data", "expo_periodo", "nome", "mezzo_trasporto",
                     "disciplina", "localita", "regione", "expo_brand", "addetto", "ffwd"]
ANNUAL_EVENT_COLUMNS = [
    "periodo", "accordo", "num_eventi", "data", "expo_periodo", "nome", "mezzo_trasporto",
    "disciplina", "localita", "regione", "expo_brand", "addetto", "pernotto", "vitto_alloggio",
    "treno", "spazio_varie", "incassi_2024", "caschi", "occhiali", "pneumatici", "bdg_incassi",
    "bdg_costi", "km", "gasolio", "autostrada", "costi_reali", "incassi", "pos", "cash", "extra",
    "vendita_privati_agenti", "ffwd",
]


def _annual_type(c: str) -> T.DataType:
    if c == "num_eventi":
        return L
    return S if c in ANNUAL_EVENT_TEXT else D


ANNUAL_EVENTS = T.StructType(
    [T.StructField("id", L, False)]
    + [T.StructField(c, _annual_type(c), True) for c in ANNUAL_EVENT_COLUMNS]
)

FAIRS = _schema(
    ("id", L, False), ("name", S, True), ("start_date", DT, True), ("end_date", DT, True),
    ("location", S, True), ("description", S, True),
)

EVENT_PRODUCTS = _schema(
    ("id", L, False), ("event_id", L, False), ("product_id", L, False),
    ("quantity_assigned", L, True), ("event_sale_price", D, True),
    ("created_at", TS, True), ("updated_at", TS, True),
)

EVENT_SALES = _schema(
    ("event_id", L, False), ("product_id", L, False), ("quantity", L, True),
    ("sale_price", D, True), ("sale_date", DT, True),
)

# Request / input shapes of the batch jobs.
MOVEMENTS = _schema(
    ("seq", L, False), ("product_id", L, True), ("transaction_type", S, True),
    ("quantity", L, True), ("reference", S, True), ("notes", S, True), ("user", S, True),
)

SCANS = _schema(("scanner_id", S, True), ("ts", TS, True), ("barcode", S, True))

TABLES = {
    "suppliers": SUPPLIERS, "products": PRODUCTS, "inventory": INVENTORY,
    "inventory_transactions": INVENTORY_TRANSACTIONS, "stock_log": STOCK_LOG,
    "annual_events": ANNUAL_EVENTS, "fairs": FAIRS, "event_products": EVENT_PRODUCTS,
    "event_sales": EVENT_SALES,
}

# Column defaults of the DDL (DEFAULT 0 / DEFAULT CURRENT_TIMESTAMP), as SQL
# expressions (Column objects need an active session, so they are built late).
DEFAULTS: dict[str, dict[str, str]] = {
    "suppliers": {"created_at": "localtimestamp()", "updated_at": "localtimestamp()"},
    "products": {"created_at": "localtimestamp()", "updated_at": "localtimestamp()"},
    "inventory": {"quantity": "0", "reserved": "0", "last_updated": "localtimestamp()"},
    "inventory_transactions": {"transaction_date": "localtimestamp()"},
    "stock_log": {"event_date": "localtimestamp()"},
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project ``df`` onto the schema of ``table``: missing columns become
    NULL (or the DDL default), present ones are cast, extra ones dropped."""
    schema = TABLES[table]
    defaults = DEFAULTS.get(table, {})
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            c = F.col(f.name).cast(f.dataType)
            if f.name in defaults:
                c = F.coalesce(c, F.expr(defaults[f.name]).cast(f.dataType))
        elif f.name in defaults:
            c = F.expr(defaults[f.name]).cast(f.dataType)
        else:
            c = F.lit(None).cast(f.dataType)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def empty(spark, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])
