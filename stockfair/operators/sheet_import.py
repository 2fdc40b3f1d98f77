"""Yearly event sheet import (header normalisation, alias mapping, typed
columns with a reject list, date cells), sheet profiles and the constraint
report of the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockfair import schemas

# Header aliases of the event sheet (normalised header -> column).
# Every canonical column maps to itself as well.
EVENT_HEADER_ALIASES = {
    "n_eventi": "num_eventi",
    "n°_eventi": "num_eventi",
    "nnum_eventi": "num_eventi",
    "accordi": "accordo",
    "expo": "expo_periodo",
    "expo.1": "expo_brand",
    "expo1": "expo_brand",
    "località": "localita",
    "vitto_and_alloggio": "vitto_alloggio",
    "spazio/varie": "spazio_varie",
    "vendita_privati_/_agenti": "vendita_privati_agenti",
}


def normalise_header_a(name: str) -> str:
    """I12: lower case, space -> '_', '.' dropped, '/' -> '_'."""
    return name.lower().replace(" ", "_").replace(".", "").replace("/", "_")


def normalise_header_b(name: str) -> str:
    """I16: trimmed, lower case, space -> '_', '°' -> 'num', '&' -> 'and'."""
    return str(name).strip().lower().replace(" ", "_").replace("°", "num").replace("&", "and")


def canonical_column(header: str) -> str | None:
    """I13: the table column a raw header feeds (None: not imported).  Both
    normalisations are tried, the second form first."""
    known = set(schemas.ANNUAL_EVENT_COLUMNS)
    for form in (normalise_header_b(header), normalise_header_a(header)):
        if form in known:
            return form
        if form in EVENT_HEADER_ALIASES:
            return EVENT_HEADER_ALIASES[form]
    return None


def header_mapping(columns: list[str]) -> dict[str, str]:
    """Raw column -> table column; the first raw column wins for a target."""
    out: dict[str, str] = {}
    taken = set()
    for c in columns:
        target = canonical_column(c)
        if target and target not in taken:
            out[c] = target
            taken.add(target)
    return out


def normalise_event_date(c) -> F.Column:
    """I17: a full date, or date and time, becomes 'yyyy-MM-dd'; other text (a
    year, a month, a time of day) is kept; empty is NULL."""
    txt = F.when(F.trim(c) == "", F.lit(None)).otherwise(c)
    full = F.trim(c).rlike(r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$")
    stamp = F.when(full, F.trim(c)).try_cast("timestamp_ntz")
    return F.coalesce(F.date_format(stamp, "yyyy-MM-dd"), txt)


def typed_event_rows(sheet: DataFrame, id_col: str | None = None) -> DataFrame:
    """I12-I15, I17.  Map the sheet's raw columns onto the 32 table columns
    (missing ones NULL), type them, and flag cells that do not fit their
    column type (``bad_columns``, empty when the row is good)."""
    mapping = header_mapping([c for c in sheet.columns if c != id_col])
    by_target = {t: r for r, t in mapping.items()}
    typed, bad = [], []
    for f in schemas.ANNUAL_EVENTS.fields:
        if f.name == "id":
            continue
        raw = by_target.get(f.name)
        cell = F.col(f"`{raw}`") if raw is not None else F.lit(None).cast("string")
        cell = F.when(F.trim(cell) == "", F.lit(None)).otherwise(cell)
        if f.name == "data":
            val = normalise_event_date(cell)
        elif isinstance(f.dataType, T.StringType):
            val = cell
        else:
            val = F.trim(cell).try_cast(f.dataType)
            bad.append(F.when(cell.isNotNull() & val.isNull(), F.lit(f.name)))
        typed.append(val.alias(f.name))
    ident = [F.col(id_col).cast("long").alias("id")] if id_col else [F.lit(None).cast("long").alias("id")]
    bad_cols = F.filter(F.array(*bad), lambda x: x.isNotNull()) if bad else F.array()
    return sheet.select(*ident, *typed, bad_cols.alias("bad_columns"))


def ingest_annual_events(sheet: DataFrame, id_col: str | None = None) -> DataFrame:
    """Good rows of the sheet, shaped as the ``annual_events`` table."""
    t = typed_event_rows(sheet, id_col)
    return schemas.conform(t.where(F.size("bad_columns") == 0), "annual_events")


def ingest_rejects(sheet: DataFrame, id_col: str | None = None) -> DataFrame:
    """I15.  Rows left out, with the reason (columns whose value does not fit)."""
    t = typed_event_rows(sheet, id_col)
    return t.where(F.size("bad_columns") > 0).select(
        "id", F.concat(F.lit("bad value in: "), F.array_join("bad_columns", ", ")).alias("reason"))


def profile_table(df: DataFrame, group: str | None = None) -> DataFrame:
    """I18.  Rows, columns and total NULL cells (one aggregate pass), per
    ``group`` (e.g. a sheet/file column) when given."""
    cols = [c for c in df.columns if c != group]
    nulls = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in cols), F.lit(0))
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.lit(len(cols)).cast("long").alias("n_columns"),
            nulls.cast("long").alias("n_nulls")]
    return df.groupBy(group).agg(*aggs) if group else df.agg(*aggs)


def profile_columns(df: DataFrame) -> DataFrame:
    """I18.  Per column: type and NULL count (one aggregate, then unpivot)."""
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"c{i}")
                      for i, c in enumerate(df.columns)])
    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"c{i}").alias("nulls"))
        for i, (c, t) in enumerate(df.dtypes)]))
    return counts.select(rows.alias("x")).select("x.column", "x.type", "x.nulls")


# The types a text cell can have, and the patterns that decide.
INTEGER, FLOAT, DATE, TEXT, EMPTY = "integer", "float", "date", "text", "empty"
INTEGER_PATTERN = r"^[+-]?[0-9]+$"
FLOAT_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
DATE_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?)?$"


def cell_type(cell: Column) -> Column:
    """The least type of a text cell: integer, float, date (a full date that
    exists, perhaps with a time) or text; NULL for an empty or blank cell."""
    t = F.trim(cell)
    return (F.when(t.isNull() | (t == ""), F.lit(None).cast("string")).when(t.rlike(INTEGER_PATTERN), INTEGER)
            .when(t.rlike(FLOAT_PATTERN), FLOAT)
            .when(t.rlike(DATE_PATTERN) & F.substring(t, 1, 10).try_cast("date").isNotNull(), DATE).otherwise(TEXT))


def _joined_type(n: dict[str, Column]) -> Column:
    """The least type that holds all cells, from their numbers by type: integers
    are floats, everything is text, nothing else contains another."""
    numbers = n[INTEGER] + n[FLOAT]
    return (F.when((n[TEXT] > 0) | ((n[DATE] > 0) & (numbers > 0)), TEXT).when(n[DATE] > 0, DATE)
            .when(n[FLOAT] > 0, FLOAT).when(n[INTEGER] > 0, INTEGER).otherwise(EMPTY))


def infer_column_types(df: DataFrame) -> DataFrame:
    """I18.  Per column of a table of text cells: (column, type, n_integer, n_float,
    n_date, n_text, nulls).  One aggregate over all columns; empty cells say nothing."""
    kinds = (INTEGER, FLOAT, DATE, TEXT)
    typed = df.select(*[cell_type(F.col(f"`{c}`").cast("string")).alias(f"t{i}") for i, c in enumerate(df.columns)])
    counts = typed.agg(F.count(F.lit(1)).alias("rows"), *[
        F.count_if(F.col(f"t{i}") == k).alias(f"{k}{i}") for i in range(len(df.columns)) for k in kinds])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{k}{i}").alias(k) for k in kinds])
                               for i, c in enumerate(df.columns)]))
    return _typed(counts.select("rows", rows.alias("x")).select("x.*", "rows"), ["column"])


def infer_sheet_types(cells: DataFrame) -> DataFrame:
    """I18 over many files in one pass: ``infer_column_types`` per file and column
    of (file, line_no, col, column, cell); ``nulls`` are the column's empty cells."""
    typed = cells.select("file", "col", "column", cell_type(F.col("cell")).alias("t"))
    counts = typed.groupBy("file", "col", "column").agg(F.count(F.lit(1)).alias("rows"), *[
        F.count_if(F.col("t") == k).alias(k) for k in (INTEGER, FLOAT, DATE, TEXT)])
    return _typed(counts, ["file", "col", "column"])


def _typed(counts: DataFrame, keys: list[str]) -> DataFrame:
    kinds = (INTEGER, FLOAT, DATE, TEXT)
    return counts.select(*keys, _joined_type({k: F.col(k) for k in kinds}).alias("type"),
                         *[F.col(k).alias(f"n_{k}") for k in kinds],
                         (F.col("rows") - sum((F.col(k) for k in kinds), F.lit(0))).alias("nulls"))


def sample_rows(df: DataFrame, group: str, order: str, n: int = 3) -> DataFrame:
    """I18.  First ``n`` rows of every group (per-partition group limit)."""
    from pyspark.sql import Window
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def constraint_report(suppliers: DataFrame, products: DataFrame, inventory: DataFrame,
                      transactions: DataFrame, stock_log: DataFrame | None = None) -> DataFrame:
    """K5.  Violations of the declared constraints: NOT NULL columns,
    UNIQUE(products.ean_upc) (NULLs allowed), and the foreign keys products ->
    suppliers, inventory -> products, transactions -> products.  One aggregate
    per table for the NOT NULL columns."""
    def not_null(df, table, *cols):
        counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
        return counts.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).alias("violations")) for c in cols]))
            .alias("x")).select(F.lit("not_null").alias("check"), F.lit(table).alias("table"),
                                "x.column", "x.violations")

    def fk(child, table, col, parent):
        keys = parent.select(F.col("id").alias("_k"))
        missing = child.where(F.col(col).isNotNull()).join(keys, F.col(col) == keys._k, "left_anti")
        return missing.agg(F.count(F.lit(1)).alias("violations")).select(
            F.lit("foreign_key").alias("check"), F.lit(table).alias("table"),
            F.lit(col).alias("column"), "violations")

    dup = (products.where(F.col("ean_upc").isNotNull()).groupBy("ean_upc").count()
           .where(F.col("count") > 1)
           .agg(F.count(F.lit(1)).alias("violations"))
           .select(F.lit("unique").alias("check"), F.lit("products").alias("table"),
                   F.lit("ean_upc").alias("column"), "violations"))
    parts = [
        not_null(suppliers, "suppliers", "name"),
        not_null(products, "products", "name"),
        not_null(inventory, "inventory", "product_id"),
        not_null(transactions, "inventory_transactions", "product_id", "transaction_type",
                 "quantity"),
        dup,
        fk(products, "products", "supplier_id", suppliers),
        fk(inventory, "inventory", "product_id", products),
        fk(transactions, "inventory_transactions", "product_id", products),
    ]
    if stock_log is not None:
        parts.append(not_null(stock_log, "stock_log", "event_type"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
