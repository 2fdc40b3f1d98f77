"""Price-list import: find the header row, map columns to product fields,
guess the supplier, clean the rows and upsert them into the catalogue.

All steps work on many files at once.  ``file_facts`` decides per file from its
first lines (header row, supplier) and one aggregate over all lines (columns that hold
anything); the facts are one row per file.  The steps over all rows look the facts up
in the row: the facts are broadcast while there are at most ``FACTS_AS_MAP`` of them
(counted first) and joined by file beyond, and no cell is ever shuffled by file, so a
price list of any length uses all tasks.  The functions on (file, line_no, col, cell)
rows of ``sources.sheets.sheet_cells`` do the same step by step.

Upsert semantics (rows run in file order, then line order):

* a row updates the product that has its barcode when the row's turn comes,
  else the one that has its sku then (smallest id when several do), else it
  creates a product.  A code that an earlier row has changed no longer
  matches, one that an earlier row has written does (``operators.ownership``);
* only mapped columns are written; an empty cell in a mapped column writes
  NULL; the last row for a product wins per column; the supplier of the file
  is written when known;
* counts: ``added`` = rows that create a product, ``updated`` = all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockfair.session import cut_lineage
from stockfair.sources import sheets

# Header keywords and window, field patterns (in priority
# order), supplier patterns (in order) and the content window.
HEADER_KEYWORDS = ["sku", "ean", "upc", "code", "article", "name", "description", "price",
                   "retail", "dealer", "product"]
HEADER_WINDOW = 20
HEADER_MIN_HITS = 3
FIELD_PATTERNS = [
    ("ean_upc", ["ean", "upc", "barcode", "ean code", "upc code"]),
    ("sku", ["sku", "article", "article #", "item", "item code", "product code"]),
    ("name", ["name", "model name", "product name", "model"]),
    ("description", ["description", "product description", "desc"]),
    ("purchase_price", ["dealer price", "purchase", "cost", "whs", "whs price", "wholesale"]),
    ("selling_price", ["retail", "price", "rrp", "suggested retail", "selling price"]),
    ("status", ["status"]),
    ("category", ["category", "line", "product line", "type"]),
    ("supplier", ["supplier", "vendor", "brand"]),
]
SUPPLIER_PATTERNS = [("bolle", "Bollé"), ("ffwd", "FFWD"), ("bis", "B.I.S. Srl"),
                     ("premium", "Premium")]
SUPPLIER_WINDOW = 10

#: Files up to which their facts are broadcast to the rows.
FACTS_AS_MAP = 20_000

FIELDS = [f for f, _ in FIELD_PATTERNS]
PRICE_FIELDS = ("purchase_price", "selling_price")
PRODUCT_FIELDS = ["ean_upc", "sku", "name", "description", "purchase_price", "selling_price",
                  "status", "category"]


def _kw_regex() -> str:
    return "|".join(HEADER_KEYWORDS)


def _nan_text(c: Column) -> Column:
    """A cell as pandas ``astype(str)`` shows it: empty -> 'nan'."""
    return F.lower(F.coalesce(c, F.lit("nan")))


def ranked_lines(cells: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` lines of each file with their 0-based row index
    (every line has a cell 0).  ``row_number() <= n`` is planned with a
    per-partition group limit."""
    w = Window.partitionBy("file").orderBy("line_no")
    lines = cells.where(F.col("col") == 0).select("file", "line_no")
    # filter on row_number() itself so Spark plans a per-partition group limit
    ranked = lines.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit)
    return ranked.withColumn("row", F.col("_rn") - 1).drop("_rn")


def detect_header_row(cells: DataFrame) -> DataFrame:
    """I1.  (file, header_row, header_line): the first of the first 20 rows
    where at least 3 cells contain a header keyword; row 0 otherwise.
    ``cells`` is ``sources.sheets.sheet_cells(lines)``."""
    first = ranked_lines(cells, HEADER_WINDOW)
    cells = cells.join(first, ["file", "line_no"], "inner")
    hits = cells.groupBy("file", "line_no", "row").agg(
        F.count_if(_nan_text(F.col("cell")).rlike(_kw_regex())).alias("hits"))
    found = hits.where(F.col("hits") >= HEADER_MIN_HITS).groupBy("file").agg(
        F.min(F.struct("row", "line_no")).alias("h"))
    default = first.where(F.col("row") == 0).select("file", F.col("line_no").alias("_l0"))
    j = default.join(found, "file", "left")
    return j.select("file",
                    F.coalesce(F.col("h.row"), F.lit(0)).cast("long").alias("header_row"),
                    F.coalesce(F.col("h.line_no"), F.col("_l0")).alias("header_line"))


def _split(cells: DataFrame, header: DataFrame):
    cells = cells.join(header.select("file", "header_line"), "file", "inner")
    head = cells.where(F.col("line_no") == F.col("header_line"))
    data = cells.where(F.col("line_no") > F.col("header_line"))
    return head, data


def data_columns(cells: DataFrame, header: DataFrame) -> DataFrame:
    """S7 + pandas header names: (file, col, column) for the columns that hold
    at least one value below the header.  An empty header cell is named
    'Unnamed: <col>'; repeated names get '.1', '.2' ... in column order."""
    head, data = _split(cells, header)
    return _named(head, data.where(F.col("cell").isNotNull()).select("file", "col").distinct())


def _named(head: DataFrame, filled: DataFrame) -> DataFrame:
    label = F.coalesce(F.col("cell"), F.concat(F.lit("Unnamed: "), F.col("col").cast("string")))
    h = head.select("file", "col", label.alias("label"))
    w = Window.partitionBy("file", "label").orderBy("col")
    h = h.withColumn("_dup", F.row_number().over(w) - 1)
    h = h.select("file", "col", F.when(F.col("_dup") == 0, F.col("label"))
                 .otherwise(F.concat_ws(".", "label", F.col("_dup").cast("string")))
                 .alias("column"))
    return h.join(filled, ["file", "col"], "left_semi")


def drop_empty(cells: DataFrame, header: DataFrame) -> DataFrame:
    """S7.  Data cells of the rows and columns that are not entirely empty:
    (file, line_no, col, column, cell)."""
    cols = data_columns(cells, header)
    _, data = _split(cells, header)
    rows = data.where(F.col("cell").isNotNull()).select("file", "line_no").distinct()
    return (data.join(rows, ["file", "line_no"], "left_semi")
            .join(cols, ["file", "col"], "inner")
            .select("file", "line_no", "col", "column", "cell"))


def detect_columns(cells: DataFrame, header: DataFrame) -> DataFrame:
    """I2.  (file, field, column, col): for each field, the first pattern (in
    order) found as a substring of a lower-cased column name, first such
    column in sheet order.  One column may feed several fields."""
    return _mapped(data_columns(cells, header))


def _mapped(cols: DataFrame) -> DataFrame:
    low = F.lower(F.col("column"))
    ranks = []
    for field, patterns in FIELD_PATTERNS:
        rank = None
        for i, p in enumerate(patterns):
            rank = (F.when(low.contains(p), F.lit(i)) if rank is None
                    else rank.when(low.contains(p), F.lit(i)))
        ranks.append(rank.alias(f"_r_{field}"))
    scored = cols.select("file", "col", "column", *ranks)
    best = scored.groupBy("file").agg(*[
        F.min_by(F.struct("column", "col"),
                 F.when(F.col(f"_r_{f}").isNotNull(), F.struct(F.col(f"_r_{f}"), F.col("col"))))
        .alias(f) for f in FIELDS])
    stacked = best.select("file", F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).alias("m")) for f in FIELDS])).alias("x"))
    return stacked.where(F.col("x.m").isNotNull()).select(
        "file", F.col("x.field").alias("field"), F.col("x.m.column").alias("column"),
        F.col("x.m.col").alias("col"))


def guess_supplier(cells: DataFrame) -> DataFrame:
    """I6.  (file, supplier): a supplier pattern in the lower-cased file name;
    else the first cell (row-major, in the 10 rows under the first line)
    containing one; else the lower-cased file name without its extension."""
    low_file = F.lower(F.col("file"))

    def first_pattern(text: Column) -> Column:
        out = None
        for p, name in SUPPLIER_PATTERNS:
            out = (F.when(text.contains(p), F.lit(name)) if out is None
                   else out.when(text.contains(p), F.lit(name)))
        return out

    rows = ranked_lines(cells, SUPPLIER_WINDOW + 1).where(F.col("row") >= 1)
    files = cells.where((F.col("col") == 0)).select("file").distinct()
    cells = cells.join(rows, ["file", "line_no"], "inner")
    hit = cells.select("file", "row", "col",
                       first_pattern(_nan_text(F.col("cell"))).alias("supplier"))
    by_content = hit.where(F.col("supplier").isNotNull()).groupBy("file").agg(
        F.min_by("supplier", F.struct("row", "col")).alias("_content"))
    stem = F.regexp_replace(low_file, r"(?<=.)\.[^.]*$", "")
    return files.join(by_content, "file", "left").select(
        "file", F.coalesce(first_pattern(low_file), F.col("_content"), stem).alias("supplier"))


def _looked_up(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows with their file's facts: no shuffle of the rows up to the bound."""
    few = facts.limit(FACTS_AS_MAP + 1).count() <= FACTS_AS_MAP
    return rows.join(F.broadcast(facts) if few else facts, "file")


def file_facts(lines: DataFrame) -> DataFrame:
    """One row per file of (file, line_no, line): header_row, header_line, supplier,
    ``columns`` (col, column) that hold anything below the header, and ``mapping`` (field,
    column, col).  Only the first lines of a file are cut into cells and meet by file; of
    the others each task reports which columns it saw filled."""
    turn = Window.partitionBy("file").orderBy("line_no")
    top = lines.withColumn("_rn", F.row_number().over(turn)).where(F.col("_rn") <= HEADER_WINDOW).drop("_rn")
    cells = cut_lineage(sheets.sheet_cells(top))
    header = cut_lineage(detect_header_row(cells))
    below = _looked_up(lines, header.select("file", "header_line")).where(F.col("line_no") > F.col("header_line"))
    filled = sheets.sheet_cells(below).where(F.col("cell").isNotNull()).select("file", "col").distinct()
    head = cells.join(header.select("file", F.col("header_line").alias("line_no")), ["file", "line_no"], "left_semi")
    cols = cut_lineage(_named(head, filled))

    def listed(df, *names):
        return df.groupBy("file").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("x"))

    columns = listed(cols, "col", "column").withColumnRenamed("x", "columns")
    mapping = listed(_mapped(cols), "field", "column", "col").withColumnRenamed("x", "mapping")
    facts = header.join(guess_supplier(cells), "file").join(columns, "file", "left").join(mapping, "file", "left")
    return cut_lineage(facts.select("file", "header_row", "header_line", "supplier", "columns", "mapping"))


def mapping_of(facts: DataFrame) -> DataFrame:
    """I2.  (file, field, column, col), as ``detect_columns``."""
    return facts.select("file", F.explode("mapping").alias("m")).select("file", "m.field", "m.column", "m.col")


def filled_cells(lines: DataFrame, facts: DataFrame) -> DataFrame:
    """S7.  As ``drop_empty``, in the row: (file, line_no, col, column, cell)."""
    data = _looked_up(lines, facts.select("file", "header_line", "columns")).where(F.col("line_no") > F.col("header_line"))
    cells = F.transform(sheets.csv_cells(F.col("line")), lambda c: F.nullif(c, F.lit("")))
    data = data.withColumn("_cells", cells).where(F.exists("_cells", lambda c: c.isNotNull()))
    return data.select("file", "line_no", "_cells", F.explode("columns").alias("c")).where(
        F.col("c.col") < F.size("_cells")).select(
        "file", "line_no", "c.col", "c.column", F.get("_cells", F.col("c.col").cast("int")).alias("cell"))


def clean_rows(lines: DataFrame, facts: DataFrame) -> DataFrame:
    """I3-I5.  As ``clean_products``, in the row: every data line's mapped fields,
    lines without a name dropped."""
    data = _looked_up(lines, facts.select("file", "header_line", "mapping").where("mapping IS NOT NULL")) \
        .where(F.col("line_no") > F.col("header_line"))
    at = F.map_from_entries(F.transform("mapping", lambda m: F.struct(m["field"], m["col"].cast("int"))))
    data = data.select("file", "line_no", sheets.csv_cells(F.col("line")).alias("_cells"), at.alias("_at"))
    fields = []
    for f in FIELDS:
        cell = F.nullif(F.get("_cells", F.element_at("_at", f)), F.lit(""))
        num = cell.try_cast("double")
        fields.append((F.when(~F.isnan(num), num) if f in PRICE_FIELDS else cell).alias(f))
    return data.select("file", "line_no", *fields, F.array_sort(F.map_keys("_at")).alias("mapped")) \
        .where(F.col("name").isNotNull())


def clean_products(cells: DataFrame, header: DataFrame, mapping: DataFrame) -> DataFrame:
    """I3-I5.  One row per data row with the mapped fields (unmapped ones
    NULL and absent from ``mapped``), rows without a name dropped (all rows
    when no column maps to the name), prices as numbers (bad -> NULL)."""
    _, data = _split(cells, header)
    m = mapping.select("file", "col", "field")
    cells = data.join(m, ["file", "col"], "inner")
    wide = cells.groupBy("file", "line_no").pivot("field", FIELDS).agg(F.first("cell"))
    mapped = mapping.groupBy("file").agg(F.array_sort(F.collect_set("field")).alias("mapped"))
    out = wide.join(mapped, "file", "inner").where(F.col("name").isNotNull())
    for f in PRICE_FIELDS:
        num = F.col(f).try_cast("double")
        out = out.withColumn(f, F.when(F.isnan(num), F.lit(None)).otherwise(num))
    return out.select("file", "line_no", *FIELDS, "mapped")


def get_or_create_suppliers(suppliers: DataFrame, names: DataFrame,
                            name_col: str = "supplier") -> DataFrame:
    """I7.  The suppliers table with every name of ``names`` present: new
    names (exact match) get ids after the current maximum, in name order."""
    from stockfair.operators.fairs import dense_ids

    new = (names.select(F.col(name_col).alias("name")).where(F.col("name").isNotNull())
           .distinct().join(suppliers.select("name"), "name", "left_anti"))
    start = suppliers.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    numbered = dense_ids(new, "name", "_n")
    added = numbered.select((F.lit(start) + F.col("_n")).alias("id"), "name")
    return suppliers.select("id", "name").unionByName(added)


def _pos(file_col: str = "file", line_col: str = "line_no") -> Column:
    return F.struct(F.col(file_col).alias("f"), F.col(line_col).alias("l"))


def match_products(products: DataFrame, rows: DataFrame) -> DataFrame:
    """I8.  Each cleaned row with ``pid``: the existing product with its
    barcode, else the one with its sku (smallest id).  Empty codes never
    match."""
    ean, sku = F.col("ean_upc"), F.col("sku")
    by_ean = (products.where(F.col("ean_upc").isNotNull()).groupBy("ean_upc")
              .agg(F.min("id").alias("_pid_e")))
    by_sku = products.where(F.col("sku").isNotNull()).groupBy("sku").agg(F.min("id").alias("_pid_s"))
    r = rows.withColumn("ean_upc", F.when(F.trim(ean) == "", None).otherwise(ean)) \
            .withColumn("sku", F.when(F.trim(sku) == "", None).otherwise(sku))
    r = r.join(by_ean, "ean_upc", "left").join(by_sku, "sku", "left")
    return r.withColumn("pid", F.coalesce("_pid_e", "_pid_s")).drop("_pid_e", "_pid_s")


def resolve_rows(products: DataFrame, rows: DataFrame) -> DataFrame:
    """Target of every row, in import order ``pos`` (1, 2, 3 ...): ``pid`` (existing
    product) or ``root`` (the ``pos`` of the row that creates the new product it
    belongs to)."""
    from stockfair.operators import ownership
    from stockfair.operators.fairs import dense_ids

    def code(c):
        return F.when(F.trim(c) == "", None).otherwise(F.col(c))

    r = rows.withColumns({"ean_upc": code("ean_upc"), "sku": code("sku"), "_order": _pos()})
    r = cut_lineage(dense_ids(r, "_order", "pos").drop("_order"))
    own, top = ownership.targets(products, r.select(
        F.col("pos").alias("n"), "ean_upc", "sku", F.array_contains("mapped", "ean_upc").alias("writes_ean"),
        F.array_contains("mapped", "sku").alias("writes_sku")))
    new = F.col("own") > F.lit(top)
    return r.join(own.withColumnRenamed("n", "pos"), "pos").withColumns({
        "pid": F.when(~new, F.col("own")), "root": F.when(new, F.col("own") - F.lit(top))}).drop("own")


def _last_mapped(f: str) -> Column:
    mapped = F.array_contains(F.col("mapped"), f)
    return F.max_by(F.when(mapped, F.struct(F.col(f).alias("v"))),
                    F.when(mapped, F.col("pos"))).alias(f"_{f}")


def upsert_products(products: DataFrame, rows: DataFrame,
                    file_suppliers: DataFrame | None = None) -> DataFrame:
    """I9.  The products table after the import of ``rows`` (cleaned rows).
    ``file_suppliers`` (file, supplier_id) gives each file's supplier."""
    from stockfair.operators.fairs import dense_ids

    r = resolve_rows(products, rows)
    if file_suppliers is not None:
        r = r.join(file_suppliers.select("file", "supplier_id"), "file", "left")
    else:
        r = r.withColumn("supplier_id", F.lit(None).cast("long"))
    aggs = [_last_mapped(f) for f in PRODUCT_FIELDS] + [
        F.max_by("supplier_id", F.when(F.col("supplier_id").isNotNull(), F.col("pos")))
        .alias("_supplier_id")]
    upd = r.where(F.col("pid").isNotNull()).groupBy("pid").agg(*aggs)
    ins = r.where(F.col("pid").isNull()).groupBy("root").agg(*aggs)
    base = [c for c in products.columns]

    def value(f: str, old: Column | None) -> Column:
        got = F.col(f"_{f}")
        new = got["v"]
        return (F.when(got.isNotNull(), new).otherwise(old) if old is not None else new).alias(f)

    p = products.alias("p")
    updated = p.join(upd, F.col("p.id") == upd.pid, "inner").select(*[
        value(c, F.col(f"p.{c}")) if c in PRODUCT_FIELDS
        else (F.coalesce(F.col("_supplier_id"), F.col("p.supplier_id")).alias(c)
              if c == "supplier_id" else F.col(f"p.{c}"))
        for c in base])
    untouched = products.join(upd, products.id == upd.pid, "left_anti")
    start = products.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    numbered = dense_ids(ins, "root", "_n")
    inserted = numbered.select(*[
        (F.lit(start) + F.col("_n")).alias(c) if c == "id"
        else value(c, None) if c in PRODUCT_FIELDS
        else F.col("_supplier_id").alias(c) if c == "supplier_id"
        else F.lit(None).alias(c)
        for c in base])
    inserted = inserted.select(*[F.col(c).cast(products.schema[c].dataType) for c in base])
    return untouched.select(*base).unionByName(updated).unionByName(inserted)


def import_stats(products: DataFrame, rows: DataFrame) -> DataFrame:
    """I11.  Per file: rows that created a product and rows that updated
    one."""
    r = resolve_rows(products, rows)
    is_new = F.col("pid").isNull() & (F.col("root") == F.col("pos"))
    return r.groupBy("file").agg(F.count_if(is_new).alias("products_added"),
                                 F.count_if(~is_new).alias("products_updated"))


def init_inventory(products_before: DataFrame, products_after: DataFrame) -> DataFrame:
    """I10.  A zero-stock row for every product the import created."""
    new = products_after.join(products_before.select("id"), "id", "left_anti")
    return new.select(F.col("id").alias("product_id"), F.lit(0).cast("long").alias("quantity"))
