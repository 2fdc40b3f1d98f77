"""Stock and fair tables derived from the driver's generated parquet tables.

The driver writes TPC-H-like tables (``part``, ``supplier``, ``orders``,
``lineitem``, ``customer``, ``nation``, ``region``) and an ``events`` log.
This module maps them onto the application's tables (products, inventory,
movements, scans, yearly events, fair sales ...) as described in
FIXTURES.md part B.  Every view is a lazy DataFrame over the parquet scan,
so Catalyst prunes columns and pushes filters down to the files; the work of
every query grows with the tables.

``stockfair.oracle`` holds the same derivations as SQL text for DuckDB.
"""

from __future__ import annotations

from decimal import Decimal
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockfair import schemas
from stockfair.functions import barcode

# File names of the derived price lists.
PRICE_LIST_FILES = ("ffwd_listino.csv", "listino_2025.csv", "catalogo_premium.csv", "prezzi.csv")

RECODED_FILE = "zz_recoded.csv"

RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def money(c: Column, factor: str) -> Column:
    """round(c * factor, 2) in exact decimal arithmetic (half up), as double.
    Decimal keeps ties such as 30.015 identical across engines."""
    return F.round(c.cast("decimal(18,2)") * F.lit(Decimal(factor)), 2).cast("double")


def padded(k: Column, n: int) -> Column:
    """Key as text, padded with zeros to ``n`` places and never cut."""
    t = k.cast("string")
    return F.when(F.length(t) < n, F.lpad(t, n, "0")).otherwise(t)


def ean_for_part(k: Column) -> Column:
    """EAN-13 of part ``k``: '80' + key padded to 10 + check digit.  The check
    digit is shifted by one when k % 7 = 0 (a deliberately bad code)."""
    body = F.concat(F.lit("80"), F.lpad(k.cast("string"), 10, "0"))
    digit = (barcode.check_digit(body) + F.when(k % 7 == 0, 1).otherwise(0)) % 10
    return F.concat(body, digit.cast("string"))


class DriverTables:
    """Lazy views over one scale-factor folder of driver parquet files."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def raw_stream(self, name: str, max_files_per_trigger: int = 1) -> DataFrame:
        """The same table as a file stream (schema taken from the batch read)."""
        schema = self.raw(name).schema
        # a glob that matches the one file: the stream source wants a folder
        return (self.spark.readStream.schema(schema)
                .option("maxFilesPerTrigger", max_files_per_trigger)
                .parquet(f"{self.sf_dir}/[{name[0]}]{name[1:]}.parquet"))

    def landing(self) -> str:
        """A new folder below the checkpoint directory, removed when Spark ends."""
        import uuid

        from stockfair.session import ensure_checkpoint_dir

        folder = f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/landed-{uuid.uuid4().hex}"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(path)
        return folder

    def landed_lists(self) -> str:
        """Price lists as files in a folder, one file for each of ten rests of the part
        key, with names and types quoted: cells over two lines, quotes and commas in cells."""
        p, k = self.raw("part"), F.col("p_partkey")
        file = F.concat(F.lit("bell_"), (k % 10).cast("string"), F.lit(".csv"))
        line = F.concat(F.lit("SKU"), padded(k, 6), F.lit(',"'), F.col("p_name"), F.lit("\n"), F.col("p_brand"),
                        F.lit('","say ""'), F.col("p_type"), F.lit('"", ok",'), k.cast("string"))
        rows = p.select(file.alias("file"), k.alias("k"), line.alias("line"))
        heads = rows.select("file").distinct().select(
            "file", F.lit(-1).cast("long").alias("k"), F.lit("SKU,Name,Type,Key").alias("line"))
        folder = self.landing()
        rows.unionByName(heads).repartition("file").sortWithinPartitions("file", "k").select("file", "line") \
            .write.partitionBy("file").text(f"{folder}/parts")
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = fs_path(folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.mkdirs(fs_path(f"{folder}/lists"))
        for f in fs.globStatus(fs_path(f"{folder}/parts/file=*/part-*")):            # ten files
            name = f.getPath().getParent().getName().split("=", 1)[1]
            fs.rename(f.getPath(), fs_path(f"{folder}/lists/{name}"))
        return f"{folder}/lists"

    def landed_csv(self, df: DataFrame) -> str:
        """``df`` as CSV files with headers in a folder."""
        folder = f"{self.landing()}/sheets"
        df.write.option("header", True).option("escape", '"').csv(folder)
        return folder

    def landed_events(self, piece: Column, pieces: int):
        """The events arriving in ``pieces`` deliveries of files (``piece`` = 0, 1 ...) in
        one folder of the checkpoint directory: yields the folder's stream after each."""
        events, folder = self.raw("events").withColumn("_piece", piece), self.landing()
        for k in range(pieces):
            events.where(F.col("_piece") == k).drop("_piece").write.mode("append").parquet(f"{folder}/events")
            yield self.spark.readStream.schema(self.raw("events").schema).parquet(f"{folder}/events"), folder

    # -- catalogue -------------------------------------------------------
    def suppliers(self) -> DataFrame:
        s = self.raw("supplier")
        return s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))

    def products(self) -> DataFrame:
        p = self.raw("part")
        k = F.col("p_partkey")
        return p.select(
            k.alias("id"),
            F.when(k % 53 == 0, F.lit(None)).otherwise(k % 10).cast("long").alias("supplier_id"),
            F.concat(F.lit("SKU"), padded(k, 6)).alias("sku"),
            F.when(k % 11 == 0, F.lit(None)).otherwise(ean_for_part(k)).alias("ean_upc"),
            F.col("p_name").alias("name"),
            F.concat_ws(" ", "p_brand", "p_type").alias("description"),
            F.when(k % 41 == 0, F.lit(None)).otherwise(F.col("p_type")).alias("category"),
            F.when(k % 37 == 0, F.lit(None))
            .otherwise(money(F.col("p_retailprice"), "0.6")).alias("purchase_price"),
            F.col("p_retailprice").alias("selling_price"),
        )

    def inventory(self) -> DataFrame:
        p = self.raw("part").where(F.col("p_partkey") % 29 != 0)
        k = F.col("p_partkey")
        q = (k * 7) % 60
        return p.select(
            k.alias("id"), k.alias("product_id"), q.cast("long").alias("quantity"),
            F.floor(q / 10).cast("long").alias("reserved"),
            F.lit("warehouse").alias("location"),
            F.lit("2024-12-31 00:00:00").cast("timestamp_ntz").alias("last_updated"),
        )

    # -- ledger ----------------------------------------------------------
    def movements(self, events: DataFrame | None = None) -> DataFrame:
        e = self.raw("events") if events is None else events
        return e.select(
            F.col("event_id").alias("seq"),
            F.col("user_id").alias("product_id"),
            F.when(F.col("event_type").isin("view", "signup"), "in").otherwise("out")
            .alias("transaction_type"),
            F.floor("value").cast("long").alias("quantity"),
            F.col("event_type").alias("reference"),
            F.col("props").alias("notes"),
            F.col("user_id").cast("string").alias("user"),
            F.col("ts"),
        )

    def daily_movements(self) -> DataFrame:
        """The movements as a log that knows the day only: ``seq`` is its number."""
        day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
        return self.movements().withColumn("seq", day.cast("long"))

    def inventory_transactions(self) -> DataFrame:
        m = self.movements()
        return m.select(
            F.col("seq").alias("id"), "product_id", "transaction_type", "quantity",
            "reference", "notes", F.col("ts").alias("transaction_date"), "user",
        )

    def stock_log(self) -> DataFrame:
        m = self.movements()
        is_in = F.col("transaction_type") == "in"
        return m.select(
            F.col("seq").alias("id"),
            F.when(is_in, "stock_in").otherwise("stock_out").alias("event_type"),
            F.when(is_in, F.format_string("Added %d units to stock", F.col("quantity")))
            .otherwise(F.format_string("Removed %d units from stock", F.col("quantity")))
            .alias("description"),
            F.col("seq").alias("related_id"),
            F.col("ts").alias("event_date"),
            "user",
        )

    def scans(self, events: DataFrame | None = None) -> DataFrame:
        e = self.raw("events") if events is None else events
        part = F.when(F.col("user_id") % 5 == 0, F.lit(29)).otherwise(F.col("user_id") % 4 + 4)
        code = ean_for_part(part)
        code = F.when(F.col("event_id") % 13 == 0,
                      F.concat(F.substring(code, 1, 2), F.lit("-"), F.substring(code, 3, 20))
                      ).otherwise(code)
        return e.select(F.col("event_type").alias("scanner_id"), "ts", code.alias("barcode"),
                        F.col("event_id").alias("scan_id"))

    # -- yearly event sheet --------------------------------------------------
    def annual_events(self) -> DataFrame:
        o = self.raw("orders")
        c = self.raw("customer").select("c_custkey", "c_nationkey")
        n = self.raw("nation").select("n_nationkey", "n_name", "n_regionkey")
        r = self.raw("region").select("r_regionkey", "r_name")
        li = self.raw("lineitem").groupBy("l_orderkey").agg(
            *[F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity"))).alias(name)
              for flag, name in (("A", "caschi"), ("N", "occhiali"), ("R", "pneumatici"))]
        )
        k = F.col("o_orderkey")
        j = (o.join(c, o.o_custkey == c.c_custkey, "left")
             .join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
             .join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
             .join(li, k == F.col("l_orderkey"), "left"))
        iso = F.date_format("o_orderdate", "yyyy-MM-dd")
        out = j.select(
            k.alias("id"),
            F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string")).alias("periodo"),
            F.lit(1).cast("long").alias("num_eventi"),
            F.when(k % 89 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(iso)
            .alias("data"),
            F.concat(F.lit("EV"), k.cast("string")).alias("nome"),
            F.col("n_name").alias("localita"),
            F.when(k % 101 == 0, F.lit(None)).otherwise(F.col("r_name")).alias("regione"),
            "caschi", "occhiali", "pneumatici",
            money(F.col("o_totalprice"), "0.3").alias("costi_reali"),
            F.col("o_totalprice").alias("incassi"),
        )
        return schemas.conform(out, "annual_events")

    # -- fairs, assignments, sales -----------------------------------------
    def _fair_of_order(self) -> DataFrame:
        """(o_orderkey, event_id): the fair of every order with a known customer.  Put
        together before the lines are joined, so that they are shuffled once, by order."""
        o = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        c = self.raw("customer").select("c_custkey", "c_nationkey")
        return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
            "o_orderkey", (F.year("o_orderdate") * 100 + F.col("c_nationkey")).cast("long").alias("event_id"))

    def _order_lines(self) -> DataFrame:
        li = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_quantity",
                                         "l_extendedprice", "l_returnflag", "l_shipdate")
        return li.join(self._fair_of_order(), F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")

    def event_sales(self) -> DataFrame:
        j = self._order_lines().where(F.col("l_returnflag") != "R")
        return j.select(
            "event_id",
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("long").alias("quantity"),
            F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")).alias("sale_price"),
            F.col("l_shipdate").cast("date").alias("sale_date"),
        )

    def event_products(self, lines: DataFrame | None = None) -> DataFrame:
        """Quantities by fair and part, of the order lines or of ``lines`` (stored
        ``summed_lines``).  Grouped by part first: tables joined on both are sorted by the
        column with more values."""
        j = self._order_lines() if lines is None else lines
        # the price is worked out once a part, not once an assignment
        p = self.raw("part").select("p_partkey", money(F.col("p_retailprice"), "0.9").alias("_price"))
        agg = (j.groupBy(F.col("l_partkey").alias("product_id"), "event_id")
               .agg(F.sum("l_quantity").cast("long").alias("quantity_assigned"))
               .where((F.col("event_id") + F.col("product_id")) % 17 != 0))
        out = agg.join(p, agg.product_id == p.p_partkey, "left").select(
            (F.col("event_id") * 10_000_000_000 + F.col("product_id")).alias("id"),
            "event_id", "product_id", "quantity_assigned",
            F.when(F.col("product_id") % 2 == 1, F.col("_price")).alias("event_sale_price"),
        )
        return out

    def fairs(self) -> DataFrame:
        o = self.raw("orders").select("o_custkey", "o_orderdate")
        c = self.raw("customer").select("c_custkey", "c_nationkey")
        n = self.raw("nation").select("n_nationkey", "n_name")
        j = (o.join(c, o.o_custkey == c.c_custkey)
             .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
             .withColumn("yr", F.year("o_orderdate")))
        g = j.groupBy("yr", "c_nationkey", "n_name").agg(
            F.min("o_orderdate").cast("date").alias("start_date"),
            F.max("o_orderdate").cast("date").alias("end_date"),
        )
        return g.select(
            (F.col("yr") * 100 + F.col("c_nationkey")).cast("long").alias("id"),
            F.concat_ws(" ", "n_name", F.col("yr").cast("string")).alias("name"),
            "start_date", "end_date",
            F.col("n_name").alias("location"),
            F.concat(F.lit("Fair in "), F.col("n_name")).alias("description"),
        )

    # -- request tables for the allocation and edit jobs ----------------------
    def _lines(self) -> DataFrame:
        li = self.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
                                         "l_extendedprice", "l_returnflag", "l_shipdate")
        return li.join(self._fair_of_order(), F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")

    def summed_lines(self) -> DataFrame:
        """Order lines keyed by (order, line number, part) -- the generated
        lineitem repeats that key a few times, so repeats are summed."""
        return self._lines().groupBy("l_orderkey", "l_linenumber", "l_partkey", "event_id").agg(
            F.sum("l_quantity").alias("l_quantity"),
            F.sum("l_extendedprice").alias("l_extendedprice"))

    def _request_lines(self, lines: DataFrame | None = None) -> DataFrame:
        """``summed_lines`` (or ``lines``, where they are stored) with a unique request
        number ``seq``."""
        g = self.summed_lines() if lines is None else lines
        return g.withColumn("seq", (F.col("l_orderkey") * 100 + F.col("l_linenumber"))
                            * 10_000_000 + F.col("l_partkey"))

    def allocation_requests(self, lines: DataFrame | None = None) -> DataFrame:
        """One batch per order: its lines request ceil(quantity / 10) units of
        the part for the order's fair; line 1 carries a fair price."""
        j = self._request_lines(lines)
        return j.select(
            F.col("l_orderkey").alias("batch_id"), "seq", "event_id",
            F.col("l_partkey").alias("product_id"),
            F.ceil(F.col("l_quantity") / 10).cast("long").alias("quantity"),
            F.when(F.col("l_linenumber") == 1,
                   F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))).alias("sale_price"),
        )

    def request_log(self) -> DataFrame:
        """Order lines as calls on the assignments of their fair: allocations, changes
        and removals in turn by line number."""
        j = self._request_lines()
        ln = F.col("l_linenumber")
        return j.select(
            "seq", F.when(ln % 3 == 0, "remove").when(ln % 3 == 2, "change").otherwise("allocate").alias("action"),
            "event_id", F.col("l_partkey").alias("product_id"),
            F.when(ln % 3 == 1, F.ceil(F.col("l_quantity") / 10)).when(ln % 3 == 2, F.col("l_quantity"))
            .cast("long").alias("quantity"))

    def allocation_sheet(self, event_id: int | None = None) -> DataFrame:
        """Import sheets of the fairs (one fair when ``event_id`` is given):
        their order lines as SKU / Quantity text rows, with unknown skus
        (line 5), a non-number (line 3) and a decimal quantity (line 6)."""
        j = self._request_lines()
        if event_id is not None:
            j = j.where(F.col("event_id") == F.lit(event_id))
        ln, k = F.col("l_linenumber"), F.col("l_partkey")
        sku = F.when(ln == 5, F.concat(F.lit("SKU-X"), k.cast("string"))).otherwise(
            F.concat(F.lit("SKU"), padded(k, 6)))
        qty = (F.when(ln == 3, F.lit("abc")).when(ln == 6, F.lit("2.7"))
               .otherwise(F.col("l_quantity").cast("long").cast("string")))
        return j.select("event_id", "seq", sku.alias("SKU"), qty.alias("Quantity"),
                        F.col("l_extendedprice").cast("long").cast("string").alias("Sale Price"))

    def line_sheets(self) -> DataFrame:
        """The fairs' import sheets with the order lines' own numbers: every sheet
        counts from 1 and repeats its numbers."""
        return self.allocation_sheet().withColumn(
            "seq", F.floor(F.col("seq") / 10_000_000) % 100)

    def quantity_true_up(self) -> DataFrame:
        """Requests to set each (fair, product) assignment to the quantity
        sold there."""
        s = self.event_sales()
        return s.groupBy("event_id", "product_id").agg(
            F.sum("quantity").cast("long").alias("new_quantity")).select(
            (F.col("event_id") * 10_000_000_000 + F.col("product_id")).alias("seq"),
            "event_id", "product_id", "new_quantity")

    def returned_sales(self) -> DataFrame:
        """Returned order lines offered as new fair sales."""
        j = self._lines().where(F.col("l_returnflag") == "R")
        return j.select("event_id", F.col("l_partkey").alias("product_id"),
                        F.col("l_quantity").cast("long").alias("quantity"),
                        F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))
                        .alias("sale_price"),
                        F.col("l_shipdate").cast("date").alias("sale_date"))

    # -- sheets for the import jobs ------------------------------------------
    def price_list_lines(self) -> DataFrame:
        """Supplier price lists as CSV text lines (file, line_no, line), four
        files; see FIXTURES.md F5 for the row kinds (by part key % 10)."""
        p = self.raw("part")
        k, v = F.col("p_partkey"), F.col("p_partkey") % 10
        fid = (F.floor(k / 25) % 4).cast("int")
        file = F.element_at(F.array(*[F.lit(n) for n in PRICE_LIST_FILES]), fid + 1)
        ks = k.cast("string")
        article = (F.when(v.isin(0, 8), F.concat(F.lit("NEW"), ks))
                   .when(v == 5, F.concat(F.lit("NEW"), (k - 5).cast("string")))
                   .when(v == 6, F.lit("")).otherwise(F.concat(F.lit("SKU"), padded(k, 6))))
        ean = (F.when(v.isin(0, 8), F.concat(F.lit("81"), F.lpad(ks, 11, "0")))
               .when(v.isin(1, 3, 4, 7) & (k % 11 != 0), ean_for_part(k)).otherwise(F.lit("")))
        model = F.when(v == 3, F.lit("")).otherwise(F.col("p_name"))
        descr = F.when(v == 7, F.lit("")).otherwise(F.concat_ws(" ", "p_brand", "p_type"))
        price = F.col("p_retailprice").cast("decimal(18,2)")
        dealer = F.when(v == 4, F.lit("n/a")).otherwise(
            F.round(price * F.lit(Decimal("0.5")), 2).cast("decimal(18,2)").cast("string"))
        retail = price.cast("string")
        status = F.when(k % 3 == 0, F.lit("discontinued")).otherwise(F.lit("active"))
        brand = F.when(fid == 1, F.lit("BIS Srl")).otherwise(F.col("p_brand"))

        def line(model_c, retail_c):
            return F.concat(article, F.lit(","), ean, F.lit(","), model_c,
                            F.when(fid != 3, F.concat(F.lit(","), descr)).otherwise(F.lit("")),
                            F.lit(","), dealer, F.lit(","), retail_c, F.lit(","), status,
                            F.lit(","), F.col("p_type"), F.lit(","), brand,
                            F.when(fid == 0, F.lit(",")).otherwise(F.lit("")))

        rows = p.select(file.alias("file"), (k * 2 + 10).alias("line_no"),
                        line(model, retail).alias("line"))
        dups = p.where(v == 0).select(
            file.alias("file"), (k * 2 + 11).alias("line_no"),
            line(F.concat(F.col("p_name"), F.lit(" v2")),
                 (price + 1).cast("decimal(18,2)").cast("string")).alias("line"))
        files = p.select(fid.alias("fid"), file.alias("file")).distinct()
        header = F.concat(
            F.lit("Article #,EAN Code,Model Name"),
            F.when(F.col("fid") != 3, F.lit(",Description")).otherwise(F.lit("")),
            F.lit(",Dealer Price,Suggested Retail,Status,Product Line,Brand"),
            F.when(F.col("fid") == 0, F.lit(",Notes")).otherwise(F.lit("")))
        heads = files.select("file", F.explode(F.array(
            F.struct(F.lit(0).cast("long").alias("line_no"), F.lit("Listino prezzi 2025").alias("line")),
            F.struct(F.lit(1).cast("long").alias("line_no"), F.lit("").alias("line")),
            F.struct(F.lit(2).cast("long").alias("line_no"), header.alias("line")))).alias("x"))
        heads = heads.select("file", "x.line_no", "x.line")
        return heads.unionByName(rows).unionByName(dups)

    def recoded_lines(self) -> DataFrame:
        """The price lists and, behind them, one that gives every tenth part a new
        EAN and its old one to another article, two lines a part."""
        p = self.raw("part").where(F.col("p_partkey") % 10 == 1)
        k = F.col("p_partkey")
        ks, file = k.cast("string"), F.lit(RECODED_FILE)
        new = F.concat(F.lit("82"), padded(k, 11))
        first = F.concat_ws(",", F.concat(F.lit("SKU"), padded(k, 6)), new, "p_name")
        second = F.concat_ws(",", F.concat(F.lit("MOVED"), ks), ean_for_part(k), F.concat_ws(" ", "p_name", F.lit("moved")))
        head = self.raw("part").select(file.alias("file"), F.lit(0).cast("long").alias("line_no"),
                                       F.lit("SKU,EAN Code,Name").alias("line")).distinct()
        return self.price_list_lines().unionByName(head).unionByName(
            p.select(file.alias("file"), (k * 2 + 10).alias("line_no"), first.alias("line"))).unionByName(
            p.select(file.alias("file"), (k * 2 + 11).alias("line_no"), second.alias("line")))

    def event_sheet(self) -> DataFrame:
        """The yearly event sheet as it arrives: raw headers, text cells,
        with a row id ``_row``; some cells do not fit their column."""
        o = self.raw("orders")
        k = F.col("o_orderkey")
        data = (F.when(k % 83 == 0, F.lit(None))
                .when(k % 89 == 0, F.date_format("o_orderdate", "dd/MM/yyyy"))
                .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")))
        total = F.col("o_totalprice").cast("decimal(18,2)")
        return o.select(
            k.alias("_row"),
            F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string")).alias("Periodo"),
            F.when(k % 97 == 0, F.lit("uno")).otherwise(F.lit("1")).alias("N° Eventi"),
            data.alias("Data"),
            F.concat(F.lit("EV"), k.cast("string")).alias("Nome"),
            F.when(k % 2 == 0, F.lit("FFWD")).alias("EXPO.1"),
            F.col("o_orderpriority").alias("Località"),
            total.cast("string").alias("Incassi"),
            F.when(k % 71 == 0, F.lit("n/d"))
            .otherwise(F.round(total * F.lit(Decimal("0.3")), 2).cast("decimal(18,2)")
                       .cast("string")).alias("Costi Reali"),
            F.when(k % 5 == 0, F.lit("12.5")).alias("Vitto & Alloggio"),
            F.lit("x").alias("Colonna Extra"),
        )

    @cached_property
    def all(self) -> dict[str, DataFrame]:
        names = ("suppliers", "products", "inventory", "movements", "inventory_transactions",
                 "stock_log", "scans", "annual_events", "event_sales", "event_products", "fairs")
        return {n: getattr(self, n)() for n in names}
