import os

from pyspark.sql import functions as F

from stockfair.operators import ingest, sheet_import
from stockfair.plans import catalogue_import
from stockfair.sources import sheets

HEAD = "Article #,EAN Code,Model Name,Description,Dealer Price,Suggested Retail,Status,Product Line,Brand"


def _write(folder, name, lines):
    with open(os.path.join(folder, name), "w", encoding="utf-8") as fh:
        fh.write("\n".join(lines) + "\n")


def _price_lists(folder):
    """FIXTURES.md F5: two title lines, then the header; row kinds as listed."""
    _write(folder, "a_ffwd_2025.csv", [
        "Listino 2025,,,", ",,,",
        HEAD,
        "NEW1,8000000000001,Helmet New,Road helmet,50.00,99.00,active,Helmets,FFWD",   # new
        "OLD-SKU,5901234123457,Old Helmet v2,,60.00,120.00,active,Helmets,FFWD",        # existing by EAN
        "SKU-ONLY,,Sku Saddle,Saddle,n/a,80.00,active,Saddles,FFWD",                    # existing by SKU
        "NONAME,8000000000009,,No name,1.00,2.00,active,X,FFWD",                        # dropped
        "NEW1,8000000000001,Helmet New 2,Road helmet,55.00,101.00,active,Helmets,FFWD",  # same EAN twice
        ",,Loose Item,Nothing,3.00,4.00,active,Misc,FFWD",                              # neither code
        '"Q,1",,"Quoted, Name",x,1.00,2.00,active,Misc,FFWD',                          # quoted cells
    ])
    _write(folder, "b_list.csv", [
        "Article #,EAN Code,Model Name,Dealer Price,Suggested Retail",   # no description
        "NEW2,8000000000002,Bolle frame,10.00,20.00",
    ])


def _catalogue(spark):
    suppliers = spark.createDataFrame([(1, "FFWD")], "id long, name string")
    products = spark.createDataFrame([
        (1, 1, "OLD-SKU", "5901234123457", "Old Helmet", "keep me", "Helmets", 10.0, 20.0, None),
        (2, 1, "SKU-ONLY", None, "Saddle", "old desc", "Saddles", 30.0, 40.0, None),
    ], "id long, supplier_id long, sku string, ean_upc string, name string, description string, "
       "category string, purchase_price double, selling_price double, status string")
    return suppliers, products


def test_price_list_import(spark, scratch):
    _price_lists(scratch)
    lines = sheets.read_sheet_lines(spark, scratch)
    suppliers, products = _catalogue(spark)
    plan = catalogue_import.plan_import(lines, suppliers)
    header = {r.file: r.header_row for r in plan.header.collect()}
    assert header == {"a_ffwd_2025.csv": 2, "b_list.csv": 0}
    guessed = {r.file: r.supplier for r in plan.suppliers_guessed.collect()}
    # "Bolle frame" in the first rows of b_list.csv names the supplier
    assert guessed == {"a_ffwd_2025.csv": "FFWD", "b_list.csv": "Bollé"}
    mapping = {(r.file, r.field): r.column for r in plan.mapping.collect()}
    assert mapping[("a_ffwd_2025.csv", "sku")] == "Article #"
    assert mapping[("a_ffwd_2025.csv", "selling_price")] == "Suggested Retail"
    assert ("b_list.csv", "description") not in mapping
    out = {r.id: r for r in plan.products(products).collect()}
    assert out[1].name == "Old Helmet v2" and out[1].description is None   # NULL cell overwrites
    assert out[1].purchase_price == 60.0
    assert out[2].purchase_price is None and out[2].name == "Sku Saddle"   # 'n/a' -> NULL
    new = {r.name: r for r in out.values() if r.id > 2}
    assert "Helmet New 2" in new and "Helmet New" not in new              # last row wins
    assert "Loose Item" in new and '"Quoted, Name"' not in new and "Quoted, Name" in new
    assert new["Bolle frame"].description is None                          # column absent
    stats = {r.file: (r.products_added, r.products_updated) for r in plan.stats(products).collect()}
    assert stats["a_ffwd_2025.csv"] == (3, 3)
    assert stats["b_list.csv"] == (1, 0)
    sup = {r.name: r.id for r in plan.suppliers.collect()}
    assert sup == {"FFWD": 1, "Bollé": 2}


def test_event_sheet_headers(spark):
    cols = ["Periodo", "Accordi", "N° Eventi", "Data", "EXPO", "EXPO.1", "Località",
            "Vitto & Alloggio", "Spazio/Varie", "Vendita Privati / Agenti", "Incassi"]
    m = sheet_import.header_mapping(cols)
    assert m == {"Periodo": "periodo", "Accordi": "accordo", "N° Eventi": "num_eventi",
                 "Data": "data", "EXPO": "expo_periodo", "EXPO.1": "expo_brand",
                 "Località": "localita", "Vitto & Alloggio": "vitto_alloggio",
                 "Spazio/Varie": "spazio_varie",
                 "Vendita Privati / Agenti": "vendita_privati_agenti", "Incassi": "incassi"}
    assert sheet_import.canonical_column("N. Eventi") == "num_eventi"


def test_event_sheet_import(spark):
    sheet = spark.createDataFrame([
        (1, "Q1", "1", "2024-01-15 00:00:00", "1000"),
        (2, "Q1", "2", "15/01/2024", "n/d"),
        (3, "Q2", "x", "", "5"),
    ], "_row long, Periodo string, `N° Eventi` string, Data string, Incassi string")
    good = {r.id: r for r in sheet_import.ingest_annual_events(sheet, "_row").collect()}
    assert list(good) == [1] and good[1].data == "2024-01-15" and good[1].incassi == 1000.0
    rej = {r.id: r.reason for r in sheet_import.ingest_rejects(sheet, "_row").collect()}
    assert rej == {2: "bad value in: incassi", 3: "bad value in: num_eventi"}
    dates = [r.d for r in sheet.select(sheet_import.normalise_event_date(F.col("Data")).alias("d"))
             .orderBy("_row").collect()]
    assert dates == ["2024-01-15", "15/01/2024", None]


def test_profile(spark):
    df = spark.createDataFrame([(1, None), (None, "a")], "a long, b string")
    p = sheet_import.profile_table(df).collect()[0]
    assert (p.n_rows, p.n_columns, p.n_nulls) == (2, 2, 2)


def test_read_event_sheet_f4(spark, scratch):
    _write(scratch, "eventi.csv", [
        "Periodo,Accordi,N° Eventi,Data,EXPO,Nome,EXPO,Località,Vitto & Alloggio,Spazio/Varie,"
        "Vendita Privati / Agenti,Incassi",
        "Q1,si,1,2024-03-01 00:00:00,Bologna,Fiera A,FFWD,Roma,10.5,2,3,1000",
        "Q2,,2,15/04/2024,,Fiera B,,Milano,,,,",
    ])
    sheet = sheets.read_event_sheet(spark, os.path.join(scratch, "eventi.csv"))
    assert "EXPO.1" in sheet.columns
    rows = {r.nome: r for r in sheet_import.ingest_annual_events(sheet).collect()}
    a = rows["Fiera A"]
    assert (a.accordo, a.num_eventi, a.data, a.expo_periodo, a.expo_brand, a.localita) == \
        ("si", 1, "2024-03-01", "Bologna", "FFWD", "Roma")
    assert (a.vitto_alloggio, a.spazio_varie, a.vendita_privati_agenti, a.incassi) == \
        (10.5, 2.0, 3.0, 1000.0)
    assert rows["Fiera B"].data == "15/04/2024" and rows["Fiera B"].incassi is None


def _clean_rows(spark, rows):
    fields = ["ean_upc", "sku", "name"]
    data = [("f.csv", i, *r, list(fields)) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "file string, line_no long, ean_upc string, sku string, name string, "
                                     "mapped array<string>")
    for c in ("description", "status", "category", "supplier"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    for c in ("purchase_price", "selling_price"):
        df = df.withColumn(c, F.lit(None).cast("double"))
    return df


def test_long_chain_is_one_product(spark):
    # row k shares its barcode with the row before it, or its sku, in turn
    rows = [(f"E{(k + 1) // 2}", f"S{k // 2}", f"n{k}") for k in range(24)]
    products = spark.createDataFrame([], "id long, supplier_id long, sku string, ean_upc string, name string, "
                                         "description string, category string, purchase_price double, "
                                         "selling_price double, status string")
    r = _clean_rows(spark, rows)
    out = ingest.upsert_products(products, r)
    assert [p.name for p in out.collect()] == ["n23"]
    stats = ingest.import_stats(products, r).collect()[0]
    assert (stats.products_added, stats.products_updated) == (1, 23)


def test_code_written_by_an_earlier_row_is_matched(spark):
    _, products = _catalogue(spark)
    r = _clean_rows(spark, [("E9", "SKU-ONLY", "a"), ("E9", None, "b"), ("E9", "NEWSKU", "c"), (None, "NEWSKU", "d")])
    out = ingest.upsert_products(products, r).collect()
    assert len(out) == 2
    assert {p.id: (p.name, p.sku) for p in out}[2] == ("d", "NEWSKU")
    stats = ingest.import_stats(products, r).collect()[0]
    assert (stats.products_added, stats.products_updated) == (0, 4)


def test_only_full_dates_are_rewritten(spark):
    cells = ["2024", "2024-03", "12:30", "2024-03-05", "2024-03-05 10:00:00", "05/03/2024", "2024-13-40", "", None]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = [r.d for r in df.select(sheet_import.normalise_event_date(F.col("c")).alias("d")).collect()]
    assert got == ["2024", "2024-03", "12:30", "2024-03-05", "2024-03-05", "05/03/2024", "2024-13-40", None, None]


def test_keys_of_any_length_stay_distinct(spark):
    from stockfair.sources.driver import padded

    df = spark.createDataFrame([(7,), (999999,), (1000000,), (1000001,), (12345678,)], "k long")
    assert [r.t for r in df.select(padded(F.col("k"), 6).alias("t")).collect()] == \
        ["000007", "999999", "1000000", "1000001", "12345678"]


def test_facts_equal_the_steps(spark, scratch):
    """File facts, filled cells and clean rows equal the steps over all cells, also
    when the files are too many for a map; no cell is shuffled by file."""
    _write(scratch, "a_ffwd.csv", ["List 2025", "", "SKU,EAN Code,Model Name,Notes,Dealer Price,,Price", "S1,80,Helm,,n/a,,5",
                                   ",,,,,,", "S2,,\"Two, 2\",,7.5,,", "S3,81"])
    _write(scratch, "plain.csv", ["x,y", "1,2", "Premium,3"])
    _write(scratch, "empty.csv", ["a"])
    lines = sheets.read_sheet_lines(spark, scratch)
    cells = sheets.sheet_cells(lines)
    header = ingest.detect_header_row(cells)
    mapping = ingest.detect_columns(cells, header)

    def rows(df):
        return sorted(map(repr, (tuple(r) for r in df.collect())))

    for bound in (ingest.FACTS_AS_MAP, 0):
        old, ingest.FACTS_AS_MAP = ingest.FACTS_AS_MAP, bound
        try:
            facts = ingest.file_facts(lines)
            assert rows(facts.select("file", "header_row", "header_line")) == rows(header)
            assert rows(facts.select("file", "supplier")) == rows(ingest.guess_supplier(cells))
            assert rows(ingest.mapping_of(facts)) == rows(mapping)
            filled, clean = ingest.filled_cells(lines, facts), ingest.clean_rows(lines, facts)
            assert rows(filled) == rows(ingest.drop_empty(cells, header))
            assert rows(clean) == rows(ingest.clean_products(cells, header, mapping))
        finally:
            ingest.FACTS_AS_MAP = old
    plain = spark.createDataFrame([("f.csv", k, f"a,b,{k}") for k in range(50)], "file string, line_no long, line string")
    plan = ingest.clean_rows(plain, ingest.file_facts(plain))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(file" not in plan


def test_cell_types(spark):
    cells = {"12": "integer", "-3": "integer", "1.5": "float", ".5": "float", "1e3": "float", "2024-02-29": "date",
             "2024-02-30": "text", "2024-01-01 10:00": "date", "x": "text", "": None, "  ": None, None: None, "1,5": "text"}
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert {r.c: r.t for r in df.select("c", sheet_import.cell_type(F.col("c")).alias("t")).collect()} == cells
    table = spark.createDataFrame([("1", "1", "2024-01-01", None, "1"), ("2", "2.5", "5", "", "x"), (None, None, None, None, None)],
                                  "a string, b string, c string, d string, `e.f` string")
    got = {r.column: (r.type, r.n_integer, r.n_float, r.n_date, r.n_text, r.nulls)
           for r in sheet_import.infer_column_types(table).collect()}
    assert got == {"a": ("integer", 2, 0, 0, 0, 1), "b": ("float", 1, 1, 0, 0, 1), "c": ("text", 1, 0, 1, 0, 1),
                   "d": ("empty", 0, 0, 0, 0, 3), "e.f": ("text", 1, 0, 0, 1, 1)}
