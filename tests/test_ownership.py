"""Matching in file order while rows change codes: against a row-by-row model
in Python and the SQL of the oracle."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from stockfair import oracle
from stockfair.operators import ingest, ownership
from test_ingest import _clean_rows

PRODUCTS = "id long, supplier_id long, sku string, ean_upc string, name string, description string, " \
           "category string, purchase_price double, selling_price double, status string"


def catalogue(spark, rows):
    return spark.createDataFrame([(i, None, s, e, n, None, None, None, None, None) for i, s, e, n in rows], PRODUCTS)


def model(products, rows):
    """{n: own} row by row; products (id, ean, sku), rows (n, ean, sku, writes_ean, writes_sku)."""
    top = max((p[0] for p in products), default=0)
    state = {p[0]: [p[1], p[2]] for p in products}
    out = {}
    for n, ean, sku, we, ws in sorted(rows):
        own = None
        for k, code in ((0, ean), (1, sku)):
            if own is None and code is not None:
                own = min((o for o, c in state.items() if c[k] == code), default=None)
        if own is None:
            own = top + n
            state[own] = [None, None]
        if we:
            state[own][0] = ean
        if ws:
            state[own][1] = sku
        out[n] = own
    return out


def random_import(rng, tag):
    """Products and rows of few codes, all marked with ``tag``, so that codes
    move, come back, are shared and are emptied."""
    ean = lambda: rng.choice([None, *[f"{tag}E{k}" for k in range(5)]])
    sku = lambda: rng.choice([None, *[f"{tag}S{k}" for k in range(5)]])
    products = [(ean(), sku()) for _ in range(rng.randrange(0, 5))]
    sheet = rng.choice([(True, True), (True, True), (True, False), (False, True)])
    rows = [(ean() if sheet[0] else None, sku() if sheet[1] else None, *sheet) for _ in range(rng.randrange(1, 15))]
    return products, rows


def many_imports(seed, imports):
    rng = random.Random(seed)
    products, rows = [], []
    for k in range(imports):
        p, r = random_import(rng, f"{k}-")
        products += p
        rows += [(k, i, x) for i, x in enumerate(r)]
    rng.shuffle(products)
    # the imports' rows in turn: each import's own order stays
    rows.sort(key=lambda r: (r[1], r[0]))
    return ([(i + 1, *p) for i, p in enumerate(products)], [(n + 1, *r[2]) for n, r in enumerate(rows)])


ROWS = "n long, ean_upc string, sku string, writes_ean boolean, writes_sku boolean"


@pytest.mark.parametrize("seed,as_pairs,block", [(1, 16, 1 << 16), (2, 0, 40)])
def test_random_imports_equal_the_model_and_sql(spark, seed, as_pairs, block):
    products, rows = many_imports(seed, 200)
    want = model(products, rows)
    p = spark.createDataFrame(products, "id long, ean_upc string, sku string")
    own, _ = ownership.targets(p, spark.createDataFrame(rows, ROWS), as_pairs, block)
    assert {r.n: r.own for r in own.collect()} == want
    con = duckdb.connect()
    con.execute("CREATE TABLE own_products (id BIGINT, ean_upc VARCHAR, sku VARCHAR)")
    con.execute("CREATE TABLE own_rows (n BIGINT, ean_upc VARCHAR, sku VARCHAR, writes_ean BOOLEAN, writes_sku BOOLEAN)")
    con.executemany("INSERT INTO own_products VALUES (?, ?, ?)", products)
    con.executemany("INSERT INTO own_rows VALUES (?, ?, ?, ?, ?)", rows)
    got = con.execute(f"WITH RECURSIVE {oracle.OWNERSHIP} SELECT n, own FROM landed").fetchall()
    assert dict(got) == want


def test_hot_code_of_many_products(spark):
    """Every row has the sku N/A; eans name 150 products or new ones.  The code's
    holders are matched in blocks, not as pairs."""
    rng = random.Random(3)
    products = [(k, f"E{k}", None) for k in range(1, 151)]
    rows = [(n, rng.choice([None, f"E{rng.randrange(1, 151)}", f"X{rng.randrange(20)}"]), "N/A", True, True)
            for n in range(1, 301)]
    p = spark.createDataFrame(products, "id long, ean_upc string, sku string")
    own, _ = ownership.targets(p, spark.createDataFrame(rows, ROWS), block_rows=32)
    assert {r.n: r.own for r in own.collect()} == model(products, rows)


def test_dyadic_blocks_cover_exactly(spark):
    rng = random.Random(4)
    pairs = [(lo, lo + rng.randrange(0, 70)) for lo in (rng.randrange(1, 500) for _ in range(200))]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i long, lo long, hi long")
    got = {}
    for r in df.select("i", F.explode(ownership.dyadic_blocks(F.col("lo"), F.col("hi"))).alias("b")).collect():
        got.setdefault(r.i, []).extend(range(r.b["index"] << r.b["level"], (r.b["index"] + 1) << r.b["level"]))
    for i, (lo, hi) in enumerate(pairs):
        assert sorted(got.get(i, [])) == list(range(lo, hi))


def test_moved_code_makes_a_new_product(spark):
    products = catalogue(spark, [(1, "S1", "E1", "old")])
    r = _clean_rows(spark, [("E9", "S1", "n1"), ("E1", None, "n2"), ("E1", None, "n3"), ("E9", None, "n4")])
    out = {p.id: (p.sku, p.ean_upc, p.name) for p in ingest.upsert_products(products, r).collect()}
    assert out == {1: (None, "E9", "n4"), 2: (None, "E1", "n3")}
    stats = ingest.import_stats(products, r).collect()[0]
    assert (stats.products_added, stats.products_updated) == (1, 3)


def test_supplier_of_two_ids_is_one(spark):
    from stockfair.plans import catalogue_import

    lines = spark.createDataFrame(
        [("bell.csv", k, x) for k, x in enumerate(["SKU,EAN Code,Name,Price", "S1,80,Bell helmet,5", "S2,81,Bell hat,6"])],
        "file string, line_no long, line string")
    suppliers = spark.createDataFrame([(7, "bell"), (3, "bell"), (4, "x")], "id long, name string")
    plan = catalogue_import.plan_import(lines, suppliers)
    assert [(r.file, r.supplier_id) for r in plan.file_suppliers.collect()] == [("bell.csv", 3)]
    out = plan.products(catalogue(spark, [])).collect()
    assert sorted((r.sku, r.supplier_id) for r in out) == [("S1", 3), ("S2", 3)]
