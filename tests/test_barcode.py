from pyspark.sql import functions as F

from stockfair.functions import barcode

# F2 plus the extra cases of FIXTURES.md
CASES = [
    ("5901234123457", "5901234123457", True),
    ("12345678", "12345678", False),          # the check digit of 1234567 is 0
    ("123456", "123456", False),
    ("ABC123456789", "123456789", False),
    ("", "", False),
    (None, None, False),
    ("036000291452", "036000291452", True),   # UPC-A
    ("036000291453", "036000291453", False),
    ("12345678901234", "12345678901234", True),  # 14 digits: not checked
    ("96385074", "96385074", True),           # EAN-8
    ("590-1234-1234 57", "5901234123457", True),
]


def test_clean_and_validate(spark):
    df = spark.createDataFrame([(r,) for r, _, _ in CASES], "raw string")
    got = df.select("raw", barcode.clean("raw").alias("c"),
                    barcode.is_valid(barcode.clean("raw")).alias("v")).collect()
    assert [(r.raw, r.c, r.v) for r in got] == CASES


def test_check_digit(spark):
    df = spark.createDataFrame([("590123412345",), ("1234567",), ("03600029145",)], "b string")
    got = [r.d for r in df.select(barcode.check_digit("b").alias("d")).collect()]
    assert got == [7, 0, 2]
    full = df.select(barcode.with_check_digit("b").alias("c"))
    assert all(r.v for r in full.select(barcode.is_valid("c").alias("v")).collect())
