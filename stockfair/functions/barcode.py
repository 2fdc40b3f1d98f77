"""Barcode column functions (EAN-8, UPC-A, EAN-13, 14-digit codes).

All are built-in Spark expressions (no UDF), so they stay inside whole-stage
codegen and run on every executor.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted code lengths, and the lengths whose last digit is a check digit.
VALID_LENGTHS = (8, 12, 13, 14)
CHECKED_LENGTHS = (8, 12, 13)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c) -> Column:
    """Keep the digits 0-9 only (NULL stays NULL)."""
    return F.regexp_replace(_col(c), "[^0-9]", "")


def _weighted_sum(digits, first_weight: int) -> Column:
    """Sum of the digits of ``digits`` weighted from the right end:
    ``first_weight`` for the last digit, then alternating 3 and 1.  The
    string is referenced once (reversed and split), which keeps the
    expression small when callers nest it; a non-digit gives NULL."""
    other = 1 if first_weight == 3 else 3
    chars = F.split(F.reverse(_col(digits)), "")
    weighted = F.transform(
        chars, lambda x, i: x.try_cast("int")
        * F.when(i % 2 == 0, F.lit(first_weight)).otherwise(F.lit(other)))
    return F.aggregate(weighted, F.lit(0), lambda acc, x: acc + x)


def check_digit(body) -> Column:
    """Expected check digit of a digit string ``body`` (the code without its
    last digit).  Weights run 3, 1, 3, ... from the right end of the body,
    which is the EAN/UPC rule for all of EAN-8, UPC-A and EAN-13.
    NULL for an empty or NULL body."""
    return (10 - _weighted_sum(body, 3) % 10) % 10


def has_valid_check_digit(code) -> Column:
    """True when the last digit is the check digit of the others: the whole
    code weighted 1, 3, 1, ... from the right sums to a multiple of 10."""
    return _weighted_sum(code, 1) % 10 == 0


def is_valid(code) -> Column:
    """Validity of an already cleaned code: digits only, length 8/12/13/14,
    and a correct check digit for lengths 8, 12 and 13.  NULL -> false."""
    c = _col(code)
    n = F.length(c)
    return F.coalesce(
        F.when(~c.rlike("^[0-9]+$"), F.lit(False))
        .when(n.isin(*CHECKED_LENGTHS), has_valid_check_digit(c))
        .otherwise(n == 14),
        F.lit(False),
    )


def with_check_digit(body) -> Column:
    """Append the check digit to a digit string body."""
    b = _col(body)
    return F.concat(b, check_digit(b).cast("string"))
