"""Text column functions shared by the operators (built-in expressions only)."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c) -> Column:
    """Lower-case ASCII letters only (the case folding of SQL LIKE in the
    original store: 'É' stays 'É')."""
    return F.translate(_col(c), _UPPER, _LOWER)


def ascii_lower_literal(s: str) -> str:
    return s.translate(str.maketrans(_UPPER, _LOWER))


def safe_name(c) -> Column:
    """Every character that is not a letter or digit becomes '_'."""
    return F.regexp_replace(_col(c), r"[^\p{L}\p{N}]", "_")


def blank_to_null(c) -> Column:
    c = _col(c)
    return F.when(F.trim(c) == "", F.lit(None)).otherwise(c)
