"""Digests of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import casefold, strip


def normal(c: Column, kind: str) -> Column:
    """Text of a value as digests see it: null is empty, strings stripped and case-folded, dates and times ISO, decimals with six places.

    Doubles are written shortest, with a point (100.0); NaN and infinities are nan, inf and -inf.
    """
    if kind == "string":
        text = casefold(strip(c))
    elif kind.startswith("decimal"):
        text = c.cast("decimal(38,6)").cast("string")
    elif kind in ("double", "float"):
        short = c.cast("string")
        plain = F.regexp_replace(F.regexp_replace(short.try_cast("decimal(38,18)").cast("string"), r"0+$", ""), r"\.$", ".0")
        large = F.regexp_replace(F.regexp_replace(F.lower(short), r"\.0e", "e"), r"e(-?)(\d)$", "e$10$2")
        text = F.when(F.isnan(c), "nan").when(F.abs(c) == float("inf"), F.when(c > 0, "inf").otherwise("-inf")).when((F.abs(c) < 1e16) & (F.abs(c) >= 1e-4) | (c == 0), plain).otherwise(
            F.regexp_replace(large, r"e(\d)", "e+$1"))
    elif kind == "date":
        text = F.date_format(c, "yyyy-MM-dd")
    elif kind.startswith("timestamp"):
        text = F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(""))


def row_digest(df: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of the normalised values, joined by the unit separator so that nulls keep their place."""
    kinds = dict(df.dtypes)
    return F.sha2(F.concat_ws("\u001f", *[normal(F.col(c), kinds[c]) for c in columns]), 256)
