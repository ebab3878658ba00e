"""Text cleaning as Column expressions; nulls stay null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dashes that count as a hyphen, and texts that mean a missing name.
DASHES = "[‐-―−]"
NO_NAME = ("null", "none", "n/a")


def strip(c: Column) -> Column:
    """Without white space of any kind at either end (trim() takes blanks only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", " ")


def join_key(c: Column, ignore_case: bool = True) -> Column:
    """Key of a value for joins: stripped, white space collapsed, lower-cased; blank is null."""
    key = collapse(strip(c.cast("string")))
    return F.nullif(F.lower(key) if ignore_case else key, F.lit(""))


def loose(c: Column) -> Column:
    """Letters and digits of a label, lower-cased."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def casefold(c: Column) -> Column:
    """Lower case in which the sharp s counts as ss and the long s as s."""
    return F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit("ſ"), F.lit("s"))


def snake(c: Column) -> Column:
    """A header as a column name: runs of other characters become one underscore, and a name
    of digits alone gets the prefix col_; blank is null."""
    name = F.regexp_replace(F.regexp_replace(casefold(strip(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.nullif(F.when(name.rlike("^[0-9]+$"), F.concat(F.lit("col_"), name)).otherwise(name), F.lit(""))


def pad_code(c: Column, width: int = 4) -> Column:
    """94, 94.0 and 0094 alike as 0094, 069_01 as 0069_01, longer numbers as they are; other text is stripped and kept."""
    plain, shape = strip(c), r"^([0-9]+)(?:\.0+)?(?:_([0-9]+))?$"
    head, tail = F.regexp_extract(plain, shape, 1), F.regexp_extract(plain, shape, 2)
    padded = F.when(F.length(head) <= width, F.lpad(F.regexp_replace(head, "^0+", ""), width, "0")).otherwise(head)
    return F.when(plain.rlike(shape), F.when(tail != "", F.concat(padded, F.lit("_"), tail)).otherwise(padded)).otherwise(F.nullif(plain, F.lit("")))


def code_number(c: Column) -> Column:
    """pad_code of a number that may be written with pc in front: PC-94 as 0094."""
    return pad_code(F.regexp_replace(strip(c), r"(?i)^pc[\s_-]?(?=\d)", ""))


def given(c: Column) -> Column:
    """A name as written, stripped; words for nothing are null."""
    plain = blank_to_null(c.cast("string"))
    return F.when(~F.lower(plain).isin(*NO_NAME), plain)


def name_key(c: Column) -> Column:
    """Key of a person's or office's name: one dash style, single blanks, lower case; words for nothing are null."""
    key = F.lower(collapse(strip(F.regexp_replace(c, DASHES, "-"))))
    return F.when(key.isin("", *NO_NAME), None).otherwise(key)
