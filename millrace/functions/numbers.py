"""Exact numbers and flags out of text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.cells import let
from millrace.functions.text import strip

# Currency marks, words for true and false, and month names by their first three letters.
CURRENCY = "$£€¥₹"
YES, NO = ("true", "t", "yes", "y", "1", "1.0"), ("false", "f", "no", "n", "0", "0.0")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Digits, in groups of three or not, a fraction, an exponent; the digits before or after the point may lack.
_WHOLE, _FRACTION, _POWER = r"(?:\d{1,3}(?:,\d{3})+|\d+)", r"(?:\.\d*)", r"(?:[eE][+-]?\d+)"
_DIGITS = rf"(?=\.?\d){_WHOLE}?{_FRACTION}?{_POWER}?"
#: One amount: marks in front in any order, digits, marks behind; none of the marks twice.
AMOUNT = rf"^(?![^\d.]*[+-][^\d.]*[+-])(?![^{CURRENCY}]*[{CURRENCY}][^{CURRENCY}]*[{CURRENCY}])(?!.*\(.*\()(?!.*\).*\))(?!.*%.*%)([+\-{CURRENCY}(\s]*)({_DIGITS})([)%{CURRENCY}\s]*)$"
# Fixed value: what numbers may be dressed with.
DRESS = r"[\s_$£€¥₹%]"


def only(group: str, point: str) -> str:
    """What a convention alone can read: groups of three followed by another group or by decimals, or decimals that aren't three digits.

    One mark followed by three digits is a group in one convention and decimals in the other, so it is neither's.
    """
    return rf"^-?(?:\d{{1,3}}(?:\{group}\d{{3}})+(?:\{group}\d{{3}}|\{point}\d+)|\d*\{point}(?:\d{{1,2}}|\d{{4,}}))$"


US_ONLY, EU_ONLY = only(",", "."), only(".", ",")


def amount(c: Column, scale: int = 10, percent: bool = True) -> Column:
    """decimal(38, scale) of a text such as $1,234.50, (250.00), -$5, 12.5% or 1.2E+03; else null.

    One sign and one currency mark stand anywhere in front, the mark behind too; balanced
    parentheses negate, per cent divides by 100 (or is refused). A sign behind is no amount.
    """
    text, kind = strip(c.cast("string")), f"decimal(38,{scale})"
    value = F.replace(F.regexp_extract(text, AMOUNT, 2), F.lit(","), F.lit("")).try_cast(kind)
    opened = F.contains(text, F.lit("("))
    value = F.when(F.contains(text, F.lit("%")), (value / 100).cast(kind) if percent else None).otherwise(value)
    return F.when(opened == F.contains(text, F.lit(")")), F.when(opened | text.rlike(r"^[^\d.]*-"), -value).otherwise(value))


def fit(value: Column, precision: int, scale: int) -> Column:
    """value rounded half up to decimal(precision, scale); null if its integer part is too large."""
    kind = f"decimal({precision},{scale})"
    # 28 digits: with more, the comparison itself would round value
    fits = F.abs(value) < F.lit(10 ** min(27, precision - scale)).cast("decimal(28,0)")
    return F.when(fits, F.round(value, scale).try_cast(kind))


def whole(c: Column, kind: str = "bigint", months: bool = False) -> Column:
    """Integer of a text that states a whole number (2026.0 counts, 100% doesn't), else null; with months, of a month's name too."""
    value = amount(c, percent=False)
    number = F.when(value == F.floor(value), value.try_cast(kind))
    if not months:
        return number
    name = F.lower(F.substring(strip(c.cast("string")), 1, 3))
    return F.coalesce(number, F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), name), F.lit(0)).try_cast(kind))


def flag(c: Column) -> Column:
    text = F.lower(strip(c.cast("string")))
    return F.when(text.isin(*YES), True).when(text.isin(*NO), False)


def clean_number(c: Column, european: bool | Column = False) -> Column:
    """Double of a number as sheets write it, else null: (250) and 250- are negative, marks are dropped.

    `european` reads 1.234,5. Groups of other than three digits aren't numbers.
    """
    return any_number(strip(c.cast("string")), european)


def any_number(text: Column, european: bool | Column = False) -> Column:
    """clean_number of a text already stripped, which is looked at many times; give it a column, not an expression."""
    bracketed = F.startswith(text, F.lit("(")) & F.endswith(text, F.lit(")"))
    negated = bracketed | text.rlike(r"\d\s*-$")
    bare = F.when(bracketed, F.substring(text, F.lit(2), F.length(text) - 2)).when(negated, F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    bare = F.regexp_replace(bare, DRESS, "")
    bare = F.when(european if isinstance(european, Column) else F.lit(european), F.translate(bare, ",.", ".,")).otherwise(bare)

    def value(held: Column) -> Column:
        number = F.when(held.rlike(rf"^[+-]?{_DIGITS}$"), F.replace(held, F.lit(","), F.lit("")).try_cast("double"))
        return F.when(negated, F.when(~held.rlike("^[+-]"), -number)).otherwise(number)  # a number has one sign

    return let(bare, value)


def bare_number(c: Column) -> Column:
    """Double of a number that has nothing on it but a sign and thousands separators, else null."""
    text = F.replace(strip(c.cast("string")), F.lit(","), F.lit(""))
    return F.when(text.rlike(rf"^[+-]?{_DIGITS}$"), text.try_cast("double"))
