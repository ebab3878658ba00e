"""Dates, timestamps, months and periods out of text, as Column expressions."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import blank_to_null

_CLOCK, _FRACTION = r"\d{1,2}:\d{2}:\d{2}", r"(?:\.\d+)?"
# The formats of typed columns (a shape and the pattern that reads it, in this order), the epoch of
# spreadsheet serials, and the years within which eight digits or a serial are a date.
DATE_TIMES = (
    (rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}} {_CLOCK}{_FRACTION}$", "yyyy-M-d H:mm:ss"),
    (rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}T{_CLOCK}{_FRACTION}$", "yyyy-M-d'T'H:mm:ss"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}$", "yyyy-M-d H:mm"),
    (rf"^\d{{1,2}}/\d{{1,2}}/\d{{4}} {_CLOCK}$", "M/d/yyyy H:mm:ss"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "M/d/yyyy H:mm"),
)
# Names of months, and the separators of the pairs whose reading depends on convention.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
PAIRS = {"slash": "/", "dash": "-"}
MONTH_FIRST, DAY_FIRST = "$3-$1-$2", "$3-$2-$1"
_HOUR = r"(?:[01]?\d|2[0-3]):[0-5]\d"
_TIME = r"(?:[01]?\d|2[0-3]):[0-5]\d:[0-5]\d"
EPOCH = "1899-12-30"
FIRST_YEAR, LAST_YEAR = 1900, 2100


def _read(text: Column, shape: str, pattern: str) -> Column:
    return F.when(text.rlike(shape), F.try_to_timestamp(F.regexp_replace(text, r"\.\d+$", "") if _FRACTION in shape else text, F.lit(pattern)))


def compact_date(text: Column) -> Column:
    """Date of exactly eight digits yyyyMMdd."""
    bounded = text.rlike(r"^\d{8}$") & F.substring(text, 1, 4).between(str(FIRST_YEAR), str(LAST_YEAR))
    return F.when(bounded, F.regexp_replace(text, r"^(\d{4})(\d\d)(\d\d)$", "$1-$2-$3").try_cast("date"))


def serial_date(text: Column) -> Column:
    """Spreadsheet serial number of exactly five digits as a date."""
    epoch = datetime.date.fromisoformat(EPOCH)
    first, last = ((datetime.date(y, m, d) - epoch).days for y, m, d in ((FIRST_YEAR, 1, 1), (LAST_YEAR, 12, 31)))
    return F.when(text.rlike(r"^\d{5}$") & text.try_cast("int").between(first, last), F.date_add(F.lit(epoch), text.try_cast("int")))


def parse_date(c: Column) -> Column:
    """Date of a text in one of the formats of a typed column, else null; a time is dropped.

    Only eight digits and serials must lie in 1900 to 2100.
    """
    text = blank_to_null(c.cast("string"))
    iso = rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}(?: {_HOUR}(?::[0-5]\d{_FRACTION})?|T{_HOUR}:[0-5]\d{_FRACTION})?$"
    # as yyyy-M-d, which a cast reads without the cost of a failed parser
    day = F.when(text.rlike(iso), F.regexp_extract(text, "^[^ T]+", 0)).when(
        text.rlike(rf"^\d{{1,2}}(?:/\d{{1,2}}/\d{{4}}(?: {_HOUR}(?::[0-5]\d)?)?|-\d{{1,2}}-\d{{4}})$"), F.regexp_replace(text, r"^(\d+)[/-](\d+)[/-](\d+).*$", MONTH_FIRST))
    return F.coalesce(day.try_cast("date"), compact_date(text), serial_date(text))


def parse_timestamp(c: Column) -> Column:
    """Timestamp of a text with a time, or the start of its date; fractions to the microsecond."""
    text = blank_to_null(c.cast("string"))
    part = F.regexp_extract(text, r"\.(\d{1,6})\d*$", 1)
    micros = F.when(text.rlike(r":\d{2}\.\d+$"), F.rpad(part, 6, "0").try_cast("int")).otherwise(0)
    whole = F.coalesce(*[_read(text, shape, pattern) for shape, pattern in DATE_TIMES])
    return F.coalesce(F.timestamp_micros(F.unix_micros(whole) + micros), parse_date(c).cast("timestamp"))


def parse_any_date(c: Column, first: dict[str, str] | None = None, serials: bool = True) -> Column:
    """Date of a value of an untyped column, else null.

    `first` says for "slash" and "dash" which reading of a pair comes first; the other is tried after it.
    """
    return any_date(blank_to_null(c.cast("string")), first, serials)


def any_date(text: Column, first: dict[str, str] | None = None, serials: bool = True) -> Column:
    """parse_any_date of a text already stripped, which each shape looks at; give it a column, not an expression."""
    word = F.regexp_extract(text, "[A-Z][a-z]+", 0)
    number = F.greatest(*[F.array_position(F.array(*map(F.lit, names)), word) for names in (MONTHS, [m[:3] for m in MONTHS])])
    named = F.concat_ws("-", F.regexp_extract(text, r"\d{4}$", 0), number.cast("string"), F.regexp_extract(text, r"\b\d{1,2}\b", 0))
    iso = (  # texts as yyyy-M-d, which a cast reads without the cost of a failed parser
        F.when(text.rlike(rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}(?:[ T]{_TIME})?$"), F.regexp_extract(text, "^[^ T]+", 0))
        .when(text.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.translate(text, "/", "-"))
        .when(text.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), F.regexp_replace(text, r"^(\d+)\.(\d+)\.(\d+)$", DAY_FIRST))
        .when(text.rlike(r"^(?:\d{1,2} [A-Z][a-z]{2,8}|[A-Z][a-z]{2,8} \d{1,2}|[A-Z][a-z]{2} \d{1,2},) \d{4}$"), named))
    found = [iso.try_cast("date")]
    for name in PAIRS:
        for order in sorted((MONTH_FIRST, DAY_FIRST), key=lambda o: o != (first or {}).get(name, MONTH_FIRST)):  # noqa: B023
            found.append(pair_date(text, name, order))
    return F.coalesce(*found, compact_date(text), *([serial_date(text)] if serials else []))


def pair_date(text: Column, name: str, order: str) -> Column:
    """Date of a text such as 3/5/2024 (slash) or 3-5-2024 (dash) in the given order, else null."""
    shape = rf"^(\d{{1,2}}){PAIRS[name]}(\d{{1,2}}){PAIRS[name]}(\d{{4}})$"
    return F.when(text.rlike(shape), F.regexp_replace(text, shape, order).try_cast("date"))


def month(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def months_between(start: Column, end: Column) -> Column:
    """Array of the first days of all months from start's to end's; empty if they are the wrong way round."""
    days = F.sequence(F.trunc(start, "MM"), F.trunc(end, "MM"), F.expr("interval 1 month"))
    return F.when(F.trunc(start, "MM") > F.trunc(end, "MM"), F.array().cast("array<date>")).otherwise(days)


def period_type(start: Column, end: Column) -> Column:
    """MONTH if start and end are the first and last day of one month, else DATE_RANGE; null without both."""
    whole = (F.trunc(start, "MM") == start) & (F.last_day(start) == end)
    return F.when(start.isNotNull() & end.isNotNull(), F.when(whole, "MONTH").otherwise("DATE_RANGE"))
