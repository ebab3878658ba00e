"""What a file or column name says: its words, its months and years, its dates, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names as names of files and columns spell them.
MONTHS = {"january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4, "may": 5, "june": 6, "jun": 6, "july": 7, "jul": 7,
          "august": 8, "aug": 8, "september": 9, "sept": 9, "sep": 9, "october": 10, "oct": 10, "november": 11, "nov": 11, "december": 12, "dec": 12}
#: Years that a name may hold.
FIRST_YEAR, LAST_YEAR = 1900, 2099


def words(name: Column, short: dict[str, str] | None = None) -> Column:
    """The lower-cased words of a name, cut at other than letters and digits and where a small letter meets a capital.

    Words that `short` holds are spelled out, possibly as several. Null stays null, a name without words gives an empty array.
    """
    cut = F.regexp_replace(F.regexp_replace(name, r"(\p{Ll}|\d)(\p{Lu})", "$1 $2"), r"[^\p{L}\p{N}]+", " ")
    found = F.filter(F.split(F.lower(F.trim(cut)), " "), lambda w: w != "")
    if not short:
        return found
    table = F.create_map(*[F.lit(x) for pair in short.items() for x in pair])
    return F.flatten(F.transform(found, lambda w: F.split(F.coalesce(F.element_at(table, w), w), " ")))


def phrase(name: Column, short: dict[str, str] | None = None) -> Column:
    """The words of a name with one space between."""
    return F.array_join(words(name, short), " ")


def compact(name: Column, short: dict[str, str] | None = None) -> Column:
    """The words of a name without a gap."""
    return F.array_join(words(name, short), "")


def _pieces(name: Column) -> Column:
    """Lower-cased runs of letters and of digits, cut at capitals too."""
    cut = F.regexp_replace(F.regexp_replace(name, r"([a-z])([A-Z])", "$1 $2"), r"(?<=\d)(?=[A-Za-z])|(?<=[A-Za-z])(?=\d)|[^A-Za-z0-9]+", " ")
    return F.filter(F.split(F.lower(cut), " "), lambda w: w != "")


def months_in(name: Column) -> Column:
    """Numbers of the months that a name spells, in the order in which they stand; null stays null.

    A short month (and May) counts only beside a number or another month, or if the name holds nothing but months.
    """
    table = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    tokens = _pieces(name)
    month = lambda w: F.element_at(table, w)
    beside = lambda at: F.coalesce(F.get(tokens, at).rlike(r"^\d+$") | month(F.get(tokens, at)).isNotNull(), F.lit(False))
    alone = F.forall(tokens, lambda w: month(w).isNotNull())
    counts = lambda w, i: (F.length(w) > 3) | alone | beside(i - 1) | beside(i + 1)
    return F.filter(F.transform(tokens, lambda w, i: F.when(counts(w, i), month(w))), lambda m: m.isNotNull())


def years_in(name: Column) -> Column:
    """The four-digit years of a name, in the order in which they stand; longer runs of digits hold none."""
    found = F.transform(F.regexp_extract_all(name, F.lit(r"(?<!\d)(\d{4})(?!\d)"), 1), lambda y: y.cast("int"))
    return F.filter(found, lambda y: y.between(FIRST_YEAR, LAST_YEAR))


def _day(year: Column, month: Column, day: Column) -> Column:
    """The date of three texts of digits, or null if the calendar has none."""
    at = F.try_to_timestamp(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
    return F.when(F.year(at).between(FIRST_YEAR, LAST_YEAR), at)


def dates_in(name: Column) -> Column:
    """The full dates of a name in the order in which they stand, as an array of structs (day date, day_first boolean).

    Read are year-month-day, and month-day-year, also without separators (eight digits). If only the reading with the
    day before the month is a date, that one is taken and day_first is true. Digits that touch others are no date.
    """
    found = F.regexp_extract_all(name, F.lit(r"(?<!\d)(\d{4}[-_. ]\d{1,2}[-_. ]\d{1,2}|\d{1,2}[-_. ]\d{1,2}[-_. ]\d{4}|\d{8})(?!\d)"), 1)

    def read(token: Column) -> Column:
        spaced = F.when(token.rlike(r"^\d{8}$"), F.when(F.substring(token, 1, 4).cast("int").between(FIRST_YEAR, LAST_YEAR) & _day(F.substring(token, 1, 4), F.substring(token, 5, 2), F.substring(token, 7, 2)).isNotNull(),
                        F.concat_ws("-", F.substring(token, 1, 4), F.substring(token, 5, 2), F.substring(token, 7, 2))).otherwise(F.concat_ws("-", F.substring(token, 1, 2), F.substring(token, 3, 2), F.substring(token, 5, 4)))).otherwise(token)
        part = F.split(spaced, "[-_. ]")
        a, b, c = part[0], part[1], part[2]
        whole = F.length(a) == 4
        year, first, second = F.when(whole, a).otherwise(c), F.when(whole, b).otherwise(a), F.when(whole, c).otherwise(b)
        plain, turned = _day(year, first, second), _day(year, second, first)
        return F.struct(F.coalesce(plain, turned).alias("day"), (plain.isNull() & turned.isNotNull()).alias("day_first"))

    return F.filter(F.transform(found, read), lambda d: d["day"].isNotNull())


def received(name: Column) -> Column:
    """The last full date of a name, else the first day of its last month in its last year, else null."""
    found, months, years = dates_in(name), months_in(name), years_in(name)
    month = F.make_date(F.element_at(years, -1), F.element_at(months, -1), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1)["day"]).when((F.size(months) > 0) & (F.size(years) > 0), month)


def period_months(name: Column) -> Column:
    """First and last month that a name speaks of, as a struct (first int, last int), or null.

    Month names come first: from the first to the last, if in that order. Then halves (H1, H2), then quarters
    (Q1 to Q4), the first and last of them.
    """
    low, months = F.concat(F.lit(" "), F.array_join(_pieces(name), " "), F.lit(" ")), months_in(name)
    number = lambda pattern: F.transform(F.regexp_extract_all(low, F.lit(pattern), 0), lambda t: F.regexp_extract(t, r"(\d)", 1).cast("int"))
    halves, quarters = number(" (?:h [12]|[12] h)(?= )"), number(" q [1-4](?= )")
    pair = lambda a, b: F.struct(a.cast("int").alias("first"), b.cast("int").alias("last"))
    return (
        F.when((F.size(months) > 0) & (F.element_at(months, 1) <= F.element_at(months, -1)), pair(F.element_at(months, 1), F.element_at(months, -1)))
        .when(F.size(halves) > 0, pair(6 * F.array_min(halves) - 5, 6 * F.array_max(halves)))
        .when(F.size(quarters) > 0, pair(3 * F.array_min(quarters) - 2, 3 * F.array_max(quarters))))
