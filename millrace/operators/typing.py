"""Types of columns of text, decided from their values: evidence, a decision, one projection.

The decision is a small table, a row per column; the rows are read twice, for evidence and for the projection, and never leave the tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.dates import DAY_FIRST, MONTH_FIRST, PAIRS, any_date, pair_date
from millrace.functions.headers import names_date, names_identifier
from millrace.functions.numbers import EU_ONLY, US_ONLY, any_number
from millrace.functions.text import blank_to_null

# Shares of values that make a column one of dates or numbers, of distinct values that make a code, the
# rows beyond which same-width numbers are codes, and the serials of the days of 1900 to 2100.
DATE_SHARE, NUMERIC_SHARE, CODE_SHARE, CODE_ROWS = 0.6, 0.6, 0.9, 10
SERIALS = (2, 73415)
# Texts that stand for themselves alone, since what they are depends on their very digits: whatever is shaped like a date, powers of
# ten, and numbers so long that a double may round them. Of all others only places of digits, zeros, letters and marks count.
ITSELF = (
    r"^(?:\d{1,4}([-/.])\d{1,2}\1\d{1,4}(?:[ T][\d:]+)?|(?:\d{1,2} [A-Z][a-z]{2,8}|[A-Z][a-z]{2,8} \d{1,2},?) \d{4}|(?:19\d\d|20\d\d|2100)(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])"
    r"|[^A-Za-z]*[Ee][^A-DF-Za-df-z]*|(?=[\s\S]{16})[^A-Za-z]*[.,][^A-Za-z]*|(?=[\s\S]{300})[^A-Za-z]*)$")
_CAPITALS = "ABCDFGHIJKLMNOPQRSTUVWXYZ"
_ALIKE = "23456789" + _CAPITALS[1:] + _CAPITALS.lower()[1:], "1" * 8 + "A" * 24 + "a" * 24


def alike(v: Column) -> Column:
    """A text of which every count of evidence() says what it says of v: digits are 1 or 0, letters but for E are A or a, where no more matters."""
    return F.when(v.rlike(ITSELF), v).otherwise(F.translate(v, *_ALIKE))


def evidence(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: counts of what its filled values look like.

    Values are counted first, in the tasks and then by one exchange; then those that are alike() are counted together, so that a column of
    keys or amounts is parsed in as many texts as it has shapes, not values. Columns without values, of an empty table too, have counts of zero.
    """
    values = F.array(*[F.struct(F.lit(i).alias("at"), blank_to_null(F.col(f"`{c}`").cast("string")).alias("v")) for i, c in enumerate(columns)])
    each = df.select(F.explode(values).alias("p")).select("p.at", "p.v").filter("v IS NOT NULL").groupBy("at", "v").agg(F.count(F.lit(1)).alias("n"))
    day_serial = F.col("v").rlike(r"^\d{5}$") & F.col("v").try_cast("int").between(*SERIALS)
    shapes = each.groupBy("at", alike(F.col("v")).alias("v"), day_serial.alias("day_serial")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("values"))
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "at int, column_name string")
    every = names.join(tally(shapes), "at", "left").drop("at")
    return every.fillna(0, [c for c, kind in every.dtypes if kind == "bigint"])


def tally(counted: DataFrame) -> DataFrame:
    """The counts of evidence() of counted(at, v, day_serial, n, values): a text v that stands n times in column `at`, for so many distinct values, and whether they are the serials of days."""
    v, core, serial = F.col("v"), F.regexp_replace("v", r"[^\d.,-]", ""), F.col("v").rlike(r"^\d{5}$")
    read = counted.select("at", "v", "day_serial", "n", "values", core.alias("core"), any_date(v, serials=False).alias("day"), any_number(v).alias("us"), any_number(v, european=True).alias("eu"))
    day, us, eu, digits = F.col("day"), F.col("us"), F.col("eu"), v.rlike(r"^\d+$")
    letters = v.rlike("[A-Za-z]") & v.rlike(r"\d") & ~v.rlike(r"^[+-]?[\d.]+[eE][+-]?\d+$")
    joined = v.rlike(r"^\d+(?:[-/ ]\d+)+$") & ~v.rlike(r"^\d{1,3}(?: \d{3})+$")
    risky = v.rlike(r"\d") & ~v.rlike(r"^[0.,\s-]*$")
    pairs = {f"{name}_{order}": pair_date(v, name, pattern).isNotNull() for name in PAIRS for order, pattern in (("month_first", MONTH_FIRST), ("day_first", DAY_FIRST))}
    tests = {
        "present": F.lit(True), "dates": day.isNotNull(), "eight_digits": v.rlike(r"^\d{8}$"), "serials": serial, "day_serials": F.col("day_serial"), "digits": digits, "leading_zero": v.rlike(r"^0\d+$"),
        "codes": (letters | joined) & day.isNull(), "us_numbers": us.isNotNull(), "eu_numbers": eu.isNotNull(), "us_votes": F.col("core").rlike(US_ONLY), "eu_votes": F.col("core").rlike(EU_ONLY),
        "us_fractions": us % 1 != 0, "eu_fractions": eu % 1 != 0, "us_losses": risky & us.isNull(), "eu_losses": risky & eu.isNull(), "date_losses": risky & day.isNull() & ~serial} | pairs
    width = F.when(digits, F.length(v))
    return read.groupBy("at").agg(
        *[F.sum(F.when(held, F.col("n")).otherwise(0)).alias(k) for k, held in tests.items()],
        F.min(width).alias("least_width"), F.max(width).alias("most_width"), F.sum("values").alias("distinct_values"))


def decide(found: DataFrame) -> DataFrame:
    """found with kind (string, date, long or double), european, how pairs of a date read, and a note.

    In this order: empty columns are strings; five digits that are all serials of days are dates if the header names one; eight digits that are all dates are dates unless the header names an identifier; codes and leading zeros keep
    a column text, and so do all-different numbers of one width in more than CODE_ROWS rows; DATE_SHARE of dates make dates
    (serials count if something else parsed), NUMERIC_SHARE of numbers make numbers. A column whose type would lose a
    value that holds a digit, zeros aside, stays text.
    """
    n, col = F.col("present"), F.col
    numbers = lambda convention: F.when(col("european"), col(f"eu_{convention}")).otherwise(col(f"us_{convention}"))
    found = found.withColumn("european", col("eu_votes") > col("us_votes"))
    uniform = (col("digits") == n) & (n >= 3) & (col("least_width") == col("most_width")) & (col("least_width") >= 3) & (col("distinct_values") >= CODE_SHARE * n)
    whole = (col("digits") == n) & (col("eight_digits") == n) & (col("dates") == n)
    dated_header = names_date(col("column_name"))
    named = names_identifier(col("column_name")) & ~dated_header
    dated = F.when(col("dates") > col("eight_digits"), col("dates") + col("serials")).otherwise(col("dates"))
    numeric = F.when(numbers("losses") > 0, "would lose values").when(numbers("fractions") > 0, "double").otherwise("long")
    said = (
        F.when(n == 0, "empty").when((col("day_serials") == n) & dated_header, "date").when(whole & named, "named identifier").when(whole, "date")
        .when((col("codes") > 0) & (numbers("numbers") >= NUMERIC_SHARE * n), "codes").when((col("digits") == n) & (col("leading_zero") > 0), "leading zero")
        .when(uniform & (n > CODE_ROWS), "same width").when((dated >= DATE_SHARE * n) & (col("digits") < n), F.when(col("date_losses") > 0, "would lose values").otherwise("date"))
        .when(numbers("numbers") >= NUMERIC_SHARE * n, numeric).otherwise("text"))
    found = found.withColumn("note", said)
    order = lambda name: F.when(col(f"{name}_day_first") > col(f"{name}_month_first"), DAY_FIRST).otherwise(MONTH_FIRST)
    kind = F.when(col("note").isin("date", "long", "double"), col("note")).otherwise("string")
    return found.withColumns({"kind": kind, **{name: order(name) for name in PAIRS}})


def typed(df: DataFrame, decided: DataFrame) -> DataFrame:
    """df with each decided column in its type; values that can't be read, which hold no digit but zeros, are null. Other columns stay."""
    rules = {r["column_name"]: r for r in decided.select("column_name", "kind", "european", *PAIRS).collect()}  # a row per column

    def cast(c: str) -> Column:
        rule, text = rules.get(c), F.col(f"`{c}`")
        if rule is None or rule["kind"] == "string":
            return text
        if rule["kind"] == "date":
            return any_date(text, {name: rule[name] for name in PAIRS}).alias(c)
        return any_number(text, rule["european"]).cast(rule["kind"]).alias(c)

    # stripped in a projection of its own, which stays one since the next looks at each text many times
    stripped = df.select(*[blank_to_null(F.col(f"`{c}`").cast("string")).alias(c) if c in rules else F.col(f"`{c}`") for c in df.columns])
    return stripped.select(*[cast(c) for c in df.columns])
