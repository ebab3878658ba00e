"""Column profiles, date statistics and roles of tables, each from one pass of aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
DIMENSION_MAX_ROWS, KEY_DISTINCT_RATIO = 200, 0.9


def is_numeric(kind: str) -> bool:
    return kind.startswith(NUMERIC)


def plain(number: Column) -> Column:
    """A decimal as text without trailing zeros; 100 stays 100."""
    text = number.cast("string")
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def distinct_counts(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """by, column_name and distinct_count: how many different values each column holds, nulls aside.

    Values are counted in long form, pre-aggregated in each task: rows aren't multiplied by the number of aggregates.
    """
    kinds = dict(df.dtypes)
    text = lambda c: (F.col(f"`{c}`") + 0.0 if kinds[c] in ("double", "float") else F.col(f"`{c}`")).cast("string")
    parts = F.array(*[F.struct(F.lit(c).alias("column_name"), text(c).alias("value")) for c in columns])
    values = df.select(*by, F.explode(parts).alias("p")).select(*by, "p.*").filter("value IS NOT NULL").distinct()
    return values.groupBy(*by, "column_name").agg(F.count(F.lit(1)).alias("distinct_count"))


def column_profile(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per column (and group of `by`): distinct, present and all values, null share, extremes, exact sum.

    Plain aggregates of all columns come from one pass, the row of results is then turned into rows; distinct values are counted apart.
    Extremes and sums are texts, NA where they don't apply; sums are exact, of the values as written.
    """
    by, kinds = by or [], dict(df.dtypes)
    columns = [c for c in df.columns if c not in by]
    parts = []
    for c in columns:
        v = F.col(f"`{c}`")
        total = plain(F.sum(v.cast("string").try_cast("decimal(38,6)"))) if is_numeric(kinds[c]) else F.lit("NA")
        low, high = (F.min(v).cast("string"), F.max(v).cast("string"))
        if kinds[c] in ("double", "float"):
            low, high = plain(F.min(v).cast("decimal(38,6)")), plain(F.max(v).cast("decimal(38,6)"))
        parts.append(F.struct(
            F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("datatype"), F.count(v).alias("present"),
            F.count(F.lit(1)).alias("total"), F.coalesce(low, F.lit("NA")).alias("low"), F.coalesce(high, F.lit("NA")).alias("high"), F.coalesce(total, F.lit("NA")).alias("sum"),
            F.format_string("%.2f", F.when(F.count(F.lit(1)) > 0, (F.count(F.lit(1)) - F.count(v)) * 100.0 / F.count(F.lit(1))).otherwise(0.0).cast("double")).alias("null_percentage")))
    wide = df.groupBy(*by).agg(F.array(*parts).alias("p")) if by else df.agg(F.array(*parts).alias("p"))
    long = wide.select(*by, F.explode("p").alias("p")).select(*by, "p.*")
    counts = distinct_counts(df, columns, by).select(*[F.col(c).alias(f"_{c}") for c in by], F.col("column_name").alias("_column"), "distinct_count")
    on = (F.col("column_name") == F.col("_column"))
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return long.join(counts, on, "left").select(*by, "column_name", "datatype", F.coalesce("distinct_count", F.lit(0)).alias("distinct_count"), "present", "total", "low", "high", "sum", "null_percentage")


def date_stats(df: DataFrame, roles: dict[str, Column]) -> DataFrame:
    """Per date role: rows, populated (readable dates), invalid, first, last and share readable; roles map a name to raw text.

    A value is invalid if it is there but no date can be read from it.
    """
    from millrace.functions.dates import parse_date
    from millrace.functions.text import blank_to_null

    parts = []
    for name, raw in roles.items():
        value, day = blank_to_null(raw.cast("string")), parse_date(raw)
        parts.append(F.struct(
            F.lit(name).alias("role"), F.count(F.lit(1)).alias("rows"), F.count(day).alias("populated"), F.count_if(value.isNotNull() & day.isNull()).alias("invalid"),
            F.date_format(F.min(day), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max(day), "yyyy-MM-dd").alias("last_day"),
            F.round(F.count(day) * 100.0 / F.greatest(F.count(F.lit(1)), F.lit(1)), 2).cast("double").alias("readable")))
    return df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def month_stats(df: DataFrame, month: Column, roles: dict[str, Column]) -> DataFrame:
    """Per month: rows, and the share of rows with a readable date in each role, in per cent. Rows without a month are left out."""
    shares = [F.round(F.avg(day.isNotNull().cast("int")) * 100, 2).alias(name) for name, day in roles.items()]
    return df.groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("rows"), *shares).filter("month IS NOT NULL")


def role_evidence(df: DataFrame) -> DataFrame:
    """One row of counts that say whether a table is a fact or a dimension table.

    A column of two values or more is a measure if it is numeric and has fractions, negative values or repeats (less than KEY_DISTINCT_RATIO of
    its values are distinct), and a key if its values are nearly all distinct. unique says whether no row repeats.
    """
    kinds = dict(df.dtypes)
    columns = [c for c in df.columns if not kinds[c].startswith(("map", "binary"))]
    fine = lambda c: F.coalesce(F.bool_or((F.col(f"`{c}`") % 1 != 0) | (F.col(f"`{c}`") < 0)), F.lit(False)) if is_numeric(kinds[c]) else F.lit(False)
    parts = [F.struct(F.lit(c).alias("column_name"), F.lit(is_numeric(kinds[c])).alias("numeric"), F.count(F.col(f"`{c}`")).alias("present"), fine(c).alias("fine")) for c in columns]
    plain_ = df.agg(F.count(F.lit(1)).alias("rows"), F.array(*parts).alias("p")).select("rows", F.explode("p").alias("p")).select("rows", "p.*")
    held = plain_.join(distinct_counts(df, columns, []).withColumnRenamed("column_name", "_column"), F.col("column_name") == F.col("_column"), "left")
    near = F.coalesce("distinct_count", F.lit(0)) >= KEY_DISTINCT_RATIO * F.col("present")
    several = F.col("present") >= 2
    repeats = df.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n") == 1, F.lit(True)).alias("unique_rows"))
    dates = sum(k in ("date", "timestamp", "timestamp_ntz") for k in kinds.values())
    found = held.agg(F.max("rows").alias("rows"), F.count_if(several & F.col("numeric") & (F.col("fine") | ~near)).alias("measures"), F.count_if(several & near).alias("keys"), F.lit(dates).cast("long").alias("dates"))
    return found.join(F.broadcast(repeats))  # one row and one row


def role(rows: Column, measures: Column, keys: Column, dates: Column, unique: Column) -> Column:
    """FACT: measures and a key or a date. DIMENSION: no measure, no repeated row, a key and DIMENSION_MAX_ROWS rows at most. Else UNKNOWN."""
    fact = (measures > 0) & ((keys > 0) | (dates > 0))
    lookup = (measures == 0) & unique & (rows <= DIMENSION_MAX_ROWS) & (keys > 0)
    return F.when(rows == 0, "UNKNOWN").when(fact, "FACT").when(lookup, "DIMENSION").otherwise("UNKNOWN")


def unreadable(pairs: dict[str, tuple[Column, Column]]) -> Column:
    """Array of the names whose raw value is there but whose typed value is null."""
    return F.array_compact(F.array(*[F.when(raw.isNotNull() & typed.isNull(), F.lit(name)) for name, (raw, typed) in pairs.items()]))


def empty_columns(df: DataFrame) -> DataFrame:
    """column_name of each column without any value."""
    parts = [F.when(F.count(c) == 0, F.lit(c)) for c in df.columns]
    return df.agg(F.array_compact(F.array(*parts)).alias("c")).select(F.explode("c").alias("column_name"))


def duplicate_keys(df: DataFrame, keys: list[str], most: int | None = 20) -> DataFrame:
    """Repeated keys and how often they stand, most frequent first; the report shows the first `most`."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("times")).filter((F.col("times") > 1) & ~F.exists(F.array(*[F.col(k).isNull() for k in keys]), lambda x: x))
    ranked = counts.orderBy(F.desc("times"), *keys)
    return ranked if most is None else ranked.limit(most)
