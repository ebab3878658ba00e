"""Totals that stand among the data: columns, rows and running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.numbers import bare_number
from millrace.functions.text import blank_to_null

#: Least share of rows that a total column must agree on, and tolerances.
TOTAL_SHARE, TOLERANCE, RELATIVE = 0.95, 0.01, 1e-6
#: Fixed value: least share of a column's values that are numbers.
NUMERIC_SHARE = 0.95


def close(a: Column, b: Column) -> Column:
    """Equal within a cent, or a millionth of b."""
    return F.abs(a - b) <= F.greatest(F.lit(TOLERANCE), F.abs(b) * RELATIVE)


def total_columns(df: DataFrame, measures: list[str]) -> DataFrame:
    """Per measure: on what share of its rows it is the sum of all others, or of those before it, and is_total.

    Two or more measures must be added up, and two or more rows count: those that hold neither null nor zero.
    is_total marks the first measure that agrees on TOTAL_SHARE of its rows.
    """
    zero, parts = F.lit(0.0), []
    value = {m: F.coalesce(F.col(m).cast("double"), zero) for m in measures}
    for i, m in enumerate(measures):
        live = F.col(m).isNotNull() & (value[m] != 0)

        def share(of: list[str], live: Column = live, m: str = m) -> Column:
            agreed = F.count_if(live & close(sum((value[o] for o in of), zero), value[m])) / F.nullif(F.count_if(live), F.lit(0))
            return F.round(F.coalesce(F.when(F.count_if(live) >= 2, agreed), zero), 6) if len(of) >= 2 else zero

        parts.append(F.struct(F.lit(i).alias("place"), F.lit(m).alias("measure"), share([o for o in measures if o != m]).alias("of_others"), share(measures[:i]).alias("of_before")))
    found = df.agg(F.array(*parts).alias("p"))
    agrees = lambda p: F.greatest(p["of_others"], p["of_before"]) >= TOTAL_SHARE
    first = F.get(F.transform(F.filter("p", agrees), lambda p: p["place"]), F.lit(0))
    return found.select(F.explode("p").alias("p"), first.alias("first")).select("p.measure", "p.of_others", "p.of_before", F.coalesce(F.col("p.place") == F.col("first"), F.lit(False)).alias("is_total"))


def total_rows(df: DataFrame, group: list[str], order: str, measures: list[str]) -> DataFrame:
    """df with is_total: the last row of a group of 3 or more which, for every measure, is the sum of the group's others.

    Rows of zeros are none. Without `group` all rows are one group, of one sheet.
    """
    inside = Window.partitionBy(*group)
    values = {m: F.coalesce(F.col(m).cast("double"), F.lit(0.0)) for m in measures}
    agree = (F.count(F.lit(1)).over(inside) >= 3) & (sum((F.abs(v) for v in values.values()), F.lit(0.0)) > 0)
    for v in values.values():
        agree = agree & close(2 * v, F.sum(v).over(inside))
    mark = "_agrees"
    while mark in df.columns:
        mark = f"_{mark}"
    last = F.row_number().over(Window.partitionBy(*group, mark).orderBy(F.desc(order))) == 1
    return df.withColumn(mark, agree).withColumn("is_total", F.col(mark) & last).drop(mark)


def grain(df: DataFrame, columns: list[str], group: list[str], order: str, keyed: bool = False, dated: bool = False, numeric: float = NUMERIC_SHARE) -> DataFrame:
    """Whether a table of texts holds aggregated figures: one row of evidence and the decision.

    A column is a measure if `numeric` of its filled values are numbers; a currency mark makes a value none. Totals are a total column or total rows; the table is aggregated if it has
    totals, as many measures as other columns or more, no key (`keyed`) and no date in every row (`dated`).
    """
    filled = lambda c: blank_to_null(F.col(f"`{c}`").cast("string"))
    shares = df.agg(*[(F.count(bare_number(filled(c))) / F.nullif(F.count(filled(c)), F.lit(0))).alias(c) for c in columns]).first()
    measures = [c for c in columns if (shares[c] or 0) >= numeric]
    typed = df.select(*[F.col(f"`{g}`") for g in dict.fromkeys([*group, order]) if g not in measures], *[bare_number(filled(c)).alias(c) for c in measures])
    total = [r["measure"] for r in total_columns(typed, measures).filter("is_total").collect()] if measures else []  # a row per measure
    plain = [m for m in measures if m not in total]
    rows = total_rows(typed, group, order, plain).agg(F.count_if("is_total").alias("total_rows")) if plain else df.limit(0).agg(F.count(F.lit(1)).alias("total_rows"))
    heavy, some = bool(measures) and len(measures) >= len(columns) - len(measures), F.lit(bool(total)) | (F.col("total_rows") > 0)
    return rows.select(
        F.lit(len(measures)).alias("measures"), F.lit(len(columns) - len(measures)).alias("dimensions"), F.lit(total[0] if total else None).cast("string").alias("total_column"), "total_rows",
        some.alias("totals"), F.lit(heavy).alias("mostly_amounts"), (some & F.lit(heavy and not keyed and not dated)).alias("aggregated"))


def running_check(df: DataFrame, within: list[str], order: list[str], value: str) -> DataFrame:
    """df with sum_before, the sum of the rows above in the group, and is_subtotal: the row states that sum."""
    above = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.sum(F.col(value).cast("decimal(28,2)")).over(above).cast("decimal(28,2)")
    return df.withColumn("sum_before", before).withColumn("is_subtotal", F.coalesce(F.abs(F.col(value) - F.col("sum_before")) <= TOLERANCE, F.lit(False)))


def accounting(source: DataFrame, removed: DataFrame, kept: DataFrame, by: list[str]) -> DataFrame:
    """Per group: rows of the source, rows removed and kept, and what isn't accounted for. The three tables are counted on their own."""
    sides = [t.select(*by, *[F.lit(int(n == i)).cast("long").alias(c) for i, c in enumerate(("raw", "removed", "kept"))]) for n, t in enumerate((source, removed, kept))]
    counts = sides[0].unionByName(sides[1]).unionByName(sides[2]).groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("raw", "removed", "kept")])
    return counts.withColumn("unaccounted", F.col("raw") - F.col("removed") - F.col("kept"))
