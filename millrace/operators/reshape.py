"""Unpivoting, stacking and schema evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def melt(df: DataFrame, ids: list[str], values: list[str], name: str = "category", value: str = "value", labels: dict[str, str] | None = None) -> DataFrame:
    """One row per filled cell of the value columns; labels give the headers as written."""
    long = df.unpivot(ids, values, name, value).dropna(subset=[value])
    return long.replace(labels, subset=[name]) if labels else long


def spread(df: DataFrame, ids: list[str], name: str, names: list[str], value: str) -> DataFrame:
    """One row per ids, with the sum of value in a column for each of the names: the reverse of melt(). Other names are left out."""
    return df.groupBy(*ids).pivot(name, names).agg(F.sum(value))


def stack(tables: dict[str, DataFrame]) -> DataFrame:
    """All tables under one another, in the first one's column order, with the table's name as source_sheet.

    Their column sets must be equal. Repeated rows stay.
    """
    first = next(iter(tables.values()))
    if any(set(t.columns) != set(first.columns) for t in tables.values()):
        raise ValueError("the tables differ in their columns")
    out = None
    for sheet, t in tables.items():
        part = t.select(F.lit(sheet).alias("source_sheet"), *first.columns)
        out = part if out is None else out.unionByName(part)
    return out


def stack_parts(df: DataFrame, part: str, unnamed: str) -> DataFrame:
    """Tables that lie in one, told apart by a column, as stack() would give them: source_sheet, which is `unnamed` for null, and the other columns."""
    return df.select(F.coalesce(F.col(f"`{part}`").cast("string"), F.lit(unnamed)).alias("source_sheet"), *[F.col(f"`{c}`") for c in df.columns if c != part])


def compare_schemas(table: list[str], incoming: list[str]) -> str:
    """identical, reordered, evolved (any name is shared) or different."""
    if table == incoming:
        return "identical"
    if set(table) == set(incoming):
        return "reordered"
    return "evolved" if set(table) & set(incoming) else "different"


def evolve(table: DataFrame, incoming: DataFrame) -> DataFrame:
    """table with the rows of incoming; its columns first, new ones after them, missing ones null."""
    return table.unionByName(incoming, allowMissingColumns=True)


def supersede(table: DataFrame, load: str, replaced: list, incoming: DataFrame) -> DataFrame:
    """table without the replaced loads, and incoming; rows of a null load stay."""
    return table.filter(~F.coalesce(F.col(load).isin(replaced), F.lit(False))).unionByName(incoming, allowMissingColumns=True)


def drop_months(table: DataFrame, load: str, loads: list, month: str, months: list[str]) -> DataFrame:
    """table without the given months of the given loads; rows of a null month stay."""
    gone = F.coalesce(F.col(load).isin(loads) & F.col(month).isin(months), F.lit(False))
    return table.filter(~gone)


def fill_down(df: DataFrame, column: str, order: list[str], within: list[str] | None = None) -> DataFrame:
    """column with each null replaced by the last value above it, in order, inside each group of `within`.

    Without `within` all rows are ordered in one task: only for one sheet's rows.
    """
    window = Window.partitionBy(*(within or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(window))


def islands(df: DataFrame, position: str, within: list[str]) -> DataFrame:
    """Runs of consecutive positions inside each group: island number, first, last and size."""
    run = F.col(position) - F.row_number().over(Window.partitionBy(*within).orderBy(position))
    runs = df.withColumn("_run", run).groupBy(*within, "_run").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count(F.lit(1)).alias("size"))
    return runs.withColumn("island", F.row_number().over(Window.partitionBy(*within).orderBy("first"))).drop("_run")
