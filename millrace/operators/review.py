"""What a reviewer looks at: statuses, findings, schemas side by side, candidates, and tables as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import blank_to_null, code_number
from millrace.operators.joins import first_per_key

#: Fixed value: the most characters of a column's name.
LONGEST_NAME = 128


def status_counts(df: DataFrame, status: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), status).agg(F.count(F.lit(1)).alias("rows"))


def fitness(checks: DataFrame, passed: str, by: list[str]) -> DataFrame:
    """Per group the checks and the share of them that passed, in per cent; a check without a result isn't counted."""
    return checks.groupBy(*by).agg(F.count(passed).alias("checks"), F.round(F.avg(F.col(passed).cast("int")) * 100, 2).alias("fitness"))


def most_common(df: DataFrame, column: str, order: str, by: list[str]) -> DataFrame:
    """The value that most rows of a group hold; of equals the one that stands first in `order`. Nulls don't count."""
    times = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("times"), F.min(order).alias("_at"))
    return first_per_key(times, by, [F.desc("times"), F.col("_at"), F.col(column)]).drop("_at")


def null_findings(df: DataFrame) -> DataFrame:
    """column_name, nulls and rate of each column that holds nulls."""
    nulls = df.agg(F.count(F.lit(1)).alias("rows"), F.array(*[F.struct(F.lit(c).alias("column_name"), F.count_if(F.col(f"`{c}`").isNull()).alias("nulls")) for c in df.columns]).alias("p"))
    found = nulls.select("rows", F.explode("p").alias("p")).filter("p.nulls > 0")
    return found.select("p.column_name", "p.nulls", F.round(F.col("p.nulls") / F.col("rows"), 3).alias("rate"))


def append_report(tables: DataFrame) -> DataFrame:
    """Groups of tables(label, position, columns, rows) that hold the same column names, in any order.

    The group of most tables (of equals the one whose first table comes first) is the reference; missing and extra say
    how the others differ from it. Tables without rows are left out.
    """
    ordered = F.array_sort(F.collect_list(F.struct("position", "label", "columns")))  # a row per table
    groups = tables.filter("rows > 0").withColumn("names", F.array_sort("columns")).groupBy("names").agg(ordered.alias("t"), F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("n"))
    groups = groups.select(F.col("t.label").alias("labels"), F.col("t")[0]["columns"].alias("columns"), "rows", "n", F.col("t")[0]["position"].alias("at"))
    best = groups.agg(F.max_by("columns", F.struct("n", -F.col("at")))).first()[0] or []  # one row of names
    reference = F.array(*map(F.lit, best)).cast("array<string>")
    return groups.select(
        "labels", "columns", "rows", (F.col("n") > 1).alias("appended"), (F.array_sort("columns") == F.array_sort(reference)).alias("is_reference"),
        F.array_except(reference, F.col("columns")).alias("missing"), F.array_except(F.col("columns"), reference).alias("extra"))


def candidates(votes: DataFrame, of: list[str], target: str, score: str, least: float, margin: float) -> DataFrame:
    """The best target of each `of` at its best score, if that is at least `least` and leads the next target's by `margin`.

    Without a second target the lead is the score itself; equal scores have no lead, so that a margin above zero leaves them undecided.
    """
    best = votes.filter(F.col(score).isNotNull()).groupBy(*of, target).agg(F.max(score).alias(score))
    order = Window.partitionBy(*of).orderBy(F.desc(score), target)
    ranked = best.withColumn("_nth", F.row_number().over(order)).withColumn("lead", F.col(score) - F.coalesce(F.lead(score).over(order), F.lit(0)))
    return ranked.filter((F.col("_nth") == 1) & (F.col(score) >= least) & (F.col("lead") >= margin)).drop("_nth")


def divisions(facts: DataFrame, code: str, table: DataFrame) -> DataFrame:
    """facts with divisions: those that table(position, division, profit_center) gives the code, in table order.

    A sub-office has its centre's divisions; a code without any has an empty list.
    """
    centre = lambda c: F.substring_index(code_number(c), "_", 1)
    listed = table.select(centre(F.col("profit_center")).alias("_centre"), blank_to_null(F.col("division")).alias("division"), "position").filter("_centre IS NOT NULL AND division IS NOT NULL")
    listed = listed.groupBy("_centre", "division").agg(F.min("position").alias("position")).groupBy("_centre").agg(F.array_sort(F.collect_list(F.struct("position", "division")))["division"].alias("divisions"))
    out = facts.join(listed, centre(F.col(f"`{code}`").cast("string")) == F.col("_centre"), "left").drop("_centre")
    return out.withColumn("divisions", F.coalesce("divisions", F.array().cast("array<string>")))


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """df with new column names, all of them or none: ValueError for a blank, long or unprintable name, and for one that is there already, in any case."""
    clean = {old: new.strip() for old, new in names.items()}
    for new in clean.values():
        if not new or len(new) > LONGEST_NAME or any(ord(c) < 32 for c in new):
            raise ValueError(f"{new!r} can't name a column")
    if missing := set(clean) - set(df.columns):
        raise ValueError(f"no column {sorted(missing)}")
    final = [clean.get(c, c) for c in df.columns]
    if len({c.casefold() for c in final}) < len(final):
        raise ValueError("two columns would have the same name")
    return df.toDF(*final)


def without(df: DataFrame, columns: list[str]) -> DataFrame:
    """df without the columns; at least one must remain."""
    if not set(df.columns) - set(columns):
        raise ValueError("no column would remain")
    return df.drop(*columns)


def as_text(df: DataFrame) -> DataFrame:
    """Every column as text, dates as yyyy-MM-dd and timestamps to the second."""
    def text(c: str, kind: str) -> Column:
        value = F.col(f"`{c}`")
        return (F.date_format(value, "yyyy-MM-dd HH:mm:ss") if kind.startswith("timestamp") else value.cast("string")).alias(c)

    return df.select(*[text(*x) for x in df.dtypes])


def fill_mode(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """How many cells most rows of a group fill; of equally frequent numbers the larger. Empty rows don't count."""
    fill = sum(((blank_to_null(F.col(f"`{c}`").cast("string"))).isNotNull().cast("int") for c in columns), F.lit(0))
    times = df.select(*by, fill.alias("fill")).filter("fill > 0").groupBy(*by, "fill").agg(F.count(F.lit(1)).alias("times"))
    return times.groupBy(*by).agg(F.max(F.struct("times", "fill"))["fill"].alias("modal_fill"))
