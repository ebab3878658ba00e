"""Monthly roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def monthly(df: DataFrame, keys: list[str], date: str, sums: dict[str, str], distinct: dict[str, str], latest: dict[str, str]) -> DataFrame:
    """One row per keys and month of `date`; a null month is a group of its own.

    sums, distinct and latest name the output of each summed, distinctly counted and
    maximised column.
    """
    measures: list[Column] = [F.sum(c).alias(out) for c, out in sums.items()]
    measures += [F.count_distinct(c).alias(out) for c, out in distinct.items()]
    measures += [F.max(c).alias(out) for c, out in latest.items()]
    return df.withColumn("month", F.date_format(F.trunc(date, "MM"), "yyyy-MM-dd")).groupBy(*keys, "month").agg(*measures)


def replace_groups(old: DataFrame, new: DataFrame, source: str, value: str) -> DataFrame:
    """old without the rows of one source, then new: delete and insert of a rebuilt roll-up."""
    return old.filter(~F.col(source).eqNullSafe(value)).unionByName(new, allowMissingColumns=True)
