"""Stated cases of what names say."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from millrace.functions import names

DAY = datetime.date


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_words(spark):
    short = {"eff": "effective", "pc": "profit center"}
    assert column(spark, ["Eff_Date", "PC no.", "", None, "--"], lambda c: names.words(c, short)) == [["effective", "date"], ["profit", "center", "no"], [], None, []]
    assert column(spark, ["Eff Date", None], lambda c: names.phrase(c, short)) == ["effective date", None]
    assert column(spark, ["Eff Date", "eff-date"], names.compact) == ["effdate", "effdate"]


def test_months_and_years(spark):
    assert column(spark, ["JanJun2025", "Sales March 2024", "SEP Plans", "Sep 2025", "May", "Dec Adj", "", None, "Sept"], names.months_in) == [[1, 6], [3], [], [9], [5], [], [], None, [9]]
    assert column(spark, ["a2024b 1999", "20245", "1850", None], names.years_in) == [[2024, 1999], [], [], None]
    assert column(spark, ["JanJun2025", "Q2 2024", "1H25", "h2", "Jul", "q 3", "none", None], lambda c: names.period_months(c)) == [(1, 6), (4, 6), (1, 6), (7, 12), (7, 7), (7, 9), None, None]


def test_dates(spark):
    cases = ["x 2024-03-05", "20260713", "07132026", "13072026", "a 1.2.2024 b 25-12-2023", "2024-13-45", "March 2024", "120260713", "", None]
    assert column(spark, cases, names.received) == [DAY(2024, 3, 5), DAY(2026, 7, 13), DAY(2026, 7, 13), DAY(2026, 7, 13), DAY(2023, 12, 25), None, DAY(2024, 3, 1), None, None, None]
