"""Cases in which values, headers and names decide what a column is."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.functions import headers, names, numbers
from millrace.operators import joins, reshape, totals, typing


def column(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def decided(spark, header, values):
    df = spark.createDataFrame([(v,) for v in values], "v string").withColumnRenamed("v", header)
    return typing.decide(typing.evidence(df, [header])).first()


DATES = ["CreatedAt", "Txn Dt", "posted_on", "due", "Fecha", "created", "expiry", "TxnDate", "birthday"]
NO_DATES = ["rate", "status", "bandwidth", "update_count", "created_by", "candidate", "location", None, ""]
IDS = ["PolicyNo", "account_number", "ZipCode", "Order", "invoice", "SKU", "regnbr", "ref"]
NO_IDS = ["piano", "valid", "amount", "notes", None]


def test_headers(spark):
    assert column(spark, headers.names_date, DATES + NO_DATES) == [True] * len(DATES) + [False] * len(NO_DATES)
    assert column(spark, headers.names_identifier, IDS + NO_IDS) == [True] * len(IDS) + [False] * len(NO_IDS)


@pytest.mark.parametrize(("header", "kind"), [("account_number", "string"), ("Order", "string"), ("TxnDate", "date"), ("Value", "date"), ("invoice date", "date")])
def test_eight_digits_follow_the_header(spark, header, kind):
    assert decided(spark, header, ["20240101", "20240215", "20240330"])["kind"] == kind


@pytest.mark.parametrize(("header", "values", "kind"), [
    ("due date", ["45000", "45001", "45002"], "date"), ("zip", ["45000", "45001", "45002"], "long"), ("due date", ["45000", "99999"], "long"), ("due date", ["45000", "4500"], "long")])
def test_serials_follow_the_header(spark, header, values, kind):
    assert decided(spark, header, values)["kind"] == kind


def test_votes_for_a_decimal_mark(spark):
    us = ["1,234.5", "1,234,567", ".5", "12.5", "1.2345", "-3.25", "1,234,567.1"]
    both = ["1,234", "1.234", "1234", "1234.567", "1234,567", "", "1,23,456"]
    swap = lambda v: v.translate(str.maketrans(",.", ".,"))
    assert column(spark, lambda c: c.rlike(numbers.US_ONLY), us + both) == [True] * len(us) + [False] * len(both)
    assert column(spark, lambda c: c.rlike(numbers.EU_ONLY), [*map(swap, us), *both]) == [True] * len(us) + [False] * len(both)
    assert decided(spark, "amount", ["1.234,56", "2.500,00", "99,5"])["european"] and not decided(spark, "amount", ["1,234", "2,500", "3,750"])["european"]


def test_numbers_of_sheets(spark):
    given = ["(250)", "250-", "500 -", "(-5)", "--5", "(250-)", "-250-", "$ 1,234.50", "1,23", "5.", ".5", ".", "1e3", "(1,000.5)", "12%", "x", None]
    assert column(spark, numbers.clean_number, given) == [-250.0, -250.0, -500.0, None, None, None, None, 1234.5, None, 5.0, 0.5, None, 1000.0, -1000.5, 12.0, None, None]
    assert column(spark, numbers.bare_number, ["$4.00", "1,234.5", " 7 ", "4%", "", None]) == [None, 1234.5, 7.0, None, None, None]


def test_measures_need_nineteen_in_twenty_numbers(spark):
    rows = [(str(i), f"{i}.5" if i >= few else "n/a", "x") for few in [2] for i in range(20)]
    df = spark.createDataFrame(rows, "line string, value string, name string")
    assert totals.grain(df, ["value", "name"], [], "line").first()["measures"] == 0
    assert totals.grain(df.filter("line <> '1'").union(df.filter("line = '5'")), ["value", "name"], [], "line").first()["measures"] == 1


def test_years_of_names_end_with_2099(spark):
    assert column(spark, names.years_in, ["a 1900 2099", "2100 1899", None]) == [[1900, 2099], [], None]


def test_joins_of_columns_that_clash_with_their_own_names(spark):
    left = spark.createDataFrame([(1, "a", "p", 5)], "_right_0 int, k string, _pair string, `l.x` int")
    right = spark.createDataFrame([("A", "p", 7), ("a", "q", 8)], "k string, _pair string, _rank int")
    for how, n in (("left", 2), ("inner", 2), ("right", 2)):
        found = joins.companion_join(left, right, [("k", "k")], "r", how)
        assert found.count() == n and not any(c.startswith("__") for c in found.columns)
    assert joins.companion_join(left, right, [("k", "k")], "r", pair="_pair").select("`r._rank`").collect() == [(7,)]
    assert joins.first_per_key(right, [F.lower("k")], [F.desc("_rank")]).collect()[0]["_rank"] == 8


def test_stacked_tables_keep_their_names_rows_and_columns(spark):
    one = spark.createDataFrame([(1, "a"), (1, "a")], "id int, x string")
    other = spark.createDataFrame([("b", 2)], "x string, id int")
    stacked = reshape.stack({"p": one, "q": other})
    assert stacked.columns == ["source_sheet", "id", "x"] and sorted(map(tuple, stacked.collect())) == [("p", 1, "a"), ("p", 1, "a"), ("q", 2, "b")]
    with pytest.raises(ValueError, match="differ"):
        reshape.stack({"p": one, "q": other.drop("x")})
    held = spark.createDataFrame([(1, "a", "p"), (2, "b", None)], "id int, x string, sheet string")
    assert sorted(map(tuple, reshape.stack_parts(held, "sheet", "none").collect())) == [("none", 2, "b"), ("p", 1, "a")]


ODD = [
    "5", "05", "0", "00000", "00001", "00002", "45000", "73415", "73416", "08085", "20240131", "20240231", "18991231", "21001231", "21011231", "98765432", "1,234.50", "1,000.00", "1.234,50", "1.234", "1,234", "-3.25", "(250)", "250-", "--5", "1,23", "12%",
    "0.0", "-0.00", "0,0", "10.0000", "1.25e1", "1.25e2", "2E3", "e", "E5", "9e999", "9007199254740993.5", "123456789012.345", "9" * 309, "9" * 18, "0.00000000000000000007", "2024-02-30", "2024-2-3", "0000-00-00", "2024-02-03 10:11:12",
    "2024-02-03T25:00:00", "2024/13/1", "31.12.2024", "32.12.2024", "13/02/2024", "02/13/2024", "13-13-2024", "3 Mar 2024", "3 Mai 2024", "March 3 2024", "Mar 3, 2024", "3 Sept 2024", "12AB", "Texas 7", "59808-1658", "10 000", "555 12 99", "n/a", "Ünal 5", "٣٤", "$1 234", "1 e 5", "a\n7", "1\n2"]


def test_texts_that_are_alike_count_alike(spark):
    rows = spark.createDataFrame(list(enumerate(ODD)), "at int, v string")
    serial = F.col("v").rlike(r"^\d{5}$") & F.col("v").try_cast("int").between(*typing.SERIALS)
    plain = rows.select("at", "v", serial.alias("day_serial"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("values"))
    plain_counts, counts = (sorted(map(tuple, typing.tally(t).collect())) for t in (plain, plain.withColumn("v", typing.alike(F.col("v")))))
    assert [(ODD[a[0]], a) for a in plain_counts] == [(ODD[b[0]], b) for b in counts] and len(counts) == len(ODD)


def test_keys_and_amounts_are_parsed_by_shape(spark):
    rows = spark.range(20000).select(F.col("id").cast("string").alias("key"), F.concat("id", F.lit(".5")).alias("amount"), F.concat(F.lit("C-"), "id").alias("account"), F.lpad("id", 5, "0").alias("zip"))
    assert rows.select(F.explode(F.array(*[typing.alike(F.col(c)) for c in rows.columns]))).distinct().count() < 200
    found = {r.column_name: r for r in typing.evidence(rows, rows.columns).collect()}
    assert [(found[c].present, found[c].distinct_values) for c in rows.columns] == [(20000, 20000)] * 4
    assert (found["zip"].serials, found["zip"].day_serials, found["key"].us_fractions, found["amount"].us_fractions, found["account"].codes) == (20000, 19998, 0, 20000, 20000)


def test_typed_columns_strip_each_text_once(spark):
    rows = spark.createDataFrame([(" 1.5 ", "(2,500)"), ("3", "7-"), (" ", None)], "a string, b string")
    out = typing.typed(rows, typing.decide(typing.evidence(rows, ["a", "b"])))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"^\s+|\s+$") == 2 and plan.count(numbers.DRESS) == 2
    assert out.dtypes == [("a", "double"), ("b", "bigint")] and sorted(map(tuple, out.collect()), key=str) == [(1.5, -2500), (3.0, -7), (None, None)]
