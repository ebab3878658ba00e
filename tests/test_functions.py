"""Column builders and operators on odd values, each with its defined result."""

from __future__ import annotations

import datetime
import hashlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace.functions import dates, digest, numbers, text
from millrace.operators import joins, loads, profile, reshape, totals, typing
from millrace.operators.transform import Target, quality, transform


def values(spark, build, given, kind="string"):
    rows = spark.createDataFrame(list(enumerate(given)), f"i int, v {kind}")
    return [r.x for r in rows.select("i", build(F.col("v")).alias("x")).orderBy("i").collect()]


def test_amounts_are_read_strictly(spark):
    want = {
        "1,234.50": "1234.5", "$-5": "-5", "-$5": "-5", "1.": "1", ".5": ".5", "5 $": "5", "+ $ 5": "5", "$(250.00)": "-250", "(250)": "-250", "( $250 )": "-250", "12.5%": ".125", "(5%)": "-.05", "1.2E+03": "1200",
        "5-": None, "--5": None, "$5$": None, "(5": None, "5)": None, "1,23": None, "1,2345": None, "": None, " ": None, None: None, "abc": None, "5%%": None, "$": None, "1 234": None, "((5))": None, "1,000,0": None, "12,345,678": "12345678"}
    assert values(spark, numbers.amount, list(want)) == [None if w is None else Decimal(w) for w in want.values()]


def test_rounding_and_overflow(spark):
    fit = lambda c: numbers.fit(numbers.amount(c), 5, 2)
    assert values(spark, fit, ["1.005", ".125", "999.99", "1000", "999.999", "-999.5", None]) == [Decimal("1.01"), Decimal("0.13"), Decimal("999.99"), None, None, Decimal("-999.50"), None]


def test_whole_numbers_and_flags(spark):
    assert values(spark, numbers.whole, ["5", "5.0", "2026.", "5.5", "100%", "1e3", "x", None]) == [5, 5, 2026, None, None, 1000, None, None]
    assert values(spark, lambda c: numbers.whole(c, "int", months=True), ["March", " sept ", "dec", "7", "xyz", ""]) == [3, 9, 12, 7, None, None]
    assert values(spark, numbers.flag, ["Yes", "1.0", "0.0", " F ", "maybe", None, ""]) == [True, True, False, False, None, None, None]


def test_numbers_as_sheets_write_them(spark):
    assert values(spark, numbers.clean_number, ["(1,250)", "250-", "$ 1 000.5", "50%", "$1,000,0", "x", None]) == [-1250.0, -250.0, 1000.5, 50.0, None, None, None]
    assert values(spark, lambda c: numbers.clean_number(c, european=True), ["1.234,56", "99,5", "(1.000)", "1,234.56"]) == [1234.56, 99.5, -1000.0, None]


def test_dates_of_typed_columns(spark):
    d = datetime.date
    want = {
        "2024-03-05": d(2024, 3, 5), "2024-3-5": d(2024, 3, 5), "3/5/2024": d(2024, 3, 5), "03-05-2024": d(2024, 3, 5), "2024-03-05 07:08:09.123456789": d(2024, 3, 5), "2024-03-05T07:08:09": d(2024, 3, 5), "2024-03-05 7:08": d(2024, 3, 5),
        "3/5/2024 07:08:09": d(2024, 3, 5), "3/5/2024 7:08": d(2024, 3, 5), "20240305": d(2024, 3, 5), "46030": d(2026, 1, 8), "9999-12-31": d(9999, 12, 31), "1850-01-01": d(1850, 1, 1), "18500101": None, "99999": None,
        "5.3.2024": None, "5 Mar 2024": None, "1/5/26": None, "13/45/2024": None, "2024-02-30": None, "": None, None: None, "7": None}
    assert values(spark, dates.parse_date, list(want)) == list(want.values())


def test_timestamps_and_periods(spark):
    t = datetime.datetime
    assert values(spark, dates.parse_timestamp, ["2024-03-05 07:08:09.5", "2024-03-05T07:08:09", "3/5/2024 7:08", "20240305", "x"]) == [t(2024, 3, 5, 7, 8, 9, 500000), t(2024, 3, 5, 7, 8, 9), t(2024, 3, 5, 7, 8), t(2024, 3, 5), None]
    pairs = spark.sql("SELECT * FROM VALUES (DATE'2024-02-01', DATE'2024-02-29'), (DATE'2024-02-01', DATE'2024-03-31'), (DATE'2024-02-02', NULL) AS t(a, b)")
    found = pairs.select(dates.period_type(F.col("a"), F.col("b")).alias("p"), F.size(dates.months_between(F.col("a"), F.col("b"))).alias("n")).collect()
    assert [r.p for r in found] == ["MONTH", "DATE_RANGE", None] and [r.n for r in found][:2] == [1, 2]


def test_codes_and_names(spark):
    want = {"94": "0094", "94.0": "0094", "0094": "0094", "00094": "00094", "069_01": "0069_01", "12_ab": "12_ab", " x9 ": "x9", "": None, None: None, "12345": "12345", "0": "0000"}
    assert values(spark, text.pad_code, list(want)) == list(want.values())
    assert values(spark, text.code_number, ["PC0094", "pc-94", "pc_069_01", "94", "pcx"]) == ["0094", "0094", "0069_01", "0094", "pcx"]
    assert values(spark, text.snake, ["2 Year", "2026", " Premium (%) ", "Straße", "", None, "%%"]) == ["2_year", "col_2026", "premium", "strasse", None, None, None]


def test_digests_follow_the_written_values(spark):
    row = spark.sql("SELECT ' Straße ' AS s, CAST(NULL AS STRING) AS n, true AS b, DATE'2024-03-05' AS d, TIMESTAMP'2024-03-05 07:08:09' AS t, CAST(1.5 AS DECIMAL(18,2)) AS m, 100.0D AS f, 12345678.25D AS g, double('NaN') AS h, 7 AS i, 1e20D AS j")
    want = "\x1f".join(["strasse", "", "true", "2024-03-05", "2024-03-05T07:08:09", "1.500000", "100.0", "12345678.25", "nan", "7", "1e+20"])
    assert row.select(digest.row_digest(row, row.columns)).first()[0] == hashlib.sha256(want.encode()).hexdigest()


REFERENCE = [("94", "East", "Active"), ("95", "West", "Active"), ("96", "East", "Closed"), ("97", "North – One", "Closed")]


@pytest.mark.parametrize(("name", "number", "pc", "want"), [
    ("East", "0094", None, ("0094", "East", "kept")), ("east ", "95", None, ("0094", "east", "corrected")), ("Nowhere", "95", None, ("0095", "Nowhere", "no_match")), ("West", None, None, ("0095", "West", "filled_number")),
    ("Nowhere", None, None, (None, "Nowhere", "no_match")), (None, "95", "PC0094", ("0095", None, "name_missing")), ("n/a", "", "PC0094", ("0094", "East", "filled_name")), (None, None, "PC0500", (None, None, "no_match")),
    (None, None, None, (None, None, "no_match")), ("north - one", "PC97", None, ("0097", "north - one", "kept"))])
def test_the_name_decides(spark, name, number, pc, want):
    reference = spark.createDataFrame(REFERENCE, "number string, name string, status string")
    facts = spark.createDataFrame([(name, number, pc, "mine")], "name string, number string, pc string, _n string")
    found = joins.resolve(facts, reference, "name", "number", "pc")
    assert found.columns == ["name", "number", "pc", "_n", "ref_number", "ref_name", "outcome"]
    assert tuple(found.first())[4:] == want
    assert joins.resolve(facts, reference.limit(0), "name", "number", "pc").first()["outcome"] == "unavailable"


def test_roles_and_date_statistics(spark):
    def role(df):
        e = profile.role_evidence(df)
        return e.select(profile.role(*[F.col(c) for c in ("rows", "measures", "keys", "dates", "unique_rows")])).first()[0]

    assert role(spark.range(50).selectExpr("id", "'x' AS name")) == "DIMENSION"
    assert role(spark.range(300).selectExpr("id", "'x' AS name")) == "UNKNOWN"
    assert role(spark.range(50).selectExpr("id", "id % 3 AS qty")) == "FACT"
    assert role(spark.range(50).selectExpr("'a' AS a", "'b' AS b")) == "UNKNOWN"
    assert role(spark.range(0).selectExpr("id")) == "UNKNOWN"
    raw = spark.createDataFrame([("2024-01-02",), ("junk",), (" ",), (None,)], "d string")
    assert tuple(profile.date_stats(raw, {"d": F.col("d")}).first()) == ("d", 4, 1, 1, "2024-01-02", "2024-01-02", 25.0)


def test_totals_and_grain(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)], "a double, b double")
    assert not any(r.is_total for r in totals.total_columns(rows, ["a", "b"]).collect())
    rows = spark.createDataFrame([("s", 1, 2.0, 3.0, 5.0), ("s", 2, 1.0, 1.0, 2.0), ("s", 3, 3.0, 4.0, 7.0), ("z", 1, 0.0, 0.0, 0.0), ("z", 2, 0.0, 0.0, 0.0), ("z", 3, 0.0, 0.0, 0.0)], "sheet string, line int, a double, b double, t double")
    assert [r.measure for r in totals.total_columns(rows, ["a", "b", "t"]).collect() if r.is_total] == ["t"]
    assert [(r.sheet, r.line) for r in totals.total_rows(rows, ["sheet"], "line", ["a", "b"]).collect() if r.is_total] == [("s", 3)]
    texts = rows.select("sheet", "line", *[F.col(c).cast("string").alias(c) for c in "abt"])
    found = totals.grain(texts, ["sheet", "a", "b", "t"], ["sheet"], "line").first()
    assert (found.measures, found.dimensions, found.total_column, found.total_rows, found.aggregated) == (3, 1, "t", 1, True)
    assert not totals.grain(texts, ["sheet", "a", "b", "t"], ["sheet"], "line", dated=True).first().aggregated
    assert not totals.grain(texts.limit(0), ["sheet", "a"], ["sheet"], "line").first().aggregated
    lost = totals.accounting(rows, rows.filter("line = 3"), rows.filter("line < 2"), ["sheet"]).collect()
    assert sorted(tuple(r) for r in lost) == [("s", 3, 1, 1, 1), ("z", 3, 1, 1, 1)]


@pytest.mark.parametrize(("column", "given", "kind"), [
    ("v", ["2024-01-01", "2024/1/2", "3 Jan 2024", "4.1.2024"], "date"), ("v", ["13/02/2024", "01/02/2024", "25/12/2024"], "date"), ("v", ["20240101", "20240102"], "date"), ("policy id", ["20240101", "20240102"], "string"),
    ("v", ["1,234.5", "10", "(3)"], "double"), ("v", ["1", "2.0", "3"], "long"), ("v", ["08085", "12345"], "string"), ("v", ["1", "2", "12AB"], "string"), ("v", ["59808-1658", "1", "2"], "string"), ("v", [str(1000 + i) for i in range(11)], "string"),
    ("v", [str(1000 + i) for i in range(10)], "long"), ("v", ["1", "2", "3", "1,2,3"], "string"), ("v", ["1", "2", "n/a"], "long"), ("v", ["a", "b", "1"], "string"), ("v", [None, " "], "string"), ("v", ["1.234,56", "99,5"], "double")])
def test_types_are_decided_by_values(spark, column, given, kind):
    df = spark.createDataFrame([(g,) for g in given], f"`{column}` string")
    decided = typing.decide(typing.evidence(df, [column]))
    assert [r.kind for r in decided.collect()] == [kind]
    out = typing.typed(df, decided)
    assert out.dtypes == [(column, {"long": "bigint"}.get(kind, kind))]
    held = [r[0] for r in out.collect()]
    assert all(h is not None for h, g in zip(held, given, strict=True) if g and any(c.isdigit() for c in g))
    if given[0] == "13/02/2024":
        assert held[1] == datetime.date(2024, 2, 1)
    if given[0] == "1.234,56":
        assert held == [1234.56, 99.5]


def test_transform_of_empty_and_odd_rows(spark):
    catalogue = [Target("id", "bigint", True), Target("day", "date"), Target("day_month", "int"), Target("at", "timestamp")]
    rows = spark.createDataFrame([("1", "x", None), (None, " ", "2024-01-02")], "a string, `b c` string, d string")
    out = transform(rows, {"id": "a", "day": "b c", "at": "d"}, catalogue, {"day_month": ("day", "month")})
    assert [(r.id, r.day, r.invalid_columns) for r in out.collect()] == [(1, None, "day"), (None, None, "")]
    assert [(r.target, r.rows, r.filled, r.invalid) for r in quality(out, catalogue).collect()] == [("id", 2, 1, 0), ("day", 2, 0, 1), ("day_month", 2, 0, 0), ("at", 2, 1, 0)]
    assert transform(rows.limit(0), {"id": "a"}, catalogue).count() == 0


def test_loads_replace_evolve_and_repeat(spark, tmp_path):
    path, frame = str(tmp_path / "table"), lambda rows, columns: spark.createDataFrame(rows, columns)
    assert loads.current(spark, path) is None
    assert loads.load(frame([(1, "a"), (2, "b")], "id int, x string"), path, "one") == 2
    assert loads.load(frame([("c", 3, 1.5)], "x string, id int, y double"), path, "two") == 3
    assert loads.load(frame([("c", 3, 1.5)], "x string, id int, y double"), path, "two") == 3  # repeated: nothing doubles
    assert loads.load(frame([(9, "z")], "id int, x string"), path, "three", replaces=["one"]) == 2
    assert sorted((r.id, r.x, r.y, r._load_id) for r in loads.current(spark, path).collect()) == [(3, "c", 1.5, "two"), (9, "z", None, "three")]
    with pytest.raises(ValueError, match="differ"):
        loads.load(frame([(1,)], "other int"), path, "four", evolve=False)
    broken = frame([(1, "a")], "id int, x string").withColumn("x", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        loads.load(broken, path, "five")
    assert loads.current(spark, path).count() == 2 and loads.manifest(spark, path).count() == 4


def test_spread_overlap_and_changes(spark):
    long = spark.createDataFrame([(1, "a", 2), (1, "a", 3), (1, "b", 4), (2, "c", 9)], "id int, n string, v long")
    assert sorted(map(tuple, reshape.spread(long, ["id"], "n", ["a", "b"], "v").collect())) == [(1, 5, 4), (2, None, None)]
    left = spark.createDataFrame([(1, "p"), (2, "q"), (3, "x")], "a int, b string")
    right = spark.createDataFrame([(1, "P "), (2, "p"), (5, "z")], "c int, d string")
    assert [tuple(r) for r in joins.best_keys(left, right).collect()] == [("a", "c", 3, 2, 0.666667, True)]
    assert [r.a for r in joins.missing_keys(left, right, [("b", "d")]).orderBy("a").collect()] == [2, 3]
    old, new = spark.range(100).selectExpr("id % 2 AS m"), spark.range(60).selectExpr("0L AS m")
    assert sorted(map(tuple, joins.row_changes(new, old, ["m"]).collect())) == [(0, 60, 50, 20.0), (1, 0, 50, -100.0)]
    assert [reshape.compare_schemas(*x) for x in ((["a"], ["a"]), (["a", "b"], ["b", "a"]), (["a"], ["a", "c"]), (["a"], ["c"]))] == ["identical", "reordered", "evolved", "different"]
