"""Tables inside sheets: gaps of any size, stacked and side by side."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from millrace import sheet_queries
from millrace.functions import cells as C
from millrace.operators import headings, regions

HEADER = ["Name", "Num", "Amount", "Date"]
SCHEMA = "sheet string, row long, cells array<string>"


def records(count, start=0):
    return [[f"PC {i} x", str(1000 + i), str(100.5 + i), f"2026-01-{i + 1:02d}"] for i in range(start, start + count)]


def blanks(count, width=4):
    return [[None] * width for _ in range(count)]


def widen(rows, gap):
    return [r[:2] + [None] * gap + r[2:] for r in rows]


SMALL = [["Region", "Total", None, None], ["East", "500.0", None, None], ["West", "600.0", None, None]]
BESIDE = [["Name", "Num", None, None, "Region", "Total"], ["PC 0", "1000", None, None, "East", "500.0"], ["PC 1", "1001", None, None, "West", "600.0"],
          ["PC 2", "1002", None, None, None, None], ["PC 3", "1003", None, None, None, None]]
#: name: (grid, (region, part, rows, first row, first column, width) of each table)
CASES = {
    **{f"gap of {n}": ([HEADER, *records(3), *blanks(n), *records(3, 3)], [(1, 1, 7, 0, 0, 4)]) for n in (1, 2, 12)},
    **{f"another table after {n}": ([HEADER, *records(4), *blanks(n), *SMALL], [(1, 1, 5, 0, 0, 4), (2, 1, 3, 5 + n, 0, 2)]) for n in (1, 3)},
    "footer": ([HEADER, *records(4), *blanks(2), ["*** End of Report ***", None, None, None]], [(1, 1, 6, 0, 0, 4)]),
    "blank edges": ([*blanks(3), HEADER, *records(4), *blanks(4)], [(1, 1, 5, 3, 0, 4)]),
    "only blanks": (blanks(6), []),
    **{f"gutter of {n}": (widen([HEADER, *records(4)], n), [(1, 1, 5, 0, 0, 4)]) for n in (1, 3, 7)},
    "leading columns": ([[None, None, *r] for r in [HEADER, *records(4)]], [(1, 1, 5, 0, 2, 4)]),
    "side by side": (BESIDE, [(1, 1, 5, 0, 0, 2), (1, 2, 3, 0, 4, 2)]),
    "column without a header": ([[*HEADER[:2], None, *HEADER[2:]], *[[*r[:2], "note", *r[2:]] for r in records(3)]], [(1, 1, 4, 0, 0, 5)]),
    "banners": ([["Acme", None, None, None], ["Generated 2026-01-01", None, None, None], ["Confidential", None, None, None], *blanks(2), HEADER, *records(4)], [(2, 1, 5, 5, 0, 4)]),
    "header apart": ([HEADER, *blanks(1), *records(3), *blanks(1), *records(2, 3)], [(1, 1, 6, 0, 0, 4)]),
    "same labels beside": ([["Agent", "Premium", "Revenue", None, "Carrier", "Premium", "Revenue"], *[[f"a {i}", str(i), str(i), None, f"c {i}", str(i), str(i)] for i in range(4)]], [(1, 1, 5, 0, 0, 3), (1, 2, 5, 0, 4, 3)]),
    "list of days": ([[f"2026-01-{i + 1:02d}"] for i in range(12)], [(1, 1, 12, 0, 0, 1)]),
    "stack of titles": ([[f"title {i}"] for i in range(12)], []),
    None: ([["k", "v"], ["a b", "1"], ["c d", "2"]], [(1, 1, 3, 0, 0, 2)]),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(name, i, cells) for name, (grid, _) in CASES.items() for i, cells in enumerate(grid)]
    out = {name: {} for name in CASES}
    for r in regions.tables(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect():
        out[r.sheet].setdefault((r.region, r.part), []).append(r)
    return out


@pytest.mark.parametrize("name", CASES)
def test_tables_of_a_sheet(found, name):
    got = [(*key, len(rows), min(r.row for r in rows), rows[0].first_column, len(rows[0].cells)) for key, rows in sorted(found[name].items())]
    assert got == CASES[name][1]


def test_no_sheets(spark):
    assert regions.tables(spark.createDataFrame([], SCHEMA)).collect() == []


HEADED = {
    "clean": ([HEADER, *records(5)], (0, 1, ["name", "num", "amount", "date"])),
    "blank labels": ([["Name", None, "Amount", ""], *records(5)], (0, 1, ["name", "column_2", "amount", "column_4"])),
    "twice the same": ([["Name", "Num", "Name", "Date"], *records(5)], (0, 1, ["name", "num", "name_2", "date"])),
    "suffix that is taken": ([["Name", "Name_2", "Name", "2026"], *records(5)], (0, 1, ["name", "name_2", "name_2_2", "col_2026"])),
    "under banners": ([["Acme Corp", None, None, None], ["Generated", None, None, None], HEADER, *records(5)], (2, 1, ["name", "num", "amount", "date"])),
    "two rows": ([["Policy", "Premium", "Premium", "Date"], ["Number", "Gross", "Net", None], *records(5)], (0, 2, ["policy_number", "premium_gross", "premium_net", "date"])),
    "none": (records(6), (None, 0, ["column_1", "column_2", "column_3", "column_4"])),
    "list": ([[f"2026-01-{i + 1:02d}"] for i in range(5)], (None, 0, ["column_1"])),
}


def test_headers(spark):
    rows = [(name, 2 * i, cells) for name, (grid, _) in HEADED.items() for i, cells in enumerate(grid)] + [(None, 0, HEADER), (None, 1, records(1)[0])]
    got = {r.sheet: r for r in headings.find(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert {name: (got[name].header, got[name].depth, got[name].names) for name in HEADED} == {name: want for name, (_, want) in HEADED.items()}
    assert got["two rows"].labels == ["Policy Number", "Premium Gross", "Premium Net", "Date"]
    assert got["clean"].score > 0.85 and set(got) == {*HEADED, None}


ODD = ["Name", " padded\t", "-- note", "ORD-123", "AB12", "12", "1,234", "-3.5", "2026-01-02", "2026-01-02 10:11", "$5", "5%", "1e5", "+4", "5.", "", "  ", None, "x" * 81, "1" * 81, "über", "a ", "x\x0b", "7\n", "--", "A b "]


def test_marks_are_the_kinds_of_cells(spark):
    df = C.marked(spark.createDataFrame([(ODD,)], "cells array<string>"))
    got = df.select("texts", "marks", F.transform("cells", C.stripped).alias("stripped"), F.transform("cells", C.kind).alias("kinds"), F.transform("cells", C.number).alias("numbers"), F.transform(C.letters(F.col("marks")), C.marked_kind).alias("decoded"), C.filled_marks(F.col("marks")).alias("filled"), "fill").first()
    assert got.texts == got.stripped == [None if c is None else re.sub(r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "", c) or None for c in ODD]
    assert got.decoded == got.kinds and got.filled == got.fill == sum(k is not None for k in got.kinds)
    assert [m.lower() in "nfm" for m in got.marks] == [n is not None for n in got.numbers]
    assert [m.isupper() for m in got.marks] == [t is not None and (t.startswith("--") or len(t) > 80) for t in got.texts]


def test_the_cells_of_a_sheet_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def counted(cells):
        seen.add(1)
        return cells

    rows = [("s", i, cells) for i, cells in enumerate([HEADER, *records(9), *blanks(2), *SMALL])]
    found = regions.tables(spark.createDataFrame(rows, SCHEMA).repartition(3).select("sheet", "row", counted("cells").alias("cells")))
    assert found.count() == 13 and seen.value == len(rows)


def test_tables_without_number(spark):
    """Tables of two rows, one blank row apart and unlike each other, so that most rows aren't in the table that most of their sheet is in."""
    pairs = [[["Name", "Num"], ["a b", "1"]], [["2026-01-01", None, "x y"], ["2026-01-02", None, "z w"]]]
    rows = [(sheet, 3 * i + j, line) for sheet in ("a", None) for i in range(40) for j, line in enumerate(pairs[i % 2])]
    got = regions.tables(spark.createDataFrame(rows, SCHEMA).repartition(5)).groupBy("sheet", "region").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).collect()
    assert {(r.sheet, r.region, r["first"], r.n) for r in got} == {(sheet, i + 1, 3 * i, 2) for sheet in ("a", None) for i in range(40)}


def test_headers_of_marked_rows(spark):
    rows = [(name, 2 * i, cells) for name, (grid, _) in HEADED.items() for i, cells in enumerate(grid)]
    df = spark.createDataFrame(rows, SCHEMA)
    marked = C.marked(df).select("sheet", "row", F.col("texts").alias("cells"), "marks", "fill")
    assert sorted(headings.find(marked, marked=True).collect()) == sorted(headings.find(df).collect())


def test_kinds_below_a_header_count_beyond_the_first_rows(spark):
    """Of kinds equally frequent below a row the one met first decides, before and behind the first twenty rows, though rows share a number."""
    lines = [["Name"], *[["2026-01-01"]] * 19, *[["x 1"]] * 5, *[["5"]] * 5]
    for number in (lambda i: i, lambda i: min(i, 18), lambda i: i // 30):
        early = headings._early(C.marked(spark.createDataFrame([("s", number(i), line) for i, line in enumerate(lines[:20])] + [("s", i, line) for i, line in enumerate(lines[20:], 20)], SCHEMA).repartition(3)).drop("texts"))
        assert sorted(r.idx for r in early.collect()) == list(range(20))
    df = C.marked(spark.createDataFrame([("s", i, line) for i, line in enumerate(lines)], SCHEMA).repartition(3)).drop("texts")
    early = headings._early(df)
    scored = {r.idx: r.contrast for r in headings.scores(early, headings._patterns(df, early)).collect()}
    assert scored[0] == 1.0 and scored[14] == 0.0 and scored[19] == 1.0  # below the last row five texts stand before five numbers


def test_orders_are_numbered_without_a_task_per_sheet(spark, sf_dir):
    plan = sheet_queries.sheets(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Window" in line and "o_orderkey" in line] and "FullOuter" not in plan
