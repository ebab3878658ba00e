"""Tables that lie on their side."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.operators import orientation

SCHEMA = "sheet string, row long, cells array<string>"
HEADER = ["Centre", "Number", "Premium", "Policy", "Effective"]


def table(n):
    return [HEADER, *[[f"Zone {i % 2}", str(1000 + i), str(10.5 * i), f"POL-{i:05d}", f"2026-01-{i + 1:02d}"] for i in range(n)]]


def turned(grid):
    return [list(c) for c in zip(*grid, strict=True)]


MONTHS = ["Producer", *[f"2026-{m:02d}-01" for m in range(1, 7)]]
CASES = {
    "upright": (table(12), False), "sideways": (turned(table(12)), True), "two records": (table(2), False), "wide and short": (turned(table(4)), True),
    "under a title": ([["Report of all zones", None, None, None, None], *table(8)], False), "pivot": ([MONTHS, *[[f"Agency {i}", *[str(100.5 * i + m) for m in range(6)]] for i in range(3)]], False),
    "lookup": ([["Name", "Town"], ["Ann A", "Rome"], ["Bob B", "Oslo"], ["Cid C", "Bern"]], False), "one line": ([HEADER], False), None: (turned(table(9)), True)}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(name, 2 * i, cells) for name, (grid, _) in CASES.items() for i, cells in enumerate(grid)], SCHEMA).repartition(3)


def test_decisions(rows):
    found = {r.sheet: r for r in orientation.decide(rows).collect()}
    assert {name: found[name].transposed for name in CASES} == {name: want for name, (_, want) in CASES.items()}
    assert found["pivot"].decided_by == "pivot" and found["sideways"].decided_by == "scores"


def test_sideways_tables_come_out_upright(rows):
    found = {}
    for r in orientation.upright(rows).orderBy("sheet", "row").collect():
        found.setdefault(r.sheet, []).append(r.cells)
    assert found["sideways"] == table(12) and found[None] == table(9) and found["wide and short"] == table(4)
    assert all(found[name] == grid for name, (grid, sideways) in CASES.items() if not sideways)


def test_transpose_twice_and_ragged_rows(spark):
    df = spark.createDataFrame([("a", 0, ["x", "y", "z"]), ("a", 5, ["1"]), (None, 3, [None, "q"])], SCHEMA)
    once = orientation.transpose(df)
    assert sorted((r.sheet or "", r.row, r.cells) for r in once.collect()) == [("", 0, [None]), ("", 1, ["q"]), ("a", 0, ["x", "1"]), ("a", 1, ["y", None]), ("a", 2, ["z", None])]
    assert sorted((r.sheet or "", r.cells) for r in orientation.transpose(once).collect()) == [("", [None, "q"]), ("a", ["1", None, None]), ("a", ["x", "y", "z"])]
    assert orientation.upright(df.filter(F.lit(False))).collect() == []


def test_transpose_of_rows_alike_in_number_and_of_many(spark):
    twice = spark.createDataFrame([("s", 1, ["a", "b"]), ("s", 1, ["c", "d"]), ("s", 2, ["e"])], SCHEMA)
    found = [r.cells for r in orientation.transpose(twice).orderBy("row").collect()]
    assert sorted(zip(*[cells[:2] for cells in found], strict=True)) == [("a", "b"), ("c", "d")] and [cells[2] for cells in found] == ["e", None]
    high = spark.range(20_000).select(F.lit("s").alias("sheet"), F.col("id").alias("row"), F.array(F.col("id").cast("string"), F.lit("x")).alias("cells"))
    first, second = (r.cells for r in orientation.transpose(high).orderBy("row").collect())
    assert first == [str(i) for i in range(20_000)] and second == ["x"] * 20_000


def test_nothing_is_worked_out_of_a_whole_line_for_each_of_its_cells(spark):
    wide = spark.range(3).select(F.lit("s").alias("sheet"), F.col("id").alias("row"), F.transform(F.sequence(F.lit(0), F.lit(4999)), lambda i: i.cast("string")).alias("cells"))
    above = orientation.transpose(wide)._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert "xxhash64" not in above
    found = orientation.transpose(wide).orderBy("row").collect()
    assert [r.cells for r in found] == [[str(i)] * 3 for i in range(5000)]
