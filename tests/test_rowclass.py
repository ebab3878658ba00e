"""Row classes of report-shaped tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.operators import rowclass

HEADER = ["Centre", "Producer", "Premium", "Policy"]
SCHEMA = "sheet string, row long, cells array<string>"


def record(i, premium):
    return [f"Zone {i}", "Metro Agency", str(premium), f"POL-{i:04d}"]


def wide(i):
    return [f"Zone {i}", "Metro Agency", str(100.5 + i), f"POL-{i:04d}", f"2026-01-{i + 1:02d}", str(5.5 + i)]


def total(name, value, width=4):
    return [name, None, str(value), None, *[None] * (width - 4)]


FOUR = [record(i, 100.0) for i in range(4)]
SECTIONS = [record(0, 100.0), record(1, 200.0), total("Subtotal A", 300.0), record(2, 400.0), record(3, 500.0), total("Subtotal B", 900.0)]
CASES = {
    "full": ([record(i, 100.0) for i in range(5)], ["DATA"] * 5),
    "footer": ([*FOUR, ["*** End of Report ***", None, None, None]], ["DATA"] * 4 + ["FOOTER"]),
    "footer in another language": ([*FOUR, ["Fин отчёта", None, None, None]], ["DATA"] * 4 + ["FOOTER"]),
    "total over all": ([record(0, 100.0), record(1, 200.0), record(2, 300.0), total("Subtotal", 600.0)], ["DATA"] * 3 + ["GRAND_TOTAL"]),
    "total without a word for it": ([record(0, 100.0), record(1, 200.0), total("Zwischensumme", "$300.00")], ["DATA"] * 2 + ["GRAND_TOTAL"]),
    "subtotals": (SECTIONS, ["DATA", "DATA", "SUBTOTAL"] * 2),
    "nested": ([*SECTIONS, total("Grand Total", "1,200")], ["DATA", "DATA", "SUBTOTAL"] * 2 + ["GRAND_TOTAL"]),
    "total of all records": ([*SECTIONS[:3], total("Note", 55), *SECTIONS[3:5], total("All", 1200)], ["DATA", "DATA", "SUBTOTAL", "SPARSE_KEPT", "DATA", "DATA", "GRAND_TOTAL"]),
    "sparse record": ([*FOUR, [None, None, "55.5", "POL-9999"]], ["DATA"] * 4 + ["SPARSE_KEPT"]),
    "wrong total": ([*FOUR, total("Total Risk Centre", 12.34)], ["DATA"] * 4 + ["UNVERIFIED_TOTAL"]),
    "record named total": ([*FOUR, ["Total Risk PC", "Metro Agency", "12.34", "POL-0099"]], ["DATA"] * 5),
    "run broken by a gap": ([record(0, 100.0), ["Zone 1", "Metro Agency", None, "POL-0001"], record(2, 300.0), total("Sum", 300.0)], ["DATA"] * 3 + ["SUBTOTAL"]),
    "restated header": ([*map(wide, range(3)), ["Profit Centre", "Producer", "Premium ($)", "Policy No.", "Eff Dt", "Comm %"], *map(wide, range(3, 6))], ["DATA"] * 3 + ["REPEATED_HEADER"] + ["DATA"] * 3),
    "dense total": ([["a", "1", "10"], ["b", "2", "20"], ["c", "3", "30"], ["all", "6", "60"]], ["DATA"] * 3 + ["GRAND_TOTAL"]),
    "last record like a total": ([["a", "x", "10"], ["b", "y", "20"], ["c", "z", "30"]], ["DATA"] * 3),
    "group labels": ([["Gallagher", None, None], [None, "x", "1"], [None, "y", "2"], ["Marsh", None, None], [None, "z", "4"]], ["GROUP_LABEL", "DATA", "DATA", "GROUP_LABEL", "DATA"]),
    "label between records": ([*FOUR[:2], ["Zone X", None, None, None], *FOUR[2:]], ["DATA", "DATA", "SPARSE_KEPT", "DATA", "DATA"]),
    "text after the last record": ([[*r, "n", "m"] for r in FOUR] + [["Filter:", "all zones", None, None, None, None]], ["DATA"] * 4 + ["FOOTER"]),
    None: ([["only", "row"]], ["DATA"]),
}


@pytest.fixture(scope="module")
def classes(spark):
    rows = [(name, 3 * i, cells) for name, (body, _) in CASES.items() for i, cells in enumerate(body)] + [("full", 50, [None, " ", "", None])]
    found = rowclass.classify(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    out = {}
    for r in sorted(found, key=lambda r: (r.sheet is not None, r.sheet or "", r.idx)):
        out.setdefault(r.sheet, []).append(r)
    return out


@pytest.mark.parametrize("name", CASES)
def test_case(classes, name):
    body, want = CASES[name]
    assert [r["class"] for r in classes[name]] == want
    assert [r.row for r in classes[name]] == [3 * i for i in range(len(body))]


def test_what_a_total_adds_up(classes):
    assert [(r.summed, r.column, r.level) for r in classes["subtotals"]] == [(None, None, 0), (None, None, 0), (2, 2, 1)] * 2
    assert (classes["total over all"][-1].summed, classes["dense total"][-1].summed) == (3, 3)
    assert classes["run broken by a gap"][-1].summed == 1


def test_headers_that_are_repeated_or_echoed(spark):
    body = [record(0, 100.0), record(1, 200.0), HEADER, record(2, 300.0), [None, None, "Premium", "Policy"]]
    headers = spark.createDataFrame([("s", HEADER)], "sheet string, header array<string>")
    found = rowclass.classify(spark.createDataFrame([("s", i, c) for i, c in enumerate(body)], SCHEMA), headers).orderBy("idx").collect()
    assert [r["class"] for r in found] == ["DATA", "DATA", "REPEATED_HEADER", "DATA", "REPEATED_HEADER"]


def test_levels_of_totals_and_carried_labels(spark):
    area = [record(0, 0.0), record(8, 0.0), *SECTIONS[:3], record(7, 0.0), *SECTIONS[3:], total("East", 1200.0)]
    other = [record(5, 3.0), record(5, 4.0), total("x", 7), record(6, 8.0), record(9, 0.0), total("y", 8), total("West", 15)]
    body = [*area, *other, total("All", 1215)]
    df = spark.createDataFrame([("s", i, c) for i, c in enumerate(body)], SCHEMA)
    found = rowclass.classify(df, levels=3).orderBy("idx").collect()
    assert [(r["class"], r.level) for r in found if r["class"] != "DATA"] == [("SUBTOTAL", 1), ("SUBTOTAL", 1), ("SUBTOTAL", 2), ("SUBTOTAL", 1), ("SUBTOTAL", 1), ("SUBTOTAL", 2), ("SUBTOTAL", 3)]
    groups = spark.createDataFrame([("g", i, c) for i, c in enumerate(CASES["group labels"][0])], SCHEMA)
    carried = rowclass.carry_labels(rowclass.classify(groups)).orderBy("row").collect()
    assert [r.cells for r in carried] == [["Gallagher", "x", "1"], ["Gallagher", "y", "2"], ["Marsh", "z", "4"]]
    assert rowclass.classify(df.limit(0)).collect() == []


def test_one_long_sheet_over_many_partitions(spark):
    body = spark.range(4000).select(F.lit("hot").alias("sheet"), F.col("id").alias("row"), F.when(F.col("id") % 8 == 7, F.array(F.lit("t"), F.lit(None), F.lit("28.00"), F.lit(None))).otherwise(
        F.array(F.concat(F.lit("Zone "), "id"), F.lit("agency"), (F.col("id") % 8 + 1).cast("string"), F.concat(F.lit("POL-"), F.lpad(F.col("id").cast("string"), 5, "0")))).alias("cells"))
    found = rowclass.classify(body).groupBy("class").count().collect()
    assert {r["class"]: r["count"] for r in found} == {"DATA": 3500, "SUBTOTAL": 500}


def test_a_cell_is_stripped_once_however_often_it_is_looked_at(spark):
    from millrace.functions import cells as C

    for function, times in ((C.kind, 1), (C.read, 2), (C.effective_fill, 1), (C.brevity, 1)):  # read strips a cell, then marks off its number
        assert str(function(F.col("cells"))).count("regexp_replace") == times, function
    assert str(C.contrast(F.col("cells"), F.col("profile"))).count("regexp_replace") == 1


def test_rows_are_put_in_order_once_and_values_only_where_a_run_is_broken(spark, monkeypatch):
    calls, numbered = [], rowclass.numbered
    monkeypatch.setattr(rowclass, "numbered", lambda df, *rest, **named: calls.append(df.columns) or numbered(df, *rest, **named))
    for name, times in (("nested", 1), ("run broken by a gap", 2)):
        body, want = CASES[name]
        calls.clear()
        found = rowclass.classify(spark.createDataFrame([("s", i, c) for i, c in enumerate(body)], SCHEMA), cells=False).orderBy("idx").collect()
        assert [r["class"] for r in found] == want and len(calls) == times
        assert "cells" not in calls[0]
