"""Upserts, contracts and two writers at once."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace.operators import loads
from millrace.operators.loads import Contract

SCHEMA = "id int, x string, v decimal(10,2)"


def rows(spark, path):
    return sorted((r.id is None, r.id or 0, r.x, r._load_id) for r in loads.current(spark, path).collect())


def frame(spark, data):
    return spark.createDataFrame([(i, x, Decimal(v)) for i, x, v in data], SCHEMA)


def test_merge_updates_adds_and_repeats(spark, tmp_path):
    path = str(tmp_path / "t")
    assert loads.merge(frame(spark, [(1, "a", 1), (2, "b", 1), (None, "n", 1)]), path, "one", ["id"]) == 3
    second = frame(spark, [(2, "B", 1), (3, "c", 1), (3, "c", 1), (3, "twin", 0), (None, "m", 1)])
    for _ in range(2):  # a rerun changes nothing
        assert loads.merge(second, path, "two", ["id"], [F.desc("v"), F.col("x")]) == 5
        assert rows(spark, path) == [(False, 1, "a", "one"), (False, 2, "B", "two"), (False, 3, "c", "two"), (True, 0, "m", "two"), (True, 0, "n", "one")]
    assert loads.merge(frame(spark, [(9, "z", 1)]).withColumn("new", F.lit(7)), path, "three", ["id", "x"]) == 6
    assert [r.new for r in loads.current(spark, path).orderBy("new").collect()] == [None] * 5 + [7]


def test_a_broken_contract_stops_the_swap(spark, tmp_path):
    path, data = str(tmp_path / "t"), frame(spark, [(1, "a", "1.50"), (None, None, "2.25")])
    with pytest.raises(ValueError, match="2 rows, not 3; 1 rows without id; v sums to 3.750000, not 4"):
        loads.load(data, path, "one", contract=Contract(rows=3, filled=("id", "v"), sums={"v": 4}))
    with pytest.raises(ValueError, match="no value in x"):
        loads.merge(data.withColumn("x", F.lit(None).cast("string")), path, "one", ["id"], contract=Contract(used=("x", "id")))
    assert loads.current(spark, path) is None
    assert loads.load(data, path, "one", contract=Contract(rows=2, filled=("v",), used=("x",), sums={"v": Decimal("3.75")})) == 2


def test_of_two_writers_the_second_starts_again(spark, tmp_path, monkeypatch):
    path, commit, others = str(tmp_path / "t"), loads.commit, []
    loads.load(frame(spark, [(1, "a", 1)]), path, "one")

    def late(spark_, path_, row):
        if row["load_id"] == "mine" and len(others) < 1:  # another load gets in between
            others.append(loads.load(frame(spark, [(2, "b", 1)]), path, "other"))
        commit(spark_, path_, row)

    monkeypatch.setattr(loads, "commit", late)
    assert loads.load(frame(spark, [(3, "c", 1)]), path, "mine") == 3
    assert rows(spark, path) == [(False, 1, "a", "one"), (False, 2, "b", "other"), (False, 3, "c", "mine")]
    others.clear()
    with pytest.raises(loads.Conflict):
        loads.load(frame(spark, [(4, "d", 1)]), path, "mine", tries=1)
    assert len(rows(spark, path)) == 3


def test_a_commit_that_was_never_finished_counts_for_nothing(spark, tmp_path):
    path = tmp_path / "t"
    loads.load(frame(spark, [(1, "a", 1)]), str(path), "one")
    (path / "manifest" / "000000000002.json").write_text("")
    assert rows(spark, str(path)) == [(False, 1, "a", "one")]
    assert loads.load(frame(spark, [(2, "b", 1)]), str(path), "two") == 2 and loads.head(spark, str(path)) == 3
