"""Row numbers and running totals against a plain loop."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from millrace.operators.numbering import numbered


def expected(rows):
    out, seen = [], defaultdict(lambda: [0, 0])
    for g, x, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0)):
        out.append((g, x, v, *seen[g]))
        seen[g] = [seen[g][0] + 1, seen[g][1] + (v or 0)]
    return out


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_groups_that_span_partitions(spark, partitions):
    r = random.Random(1)
    rows = [(g, x, r.choice([None, 1, 5, -2])) for x, g in enumerate(r.choices(["hot", "hot", "hot", "a", None, "", "b c"], k=3000))]
    df = spark.createDataFrame(rows, "g string, x int, nth2 int").repartition(7).withColumnRenamed("nth2", "key")
    found = numbered(df, ["g"], ["x"], sums={"total": "key"}, partitions=partitions).collect()
    assert sorted(map(tuple, found), key=lambda t: t[1]) == sorted(expected(rows), key=lambda t: t[1])


def test_all_rows_are_one_group_and_ties_get_their_own_number(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (1,), (0,)], "x int")
    assert sorted((r.nth, r.x) for r in numbered(df, [], ["x"]).collect()) == [(0, None), (1, 0), (2, 1), (3, 1), (4, 1)]


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([], "x int, part int, _key string")
    assert numbered(df, ["_key"], ["x"]).collect() == []
    with pytest.raises(ValueError, match="nth"):
        numbered(df.withColumnRenamed("x", "NTH"), [], ["part"])
