"""One-to-one assignment against the sequential loop; inclusions of columns against sets."""

from __future__ import annotations

import random

import pytest

from millrace import storage
from millrace.operators import matching


def loop(pairs):
    best, out, left, right = {}, {}, set(), set()
    for a, b, s in pairs:
        if a is not None and b is not None and s is not None:
            best[a, b] = max(s, best.get((a, b), s))
    for (a, b), s in sorted(best.items(), key=lambda p: (-p[1], p[0])):
        if a not in left and b not in right:
            out[a] = (b, s)
            left.add(a)
            right.add(b)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_assignment_equals_the_loop(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randrange(25), f"t{r.randrange(20)}", r.choice([0.5, 0.75, 0.9, r.random()])) for _ in range(150)] + [(None, "t1", 2.0), (1, None, 2.0), (1, "t1", None)]
    df = spark.createDataFrame(pairs, "a int, target string, s double").withColumnRenamed("a", "b")
    found = matching.assign(df, "b", "target", "s").collect()
    assert {x.b: (x.target, x.s) for x in found} == loop(pairs)


def test_a_chain_of_pairs_and_no_pairs(spark):
    chain = [(i, i, 2.0 * i) for i in range(6)] + [(i, i + 1, 2.0 * i + 1) for i in range(6)]
    found = matching.assign(spark.createDataFrame(chain, "a int, b int, s double"), "a", "b", "s").collect()
    assert {x.a: (x.b, x.s) for x in found} == loop(chain)
    assert matching.assign(spark.createDataFrame([], "a int, b int, s double"), "a", "b", "s").collect() == []


def test_the_values_find_keys_whose_names_disagree(spark):
    tables = {
        "txn": spark.createDataFrame([("POL-1", "Brown & Brown", 1), ("POL-2", "acme", 2), ("POL-3", "Lockton ", None), ("POL-4", "Nobody", 4), ("POL-5", " ", 5)], "policy string, producer string, n int"),
        "brokers": spark.createDataFrame([("Brown & Brown", "East"), ("Acme", "West"), ("Lockton", "East"), ("Aon", None)], "account string, region string"),
        "other": spark.createDataFrame([("acme", "East"), ("acme", "South")], "account string, `area.code` string")}
    found = {(r.column, r.other): (r["values"], r.found, r.share, r.uniqueness) for r in matching.inclusions(tables).collect()}
    assert found == {
        ("txn.producer", "brokers.account"): (4, 3, 0.75, 1.0), ("other.account", "brokers.account"): (1, 1, 1.0, 1.0), ("other.account", "txn.producer"): (1, 1, 1.0, 1.0), ("brokers.account", "txn.producer"): (4, 3, 0.75, 1.0),
        ("brokers.region", "other.area.code"): (2, 1, 0.5, 1.0), ("other.area.code", "brokers.region"): (2, 1, 0.5, 0.666667)}
    keys = {(r.column, r.other) for r in matching.suggested_keys(tables).collect()}
    assert keys == {("other.account", "brokers.account"), ("brokers.account", "txn.producer"), ("brokers.region", "other.area.code"), ("other.area.code", "brokers.region")}


def test_many_columns_are_counted_as_written_and_cleaned_once(spark):
    r = random.Random(5)
    wide = {t: [[r.choice(["a", " A ", "b", "B  c", "b c", "", " ", None, "7", "x"]) if r.random() < 0.7 else f"{t}{r.randrange(9)}" for _ in range(70)] for _ in range(6)] for t in ("one", "two")}
    tables = {t: spark.createDataFrame(rows, ", ".join(f"{t}{i} string" for i in range(70))) for t, rows in wide.items()}
    assert "regexp_replace" not in matching.counted(tables)._jdf.queryExecution().optimizedPlan().toString()
    columns = {f"{t}.{t}{i}": [k for row in rows if (k := " ".join((row[i] or "").split()).lower())] for t, rows in wide.items() for i in range(70)}
    want = {}
    for a, mine in columns.items():
        for b, theirs in columns.items():
            found = len({*mine} & {*theirs})
            if a[:3] != b[:3] and found and round(found / len({*mine}), 6) >= 0.5:
                want[a, b] = (len({*mine}), found, round(found / len({*mine}), 6), round(len({*theirs}) / len(theirs), 6))
    assert {(x.column, x.other): (x["values"], x.found, x.share, x.uniqueness) for x in matching.inclusions(tables).collect()} == want


def test_tasks_hold_a_share_of_the_pairs_however_many_there_are(spark, monkeypatch):
    monkeypatch.setattr(storage, "TASK_ROWS", 10)
    r = random.Random(9)
    pairs = [(r.randrange(25), r.randrange(20), r.randrange(50)) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a int, b int, s int")
    assert storage.dealt(df, len(pairs), "a", "b").rdd.getNumPartitions() == 30 and storage.dealt(df, 1, "a").rdd.getNumPartitions() == 8
    assert {x.a: (x.b, x.s) for x in matching.assign(df, "a", "b", "s").collect()} == loop(pairs)
