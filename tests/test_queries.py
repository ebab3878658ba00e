"""Every registered query of the core against its SQL on the same tables."""

from __future__ import annotations

import ast
from pathlib import Path

import oracle
import pytest

import __spark_entry__ as contract
from millrace import oracles
from millrace import queries as core


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query_equals_its_sql(spark, sf_dir, name):
    columns, found = oracle.of_frame(core.QUERIES[name](spark, sf_dir))
    assert columns == sorted(set(columns))
    if name not in oracles.ORACLES:
        pytest.skip("SQL can't express it")
    want_columns, want = oracle.of_sql(oracle.connect(sf_dir), oracles.ORACLES[name])
    assert columns == want_columns
    assert found == want


def test_every_oracle_has_a_query():
    assert set(oracles.ORACLES) <= set(core.QUERIES)
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


def test_nothing_but_the_contract_imports_the_llm_subpackage():
    root = Path(core.__file__).parent
    for file in root.rglob("*.py"):
        if "llm" in file.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(file.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [f"{node.module}.{a.name}" for a in node.names] if isinstance(node, ast.ImportFrom) else []
            assert not any(".llm" in n for n in names), file


def _plain_orders(spark, folder):
    rows = [(1, 1, "F", "1994-02-03", 1.5), (2, 1, "F", None, 2.25), (3, 2, "O", "2001-12-31", 4.0), (4, 9, "F", "1998-05-06", 8.0)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate string, o_totalprice double")
    orders.withColumn("o_orderdate", orders.o_orderdate.cast("timestamp")).write.parquet(f"{folder}/orders.parquet")


def test_stack_and_unpivot_hold_every_order(spark, tmp_path):
    _plain_orders(spark, tmp_path)
    stacked = {(r.source_sheet, r.o_orderkey) for r in core.stack_with_provenance(spark, str(tmp_path)).collect()}
    assert stacked == {("1994", 1), ("undated", 2), ("2001", 3), ("1998", 4)}
    quarters = {(r.o_orderstatus, r.year, r.period, r.value) for r in core.unpivot_all_years(spark, str(tmp_path)).collect()}
    assert quarters == {("F", 1994, "Quarter 1", "1.50"), ("F", None, "Undated", "2.25"), ("O", 2001, "Quarter 4", "4.00"), ("F", 1998, "Quarter 2", "8.00")}


def test_right_join_meets_every_order(spark, sf_dir):
    found = core.companion_join_right(spark, sf_dir).filter("o_orderkey IS NOT NULL").select("o_orderkey").distinct().count()
    assert found == core.companion_join_inner(spark, sf_dir).select("o_orderkey").distinct().count()
