"""Queries over tables that are spelled as sheets of cells, and the SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import headings, loads, matching, orientation, regions, rowclass
from millrace.operators.numbering import numbered
from millrace.storage import dealt, materialise, shared_dir, small


def load(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def report(spark, sf_dir):
    """All order lines as six report-shaped sheets: records, a total under each order, every 13th of them wrong, a grand total and a footer."""
    lines = load(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("sheet"), "l_orderkey", (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("row"), "l_partkey", "l_quantity", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    text = lambda c: F.col(c).cast("string")
    empty = F.lit(None).cast("string")
    records = lines.select("sheet", "row", F.array(F.concat(F.lit("ORD-"), F.lpad(text("l_orderkey"), 9, "0")), F.concat(F.lit("Part no. "), text("l_partkey")), F.col("l_quantity").cast("bigint").cast("string"), text("price")).alias("cells"))
    sums = lines.groupBy("sheet", "l_orderkey").agg((F.sum("price") + F.when(F.col("l_orderkey") % 13 == 0, 1).otherwise(0)).cast("decimal(28,2)").alias("price"))
    totals = sums.select("sheet", (F.col("l_orderkey") * 16 + 15).alias("row"), F.array(F.lit("Order total"), empty, empty, text("price")).alias("cells"))
    ends = lines.groupBy("sheet").agg(((F.max("l_orderkey") + 1) * 16).alias("row"), F.sum("price").cast("decimal(28,2)").alias("price"))
    grand = ends.select("sheet", "row", F.array(F.lit("All orders"), empty, empty, text("price")).alias("cells"))
    footers = ends.select("sheet", (F.col("row") + 1).alias("row"), F.array(F.lit("*** End of report ***"), empty, empty, empty).alias("cells"))
    return records.unionByName(totals).unionByName(grand).unionByName(footers)


def row_classes(spark, sf_dir):
    return rowclass.classify(report(spark, sf_dir), cells=False).select("sheet", "row", "idx", "class", "summed")


def sheets(spark, sf_dir):
    """All orders as a sheet per priority: a title, a table with a blank row after every hundred records, a count by status beside it, sums by year below."""
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("sheet"), "o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("price"), F.to_date("o_orderdate").alias("day"))
    text, none = (lambda c: F.col(c).cast("string")), F.lit(None).cast("string")
    at = lambda nth: 3 + nth + F.floor(nth / 100)
    records = numbered(orders, ["sheet"], ["o_orderkey"]).select("sheet", at(F.col("nth")).alias("row"), F.array(F.concat(F.lit("ORD-"), F.lpad(text("o_orderkey"), 9, "0")), text("o_custkey"), text("price"), text("day")).alias("own"))
    by_status = orders.groupBy("sheet", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("sheet").orderBy("o_orderstatus")).cast("long")
    beside = by_status.select("sheet", (2 + place).alias("row"), F.array(F.col("o_orderstatus"), text("n")).alias("beside"))
    names = orders.select("sheet").distinct()
    head = names.select("sheet", F.lit(2).cast("long").alias("row"), F.array(*map(F.lit, ("Order", "Customer", "Price", "Day"))).alias("own"))
    side = names.select("sheet", F.lit(2).cast("long").alias("row"), F.array(F.lit("Status"), F.lit("Orders")).alias("beside"))
    left, right = records.unionByName(head), small(materialise(beside.unionByName(side), "beside").withColumnsRenamed({"sheet": "_sheet", "row": "_row"}))
    empty = lambda n: F.array(*[none] * n)
    met = left.join(right, F.expr("sheet <=> _sheet AND row = _row"), "left")
    # what stands beside no record; both sides are one row for each row number, so a full join of all orders isn't needed
    alone = right.join(met.filter("beside IS NOT NULL").select("sheet", "row"), F.expr("_sheet <=> sheet AND _row = row"), "left_anti").select(F.col("_sheet").alias("sheet"), F.col("_row").alias("row"), F.lit(None).cast("array<string>").alias("own"), "beside")
    main = met.select("sheet", "row", "own", "beside").unionByName(alone).select("sheet", "row", F.concat(F.coalesce("own", empty(4)), empty(2), F.coalesce("beside", empty(2))).alias("cells"))
    title = names.select("sheet", F.lit(0).cast("long").alias("row"), F.array(F.concat(F.lit("Orders of priority "), "sheet")).alias("cells"))
    end = orders.groupBy("sheet").agg((at(F.count(F.lit(1)) - 1) + 3).alias("start"))
    years = orders.groupBy("sheet", F.year("day").alias("year")).agg(F.sum("price").alias("total"))
    nth_year = F.row_number().over(Window.partitionBy("sheet").orderBy("year")).cast("long")
    below = years.withColumn("nth", nth_year).join(end, "sheet").select("sheet", (F.col("start") + F.col("nth")).alias("row"), F.array(F.concat(F.lit("Year "), text("year")), text("total")).alias("cells"))
    foot = end.select("sheet", F.col("start").alias("row"), F.array(F.lit("Period"), F.lit("Total")).alias("cells"))
    return title.unionByName(main).unionByName(foot).unionByName(below)


def sheet_tables(spark, sf_dir):
    """Every table of the sheets: where it lies and how its columns are called."""
    found = regions.tables(sheets(spark, sf_dir))
    name = F.concat_ws("|", "sheet", "region", "part")
    named = headings.find(found.select(name.alias("sheet"), "row", "cells", "marks", "fill"), marked=True).select(F.col("sheet").alias("name"), F.array_join("names", ",").alias("names"), "header")
    about = found.groupBy("sheet", "region", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.min("first_column").alias("first_column"))
    return about.withColumn("name", name).join(named, "name").drop("name")


def upright_sheets(spark, sf_dir):
    """All customers as a sheet per nation, every other sheet on its side, each turned upright."""
    customers = load(spark, sf_dir, "customer")
    text = lambda c: F.col(c).cast("string")
    cells = F.array(F.concat(F.lit("CUS-"), F.lpad(text("c_custkey"), 9, "0")), F.col("c_mktsegment"), F.col("c_acctbal").cast("decimal(18,2)").cast("string"), F.concat(F.lit("account of "), "c_name"))
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).cast("long")
    records = customers.select(text("c_nationkey").alias("sheet"), place.alias("row"), cells.alias("cells"))
    heads = customers.select(text("c_nationkey").alias("sheet")).distinct().select("sheet", F.lit(0).cast("long").alias("row"), F.array(*map(F.lit, ("Customer", "Segment", "Balance", "Name"))).alias("cells"))
    rows = materialise(records.unionByName(heads), "sheets")
    odd = F.col("sheet").cast("int") % 2 == 1
    found = orientation.upright(rows.filter(~odd).unionByName(orientation.transpose(rows.filter(odd))))
    return found.select("sheet", "row", F.array_join("cells", "|", "-").alias("cells"))


#: Columns of the tables that are compared, as they are spelled in text: amounts with two places, days as such.
SPELLED = {
    "customer": {"c_custkey": "", "c_name": "", "c_nationkey": "", "c_acctbal": "decimal(18,2)", "c_mktsegment": ""}, "supplier": {"s_suppkey": "", "s_name": "", "s_nationkey": "", "s_acctbal": "decimal(18,2)"},
    "part": {"p_partkey": "", "p_name": "", "p_brand": "", "p_type": "", "p_size": "", "p_retailprice": "decimal(18,2)"}, "nation": {"n_nationkey": "", "n_name": "", "n_regionkey": ""}, "region": {"r_regionkey": "", "r_name": ""},
    "orders": {"o_orderkey": "", "o_custkey": "", "o_orderstatus": "", "o_totalprice": "decimal(18,2)", "o_orderdate": "date", "o_orderpriority": ""},
    "lineitem": {"l_orderkey": "", "l_partkey": "", "l_suppkey": "", "l_linenumber": "", "l_quantity": "decimal(18,2)", "l_extendedprice": "decimal(18,2)", "l_discount": "decimal(18,2)", "l_tax": "decimal(18,2)", "l_returnflag": "", "l_linestatus": "", "l_shipdate": "date"}}


def spelled(spark, sf_dir):
    """All columns of seven tables as texts."""
    return {t: load(spark, sf_dir, t).select(*[F.col(c).cast(kind or "string").cast("string").alias(c) for c, kind in columns.items()]) for t, columns in SPELLED.items()}


def inclusion_dependencies(spark, sf_dir):
    return matching.inclusions(spelled(spark, sf_dir))


def suggested_keys(spark, sf_dir):
    return matching.suggested_keys(spelled(spark, sf_dir))


def paired_suppliers(spark, sf_dir):
    """Each part to one supplier and each supplier to one part, the pairs of largest quantity first."""
    lines = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    pairs = dealt(lines, lines.count(), "l_suppkey", "l_partkey").groupBy("l_suppkey", "l_partkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))
    return matching.assign(pairs, "l_suppkey", "l_partkey", "quantity").drop("round")


def merged_orders(spark, sf_dir):
    """All orders loaded, then merged with revised ones (finished orders at twice the price) and as many new ones, under a contract on what comes in."""
    price = F.col("o_totalprice").cast("decimal(18,2)")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", price.alias("price"))
    finished = orders.filter("o_orderstatus = 'F'").withColumn("price", (F.col("price") * 2).cast("decimal(18,2)"))
    came = finished.unionByName(finished.withColumn("o_orderkey", -F.col("o_orderkey") - 1))
    path = shared_dir(spark)
    loads.load(orders, path, "first", contract=loads.Contract(filled=("o_orderkey",)))
    loads.merge(came, path, "second", ["o_orderkey"], contract=loads.Contract(filled=("o_orderkey", "price"), used=("o_orderstatus",)))
    return loads.current(spark, path).select("o_orderkey", "o_orderstatus", "price", F.col("_load_id").alias("load"))


QUERIES = {f.__name__: f for f in (row_classes, sheet_tables, inclusion_dependencies, suggested_keys, paired_suppliers, merged_orders, upright_sheets)}

_VALUES = " UNION ALL ".join(f"SELECT '{t}.{c}' AS \"column\", nullif(trim(lower({f'{c}::{kind}' if kind else c}::VARCHAR)), '') AS value FROM {t}" for t, columns in SPELLED.items() for c, kind in columns.items())
_INCLUSIONS = f"""v AS ({_VALUES}), n AS (SELECT "column", value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY 1, 2),
        z AS (SELECT "column", count(*) AS "values", sum(n) AS filled FROM n GROUP BY 1),
        f AS (SELECT a."column", b."column" AS other, count(*) AS found FROM n a JOIN n b USING (value) WHERE split_part(a."column", '.', 1) <> split_part(b."column", '.', 1) GROUP BY 1, 2),
        i AS (SELECT f."column", other, z."values", found, round(found / z."values", 6) AS share, round(y."values" / y.filled, 6) AS uniqueness FROM f JOIN z ON f."column" = z."column" JOIN z y ON y."column" = other WHERE round(found / z."values", 6) >= 0.5)"""

ORACLES = {
    "upright_sheets": """
        SELECT c_nationkey::VARCHAR AS sheet, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS row, 'CUS-' || lpad(c_custkey::VARCHAR, 9, '0') || '|' || c_mktsegment || '|' || c_acctbal::DECIMAL(18,2) || '|account of ' || c_name AS cells FROM customer
        UNION ALL SELECT DISTINCT c_nationkey::VARCHAR, 0, 'Customer|Segment|Balance|Name' FROM customer""",
    "merged_orders": """
        WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice::DECIMAL(18,2) AS price FROM orders)
        SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 2 * price ELSE price END::DECIMAL(18,2) AS price, CASE WHEN o_orderstatus = 'F' THEN 'second' ELSE 'first' END AS load FROM o
        UNION ALL SELECT -o_orderkey - 1, o_orderstatus, (2 * price)::DECIMAL(18,2), 'second' FROM o WHERE o_orderstatus = 'F'""",
    "inclusion_dependencies": f"WITH {_INCLUSIONS} SELECT * FROM i",
    "row_classes": """
        WITH l AS (SELECT l_returnflag || l_linestatus AS sheet, l_orderkey, l_orderkey * 16 + l_linenumber AS row, l_extendedprice::DECIMAL(18,2) AS price FROM lineitem),
        e AS (SELECT sheet, (max(l_orderkey) + 1) * 16 AS row, sum(price) AS price FROM l GROUP BY sheet),
        u AS (SELECT sheet, row, price, 'record' AS kind FROM l UNION ALL SELECT sheet, l_orderkey * 16 + 15, sum(price) + CASE WHEN l_orderkey % 13 = 0 THEN 1 ELSE 0 END, 'total' FROM l GROUP BY sheet, l_orderkey
              UNION ALL SELECT sheet, row, price, 'grand' FROM e UNION ALL SELECT sheet, row + 1, NULL, 'footer' FROM e),
        n AS (SELECT *, row_number() OVER w - 1 AS idx, count(*) FILTER (kind <> 'record') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run,
                     sum(price) FILTER (kind = 'record') OVER w AS above, count(*) FILTER (kind = 'record') OVER w AS n_above, count(*) FILTER (kind = 'record') OVER (PARTITION BY sheet) AS records
              FROM u WINDOW w AS (PARTITION BY sheet ORDER BY row)),
        r AS (SELECT *, coalesce(sum(price) FILTER (kind = 'record') OVER v, 0) AS run_sum, count(*) FILTER (kind = 'record') OVER v AS run_rows FROM n WINDOW v AS (PARTITION BY sheet, run)),
        s AS (SELECT *, kind IN ('total', 'grand') AND run_rows > 0 AND run_sum = price AS hit FROM r),
        t AS (SELECT *, sum(price) FILTER (hit AND run_rows < records) OVER w AS subtotals, count(*) FILTER (hit AND run_rows < records) OVER w AS n_subtotals FROM s WINDOW w AS (PARTITION BY sheet ORDER BY row))
        SELECT sheet, row, idx, CASE WHEN kind = 'record' THEN 'DATA' WHEN kind = 'footer' THEN 'FOOTER' WHEN hit THEN CASE WHEN run_rows < records THEN 'SUBTOTAL' ELSE 'GRAND_TOTAL' END
                    WHEN n_above > 0 AND above = price OR n_subtotals > 0 AND subtotals = price THEN 'GRAND_TOTAL' WHEN kind = 'total' THEN 'UNVERIFIED_TOTAL' ELSE 'SPARSE_KEPT' END AS class,
               CASE WHEN kind IN ('total', 'grand') THEN CASE WHEN hit THEN run_rows WHEN n_subtotals > 0 AND subtotals = price THEN least(n_subtotals, CASE WHEN above = price THEN n_above ELSE n_subtotals END) WHEN above = price THEN n_above END END AS summed
        FROM t""",
    "sheet_tables": """
        WITH o AS (SELECT o_orderpriority AS sheet, count(*) AS n, count(DISTINCT o_orderstatus) AS statuses, count(DISTINCT year(o_orderdate)) AS years FROM orders GROUP BY 1),
        e AS (SELECT *, 2 + n + (n - 1) // 100 AS last FROM o)
        SELECT sheet, 2 AS region, 1 AS part, n + 1 AS rows, 2 AS first_row, last AS last_row, 0 AS first_column, 'order,customer,price,day' AS names, 0 AS header FROM e
        UNION ALL SELECT sheet, 2, 2, statuses + 1, 2, 2 + statuses, 6, 'status,orders', 0 FROM e
        UNION ALL SELECT sheet, 3, 1, years + 1, last + 3, last + 3 + years, 0, 'period,total', 0 FROM e""",
}
