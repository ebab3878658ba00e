"""The registered queries of the engine and, where SQL can say it, the SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace import sheet_queries
from millrace.functions import dates, digest, numbers, text
from millrace.operators import joins, profile, reshape, review, rollup, totals, typing
from millrace.operators.transform import Target, quality, transform

Query = Callable[[SparkSession, str], DataFrame]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c, scale: int = 2):
    return c.cast(f"decimal(18,{scale})")


def monthly_rollup(spark, sf_dir):
    lines, orders = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders")
    customers, nations = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation")
    facts = lines.select("l_orderkey", "l_partkey", money(F.col("l_extendedprice")).alias("price"), money(F.col("l_discount")).alias("discount"), money(F.col("l_tax")).alias("tax"), "l_quantity")
    facts = facts.join(orders.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day")), F.col("l_orderkey") == F.col("o_orderkey"))
    facts = facts.join(customers.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(nations.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    out = rollup.monthly(facts, ["n_name"], "day", {"price": "price", "discount": "discount", "tax": "tax"}, {"l_orderkey": "orders", "l_partkey": "parts"}, {"day": "last_day"})
    sums = {c: F.col(c).cast("decimal(28,2)").cast("string") for c in ("price", "discount", "tax")}
    out = out.withColumns(sums | {"last_day": F.date_format("last_day", "yyyy-MM-dd")})
    return out.withColumn("row_hash", F.sha2(F.concat_ws("|", "n_name", "month", "price", F.col("orders").cast("string")), 256))


def column_profile_lineitem(spark, sf_dir):
    return profile.column_profile(load(spark, sf_dir, "lineitem").drop("l_shipdate"))


def column_profile_orders(spark, sf_dir):
    return profile.column_profile(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("priority")), by=["o_orderstatus"])


def _raw_dates(spark, sf_dir):
    """Order dates as text in several spellings, with junk among them."""
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 9
    spelled = (
        F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "M/d/yyyy")).when(k == 2, F.date_format(day, "d.M.yyyy"))
        .when(k == 3, F.date_format(day, "d MMM yyyy")).when(k == 4, F.date_format(day, "yyyyMMdd")).when(k == 5, F.date_diff(day, F.lit("1899-12-30").cast("date")).cast("string"))
        .when(k == 6, F.concat(F.lit(" "), F.date_format(day, "yyyy-MM-dd HH:mm:ss"))).when(k == 7, F.lit("13/45/1996")))
    return load(spark, sf_dir, "orders").select("o_orderkey", spelled.alias("raw"), F.to_date("o_orderdate").alias("day"))


def date_ladder(spark, sf_dir):
    return _raw_dates(spark, sf_dir).select("o_orderkey", "raw", F.date_format(dates.parse_date(F.col("raw")), "yyyy-MM-dd").alias("parsed"))


def date_role_stats(spark, sf_dir):
    rows = _raw_dates(spark, sf_dir)
    return profile.date_stats(rows, {"spelled": F.col("raw"), "plain": F.col("day").cast("string")})


def month_stats(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), "o_orderstatus", "o_orderkey")
    rows = rows.withColumns({"shipped": F.when(F.col("o_orderstatus") != "O", F.col("day")), "booked": F.when(F.col("o_orderkey") % 4 > 0, F.col("day"))})
    return profile.month_stats(rows, dates.month(F.when(F.col("o_orderkey") % 10 > 0, F.col("day"))), {"shipped": F.col("shipped"), "booked": F.col("booked")})


def _raw_amounts(spark, sf_dir):
    price, k = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_linenumber") % 8
    grouped = F.format_number(F.col("l_extendedprice"), 2)
    spelled = (
        F.when(k == 0, price.cast("string")).when(k == 1, F.concat(F.lit("$"), grouped)).when(k == 2, F.concat(F.lit("("), price.cast("string"), F.lit(")")))
        .when(k == 3, F.concat(price.cast("string"), F.lit("%"))).when(k == 4, F.concat(F.lit(" "), grouped, F.lit(" "))).when(k == 5, F.concat(price.cast("string"), F.lit("-"))).when(k == 6, F.lit("1,23,4.5")))
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", spelled.alias("raw"))


def amount_parse(spark, sf_dir):
    read = _raw_amounts(spark, sf_dir).withColumn("value", numbers.amount(F.col("raw")))
    return read.select("l_orderkey", "l_linenumber", "raw", numbers.fit(F.col("value"), 18, 2).cast("string").alias("amount"), numbers.fit(F.col("value"), 7, 1).cast("string").alias("short"))


def bool_int_parse(spark, sf_dir):
    k, n = F.col("o_orderkey") % 9, F.col("o_custkey").cast("string")
    raw = F.when(k == 0, "Yes").when(k == 1, " f ").when(k == 2, "1").when(k == 3, F.concat(n, F.lit(".0"))).when(k == 4, F.concat(n, F.lit(".5"))).when(k == 5, "n/a").when(k == 6, F.concat(n, F.lit("%"))).when(k == 7, "0.0")
    rows = load(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))
    return rows.select("o_orderkey", "raw", numbers.flag(F.col("raw")).alias("flag"), numbers.whole(F.col("raw")).alias("number"))


def invalid_names(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("d"), F.when(F.col("o_orderkey") % 3 == 0, "abc").otherwise("1.5").alias("n"))
    bad = profile.unreadable({"d": (F.col("d"), dates.parse_date(F.col("d"))), "n": (F.col("n"), numbers.amount(F.col("n")))})
    return rows.select("o_orderkey", F.array_join(bad, ",").alias("invalid_columns"))


def invalid_counts(spark, sf_dir):
    named = invalid_names(spark, sf_dir).select(F.explode(F.split("invalid_columns", ",")).alias("column_name")).filter("column_name <> ''")
    return named.groupBy("column_name").agg(F.count(F.lit(1)).alias("n"))


def row_hash(spark, sf_dir):
    rows = load(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit(" "), F.upper("c_name")).alias("c_name"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_mktsegment")).alias("segment"), money(F.col("c_acctbal")).alias("balance"))
    return rows.select("c_custkey", digest.row_digest(rows, ["c_name", "segment", "balance"]).alias("row_hash"))


def unpivot_measures(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(*[F.sum(F.when(F.quarter("o_orderdate") == q, money(F.col("o_totalprice")))).cast("decimal(28,2)").alias(f"q{q}") for q in range(1, 5)])
    return reshape.melt(rows, ["o_orderstatus"], [f"q{q}" for q in range(1, 5)], "period", labels={f"q{q}": f"Quarter {q}" for q in range(1, 5)}).withColumn("value", F.col("value").cast("string"))


def unpivot_all_years(spark, sf_dir):
    """Quarters per status and year over every order, undated ones too; unpivot_measures takes one year."""
    quarters, price = {f"q{q}": F.quarter("o_orderdate") == q for q in range(1, 5)} | {"undated": F.quarter("o_orderdate").isNull()}, money(F.col("o_totalprice"))
    rows = load(spark, sf_dir, "orders").groupBy("o_orderstatus", F.year("o_orderdate").alias("year")).agg(*[F.sum(F.when(held, price)).cast("decimal(28,2)").alias(c) for c, held in quarters.items()])
    return reshape.melt(rows, ["o_orderstatus", "year"], list(quarters), "period", labels={f"q{q}": f"Quarter {q}" for q in range(1, 5)} | {"undated": "Undated"}).withColumn("value", F.col("value").cast("string"))


def _with_totals(spark, sf_dir):
    """Counts by customer segment and order status, with a total row per segment."""
    orders, customers = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum(money(F.col("o_totalprice"))).cast("decimal(28,2)").alias("value"))
    total = rows.groupBy("c_mktsegment").agg(F.sum("n").alias("n"), F.sum("value").cast("decimal(28,2)").alias("value")).select("c_mktsegment", F.lit("TOTAL").alias("o_orderstatus"), "n", "value")
    return rows.unionByName(total).withColumn("line", F.when(F.col("o_orderstatus") == "TOTAL", "Z").otherwise(F.col("o_orderstatus")))


def total_rows_detect(spark, sf_dir):
    found = totals.total_rows(_with_totals(spark, sf_dir), ["c_mktsegment"], "line", ["n", "value"])
    return found.select("c_mktsegment", "o_orderstatus", "n", F.col("value").cast("string").alias("value"), "is_total")


def total_column_detect(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(*[F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity").cast("bigint")).otherwise(0)).alias(n) for f, n in (("A", "a"), ("N", "n"), ("R", "r"))], F.sum(F.col("l_quantity").cast("bigint")).alias("all_"))
    return totals.total_columns(rows, ["a", "n", "r", "all_"])


def running_total_check(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", money(F.col("l_extendedprice")).alias("price"))
    sums = rows.groupBy("l_orderkey").agg(F.sum("price").cast("decimal(18,2)").alias("price")).select("l_orderkey", F.lit(99).alias("l_linenumber"), "price")
    found = totals.running_check(rows.unionByName(sums), ["l_orderkey"], ["l_linenumber", "price"], "price")
    return found.select("l_orderkey", "l_linenumber", F.col("price").cast("string").alias("price"), F.col("sum_before").cast("string").alias("sum_before"), "is_subtotal")


def fill_down(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "signup", F.concat(F.lit("s"), F.col("event_id").cast("string"))).alias("label"))
    return reshape.fill_down(rows, "label", ["event_id"], ["user_id"])


def islands(spark, sf_dir):
    rows = load(spark, sf_dir, "events").filter(F.col("event_type").isin("view", "click")).select(F.col("event_id"), (F.col("event_id") / 1000).cast("bigint").alias("sheet"))
    return reshape.islands(rows, "event_id", ["sheet"])


def _messy_names(spark, sf_dir):
    name = F.when(F.col("c_custkey") % 3 == 0, F.upper("c_name")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("  "), F.replace(F.col("c_name"), F.lit("#"), F.lit("#")), F.lit(" "))).otherwise(F.col("c_name"))
    return load(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 11 > 0, name).alias("account"), "c_mktsegment", "c_nationkey")


def _named_orders(spark, sf_dir):
    return load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.concat(F.col("c_name"), F.lit(" ")).alias("buyer"))


def companion_join_left(spark, sf_dir):
    out = joins.companion_join(_named_orders(spark, sf_dir), _messy_names(spark, sf_dir), [("buyer", "account")], "brokers")
    return out.select("o_orderkey", F.col("`brokers.account`").alias("account"), F.col("`brokers.c_mktsegment`").alias("segment"))


def companion_join_inner(spark, sf_dir):
    out = joins.companion_join(_named_orders(spark, sf_dir), _messy_names(spark, sf_dir), [("buyer", "account")], "brokers", "inner")
    return out.select("o_orderkey", F.col("`brokers.account`").alias("account"), F.col("`brokers.c_nationkey`").alias("nation"))


def companion_join_right(spark, sf_dir):
    out = joins.companion_join(_named_orders(spark, sf_dir), _messy_names(spark, sf_dir), [("buyer", "account")], "sales", "right")
    return out.select("account", F.col("`sales.o_orderkey`").alias("o_orderkey"))


def join_match_stats(spark, sf_dir):
    out = joins.companion_join(_named_orders(spark, sf_dir), _messy_names(spark, sf_dir), [("buyer", "account")], "brokers")
    return joins.match_stats(out, "brokers.account")


def dup_key_report(spark, sf_dir):
    return profile.duplicate_keys(load(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"])


def lookup_resolve(spark, sf_dir):
    nations = load(spark, sf_dir, "nation")
    number = F.col("n_nationkey").cast("string")
    reference = nations.select(number.alias("number"), F.col("n_name").alias("name"), F.lit("Active").alias("status")).unionByName(nations.select(number.alias("number"), F.concat(F.col("n_name"), F.lit(" OLD")).alias("name"), F.lit("Closed").alias("status")))
    k = F.col("s_suppkey") % 6
    facts = load(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.when((k == 1) | (k == 3), None).when(k == 4, "999").when(k == 5, F.concat(F.lit("PC-"), (F.col("n_nationkey") + 1).cast("string"))).otherwise(number).alias("number"),
        F.when((k == 2), None).when(k == 3, "n/a").when(k == 4, "Nobody").when(k == 5, F.concat(F.col("n_name"), F.lit("  old"))).otherwise(F.concat(F.lit(" "), F.lower("n_name"))).alias("name"),
        F.concat(F.lit("PC0"), (F.col("s_suppkey") % 30).cast("string")).alias("pc"))
    return joins.resolve(facts, reference, "name", "number", "pc").select("s_suppkey", "ref_number", "ref_name", "outcome")


def key_overlap(spark, sf_dir):
    left = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    return joins.key_overlap(left, load(spark, sf_dir, "supplier"))


def key_overlap_best(spark, sf_dir):
    return joins.best_keys(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"), load(spark, sf_dir, "supplier"))


def period_overlap(spark, sf_dir):
    spans = load(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.min(F.to_date("o_orderdate")).alias("start"), F.max(F.to_date("o_orderdate")).alias("end")).withColumnRenamed("o_orderstatus", "id")
    found = joins.overlapping(spans, spans, ["o_custkey"]).filter("id < other_id")
    return found.select("o_custkey", "id", "other_id", "covers")


def stack_with_provenance(spark, sf_dir):
    """One table per year over every order, undated ones too, under one another: one scan, the table's name from the column that tells the tables apart."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("value"), F.year("o_orderdate").alias("year"))
    return reshape.stack_parts(orders, "year", "undated")


def schema_evolve_append(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    old = orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus")
    new = orders.filter("o_orderstatus <> 'F' OR o_orderstatus IS NULL").select("o_orderstatus", "o_orderkey", "o_orderpriority")
    return reshape.evolve(old, new)


def replace_supersede(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 13 > 0, F.col("o_orderstatus")).alias("load_id"))
    return reshape.supersede(orders, "load_id", ["P", "O"], orders.filter("load_id = 'O'").withColumn("load_id", F.lit("O2")))


def replace_month(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 7 > 0, dates.month(F.col("o_orderdate"))).alias("month"))
    return reshape.drop_months(orders, "o_orderstatus", ["O", "F"], "month", ["1996-03", "1997-11"])


def replace_rollup(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    old = orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    new = orders.filter("o_orderstatus = 'P'").agg(F.count(F.lit(1)).alias("n")).select(F.lit("P").alias("o_orderstatus"), (F.col("n") + 1000).alias("n"))
    return rollup.replace_groups(old, new, "o_orderstatus", "P")


def preview_search_sort(spark, sf_dir):
    parts = load(spark, sf_dir, "part")
    hit = F.lit(False)
    for c in parts.columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit("gear")), F.lit(False))
    size = F.when(F.col("p_size") % 5 > 0, F.col("p_size"))
    return parts.filter(hit).select("p_partkey", size.alias("size"), "p_type").orderBy(F.col("size").desc_nulls_last(), "p_partkey").offset(10).limit(50)


def first_samples(spark, sf_dir):
    """First three distinct values of event_type per user, in order of event_id."""
    seen = load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("at"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("at"))
    return seen.withColumn("nth", rank).filter("nth <= 3").select("user_id", "event_type", "nth")


def role_classify(spark, sf_dir):
    parts = None
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        e = profile.role_evidence(load(spark, sf_dir, name)).select(F.lit(name).alias("table_name"), "rows", "measures", "keys", "dates", "unique_rows")
        parts = e if parts is None else parts.unionByName(e)
    return parts.withColumn("role", profile.role(*[F.col(c) for c in ("rows", "measures", "keys", "dates", "unique_rows")]))


def header_names(spark, sf_dir):
    rows = load(spark, sf_dir, "part").select("p_partkey", F.concat(F.when(F.col("p_partkey") % 4 == 0, F.lit("2 ")).otherwise(F.lit(" ")), F.col("p_type"), F.lit(" (%)")).alias("header"))
    name = text.snake(F.col("header"))
    nth = F.row_number().over(Window.partitionBy("name").orderBy("p_partkey"))
    named = rows.withColumn("name", name).withColumn("nth", nth)
    return named.select("p_partkey", F.when(F.col("nth") > 1, F.concat_ws("_", "name", F.col("nth").cast("string"))).otherwise(F.col("name")).alias("name"), text.loose(F.col("header")).alias("loose"))


def pc_pad(spark, sf_dir):
    k, n = F.col("c_custkey") % 5, F.col("c_custkey").cast("string")
    raw = F.when(k == 0, F.concat(n, F.lit(".0"))).when(k == 1, F.concat(F.lit("00"), n)).when(k == 2, F.concat(n, F.lit("_01"))).when(k == 3, F.concat(F.lit(" X"), n, F.lit(" ")))
    return load(spark, sf_dir, "customer").select("c_custkey", text.pad_code(raw).alias("code"))


def name_keys(spark, sf_dir):
    k = F.col("s_suppkey") % 4
    raw = F.when(k == 0, F.concat(F.col("s_name"), F.lit(" – "), F.lit("East"))).when(k == 1, F.lit("N/A")).when(k == 2, F.concat(F.lit("\t"), F.upper("s_name"), F.lit("  Co")))
    return load(spark, sf_dir, "supplier").select("s_suppkey", text.name_key(raw).alias("name_key"))


def history_runs(spark, sf_dir):
    runs = load(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "error").alias("failed"), F.min("event_id").alias("first_id"), F.count(F.lit(1)).alias("events"))
    return runs.filter(F.col("failed") & (F.col("events") >= 3)).orderBy(F.desc("first_id")).limit(20).select("user_id", "first_id", "events")


def vector_cosine(spark, sf_dir):
    """Cosine of each vector with the smallest vector of vec_id 0, which comes to the driver."""
    rows = load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    first = rows.filter("vec_id = 0").agg(F.min("v")).first()[0]
    w = F.array(*map(F.lit, first)) if first else F.lit(None).cast("array<double>")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosine = dot(F.col("v"), w) / F.sqrt(dot(F.col("v"), F.col("v")) * dot(w, w))
    return rows.select("vec_id", F.round(cosine, 5).alias("cosine"))


def contracts_rows(spark, sf_dir):
    """Row accounting: what went in, what a filter of totals took and what the output holds, counted apart."""
    source = _with_totals(spark, sf_dir)
    marked = totals.total_rows(source, ["c_mktsegment"], "line", ["n", "value"])
    return totals.accounting(source, marked.filter("is_total"), marked.filter("NOT is_total"), ["c_mktsegment"])


def grain_signals(spark, sf_dir):
    rows = _with_totals(spark, sf_dir).select("c_mktsegment", "line", F.col("n").cast("string").alias("n"), F.format_number("value", 2).alias("value"))
    return totals.grain(rows, ["c_mktsegment", "line", "n", "value"], ["c_mktsegment"], "line")


def _raw_orders(spark, sf_dir):
    """Orders as an export writes them: every column a text, with odd spellings."""
    k, day = F.col("o_orderkey") % 4, F.to_date("o_orderdate")
    price = F.format_number("o_totalprice", 2)
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("order"), F.concat(F.lit("C-"), F.col("o_custkey").cast("string")).alias("account"),
        F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "yyyy/M/d")).when(k == 2, F.date_format(day, "d.M.yyyy")).otherwise(F.date_format(day, "dd/MM/yyyy")).alias("booked"),
        F.when(k == 0, F.concat(F.lit("$"), price)).when(k == 1, F.concat(F.lit("("), price, F.lit(")"))).otherwise(price).alias("amount"),
        F.translate(price, ",.", ".,").alias("betrag"), F.lpad((F.col("o_orderkey") % 90000).cast("string"), 5, "0").alias("zip"),
        F.when(k == 3, "n/a").otherwise((F.col("o_custkey") % 50).cast("string")).alias("count"), F.when(k == 1, "12AB").otherwise(F.col("o_custkey").cast("string")).alias("mixed"),
        F.date_format(day, "yyyyMMdd").alias("ship date"), F.lit(" ").alias("nothing"))


def typed_decisions(spark, sf_dir):
    rows = _raw_orders(spark, sf_dir)
    return typing.decide(typing.evidence(rows, rows.columns)).select("column_name", "kind", "note", "present", "european")


def typed_columns(spark, sf_dir):
    rows = _raw_orders(spark, sf_dir)
    out = typing.typed(rows, typing.decide(typing.evidence(rows, rows.columns)))
    return out.select(*[F.date_format(c, "yyyy-MM-dd").alias(c) if t == "date" else F.col(f"`{c}`") for c, t in out.dtypes]).withColumnRenamed("ship date", "ship_date")


CATALOGUE = [
    Target("order_number", "bigint", key=True), Target("account", "string", key=True), Target("booked", "date"), Target("amount", "decimal(18,2)"), Target("rate", "decimal(10,6)"),
    Target("booked_year", "int"), Target("booked_month", "int"), Target("urgent", "boolean"), Target("unmapped", "string")]


def _silver(spark, sf_dir):
    k, day = F.col("o_orderkey") % 6, F.to_date("o_orderdate")
    rows = load(spark, sf_dir, "orders").select(
        F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(".0")).alias("Order No"), F.when(k == 5, " ").otherwise(F.concat(F.lit("Acc "), F.col("o_custkey").cast("string"))).alias("Account"),
        F.when(k == 0, F.date_format(day, "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format(day, "M/d/yyyy")).when(k == 2, F.date_format(day, "yyyyMMdd")).when(k == 3, "31/31/2020").otherwise(F.date_format(day, "M-d-yyyy")).alias("Booked"),
        F.when(k == 0, F.concat(F.lit("($"), F.format_number("o_totalprice", 2), F.lit(")"))).when(k == 4, "5-").otherwise(F.format_number("o_totalprice", 2)).alias("Amount"), F.concat((F.col("o_custkey") % 100).cast("string"), F.lit("%")).alias("Rate"),
        F.when(k == 1, F.date_format(day, "MMMM")).alias("Month"), F.when(k == 2, "maybe").when(k < 2, "Y").otherwise("0.0").alias("Urgent"))
    mapping = {"order_number": "Order No", "account": "Account", "booked": "Booked", "amount": "Amount", "rate": "Rate", "booked_month": "Month", "urgent": "Urgent"}
    return transform(rows, mapping, CATALOGUE, {"booked_year": ("booked", "year"), "booked_month": ("booked", "month")})


def silver_transform(spark, sf_dir):
    out = _silver(spark, sf_dir)
    return out.withColumns({"booked": F.date_format("booked", "yyyy-MM-dd"), "amount": F.col("amount").cast("string"), "rate": F.col("rate").cast("string")})


def silver_quality(spark, sf_dir):
    return quality(_silver(spark, sf_dir), CATALOGUE)


def unpivot_spread(spark, sf_dir):
    """Sums of unpivoted quarters, spread again over one column per status."""
    long = unpivot_all_years(spark, sf_dir).withColumn("value", F.col("value").cast("decimal(28,2)"))
    return reshape.spread(long, ["year", "period"], "o_orderstatus", ["F", "O", "P"], "value").select("year", "period", *[F.col(c).cast("string").alias(c) for c in ("F", "O", "P")])


def empty_columns(spark, sf_dir):
    return profile.empty_columns(load(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") < 0, F.lit("x")).alias("nothing"), F.lit(None).cast("string").alias("none")))


def null_safe_changes(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")).alias("before"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderstatus")).alias("after"))
    return rows.filter(~F.col("before").eqNullSafe(F.col("after")))


def missing_keys(spark, sf_dir):
    """Customers without an urgent order, and how many there are by segment."""
    urgent = load(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    return joins.missing_keys(load(spark, sf_dir, "customer"), urgent, [("c_custkey", "o_custkey")]).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


def rows_per_month(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("pc"), dates.month(F.col("o_orderdate")).alias("month")).agg(F.count(F.lit(1)).alias("rows"))


def row_change_check(spark, sf_dir):
    """Months in which a new load, without every seventh order and with January's twice, differs from the old one by more than a tenth."""
    old = load(spark, sf_dir, "orders").withColumn("month", dates.month(F.col("o_orderdate")))
    new = old.filter("o_orderkey % 7 > 0").unionByName(old.filter(F.month("o_orderdate") == 1))
    return joins.row_changes(new, old, ["month"])


def _gapped_orders(spark, sf_dir):
    k = F.col("o_orderkey")
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", "o_custkey", F.to_date("o_orderdate").alias("day"), F.when(k % 3 > 0, F.col("o_orderpriority")).alias("priority"), F.when(k % 5 > 0, money(F.col("o_totalprice"))).alias("price"))


def outcome_counts(spark, sf_dir):
    return review.status_counts(lookup_resolve(spark, sf_dir), "outcome")


def common_priority(spark, sf_dir):
    return review.most_common(_gapped_orders(spark, sf_dir), "priority", "o_orderkey", ["o_custkey"])


def null_findings(spark, sf_dir):
    return review.null_findings(_gapped_orders(spark, sf_dir))


def fill_mode(spark, sf_dir):
    return review.fill_mode(_gapped_orders(spark, sf_dir), ["priority", "price", "day"], ["o_custkey"])


def fitness(spark, sf_dir):
    return review.fitness(_gapped_orders(spark, sf_dir).withColumn("passed", F.col("price") > 100000), "passed", ["o_orderstatus"])


def as_text(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", money(F.col("o_totalprice")).alias("price"), F.to_date("o_orderdate").alias("day"))
    return review.as_text(rows)


def ranked_candidates(spark, sf_dir):
    """The return flag that most of a supplier's quantity bears, unless another comes close."""
    votes = load(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("score"))
    return review.candidates(votes, ["l_suppkey"], "l_returnflag", "score", 10, 5)


def division_lookup(spark, sf_dir):
    """Nations as centres and regions as divisions; every third customer's code is that of a sub-office."""
    nations = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    table = nations.select(F.col("n_nationkey").alias("position"), F.col("r_name").alias("division"), F.concat(F.lit("PC"), F.col("n_nationkey").cast("string")).alias("profit_center"))
    number = F.col("c_nationkey").cast("string")
    facts = load(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("pc-00"), number, F.lit("_01"))).when(F.col("c_custkey") % 7 > 0, number).alias("code"))
    return review.divisions(facts, "code", table).select("c_custkey", F.array_join("divisions", ",").alias("divisions"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    monthly_rollup, column_profile_lineitem, column_profile_orders, month_stats, date_role_stats, date_ladder, amount_parse, bool_int_parse, invalid_names, invalid_counts, row_hash,
    unpivot_measures, unpivot_all_years, total_rows_detect, total_column_detect, running_total_check, fill_down, islands, companion_join_left, companion_join_inner, companion_join_right, join_match_stats,
    dup_key_report, lookup_resolve, key_overlap, key_overlap_best, period_overlap, stack_with_provenance, schema_evolve_append, replace_supersede, replace_month, replace_rollup, preview_search_sort,
    first_samples, role_classify, header_names, pc_pad, name_keys, history_runs, vector_cosine, contracts_rows, empty_columns, null_safe_changes, grain_signals, typed_decisions, typed_columns, silver_transform, silver_quality, unpivot_spread, missing_keys, rows_per_month, row_change_check,
    outcome_counts, common_priority, null_findings, fill_mode, fitness, as_text, ranked_candidates, division_lookup)}
QUERIES |= sheet_queries.QUERIES
