"""Matching columns or rows to one another: one-to-one assignment, and which columns' values lie in which others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import join_key
from millrace.storage import dealt, materialise, small

#: Fixed value: the least share of a column's values that another one must hold.
OVERLAP_MIN = 0.5
#: Columns whose bits a word of a set of columns holds.
WORD = 62


def assign(pairs: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """The pairs that are chosen if the best one is taken again and again, each left and each right once: left, right, score and round.

    Best is the highest score, of equals the smaller left, then the smaller right; that is what a loop over the sorted pairs would choose. In each round all pairs
    that are the best of both their sides are taken at once, and whatever shares a side with them leaves. Pairs with a null are none, of
    repeated ones the best counts. An empty table gives no rows. Pairs are dealt to tasks by their number, which is counted first. Rounds are as many as the longest chain of pairs that each wait for a better one.
    """
    a, b = F.col("a"), F.col("b")
    open_ = pairs.select(F.col(left).alias("a"), F.col(right).alias("b"), F.col(score).alias("s")).dropna()
    open_ = materialise(open_, "given")
    open_ = materialise(dealt(open_, open_.count(), "a", "b").groupBy("a", "b").agg(F.max("s").alias("s")), "pairs")
    chosen, number = None, 0
    while left_open := open_.count():
        number += 1
        rank = F.struct((-F.col("s")).alias("s"), "a", "b")
        mine = dealt(open_, left_open, "a").groupBy("a").agg(F.min(rank).alias("p")).select("p.*")
        theirs = dealt(open_, left_open, "b").groupBy("b").agg(F.min(rank).alias("p")).select("p.*")
        best = materialise(mine.intersect(theirs).select("a", "b", (-F.col("s")).alias("s"), F.lit(number).alias("round")), f"best-{number}")
        chosen = best if chosen is None else chosen.unionByName(best)
        for side in ("a", "b"):
            gone = best.select(F.col(side).alias("_gone"))
            open_ = open_.join(small(gone), F.col(side) == F.col("_gone"), "left_anti")
        open_ = materialise(open_, f"open-{number}")
    if chosen is None:
        return open_.select(a.alias(left), b.alias(right), F.col("s").alias(score), F.lit(0).alias("round"))
    return chosen.select(a.alias(left), b.alias(right), F.col("s").alias(score), "round")


def counted(tables: dict[str, DataFrame]) -> DataFrame:
    """at (place of a column among those of all tables), text and n: how often each text stands in each column, as written."""
    every, at = None, 0
    for table in tables.values():
        cells = F.array(*[F.struct(F.lit(i).alias("at"), F.col(f"`{c}`").cast("string").alias("text")) for i, c in enumerate(table.columns, at)])
        part = table.select(F.explode(cells).alias("p")).select("p.*").filter("text IS NOT NULL").groupBy("at", "text").agg(F.count(F.lit(1)).alias("n"))
        every, at = part if every is None else every.unionByName(part), at + len(table.columns)
    return every


def inclusions(tables: dict[str, DataFrame], least: float = OVERLAP_MIN) -> DataFrame:
    """Pairs of columns of different tables of which the second holds at least the share `least` of the first's values.

    Gives column and other (table.column), values (distinct ones of the first), found, share and uniqueness (distinct values of the other per filled row, 1: a join
    multiplies nothing). Values are compared as cleaned texts; blank ones count as none. Texts are counted per column as written and then cleaned, each once; a value
    is sent once, with a bit for each column that holds it, and values held by the same columns are counted together, so pairs are made of sets of columns, never of rows.
    """
    names = [(t, c) for t, table in tables.items() for c in table.columns]
    held = materialise(counted(tables).select("at", join_key(F.col("text")).alias("value"), "n").filter("value IS NOT NULL"), "values")
    filled = held.groupBy("at").agg(F.sum("n").alias("filled"))  # a row per column
    words = [f"word{w}" for w in range(-(-len(names) // WORD))]
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at") % WORD)
    marked = [F.bit_or(F.when(F.col("at").between(w * WORD, (w + 1) * WORD - 1), bit).otherwise(F.lit(0).cast("long"))).alias(word) for w, word in enumerate(words)]
    sets = held.groupBy("value").agg(*marked).groupBy(*words).agg(F.count(F.lit(1)).alias("n"))
    holds = F.array(*[F.call_function("shiftright", F.col(words[i // WORD]), F.lit(i % WORD)).bitwiseAND(F.lit(1)) == 1 for i in range(len(names))])
    columns = F.filter(F.transform(holds, lambda held, i: F.when(held, i)), lambda i: i.isNotNull())  # as many as there are columns
    sets = materialise(sets.select("n", columns.alias("columns")), "sets")
    single = sets.select("n", "columns", F.explode("columns").alias("at"))
    sizes = single.groupBy("at").agg(F.sum("n").alias("values"))
    table_of, name_of = F.array(*[F.lit(t) for t, _ in names]), F.array(*[F.lit(f"{t}.{c}") for t, c in names])
    pairs = single.select("n", "at", F.explode("columns").alias("to")).filter(F.get(table_of, F.col("at")) != F.get(table_of, F.col("to"))).groupBy("at", "to").agg(F.sum("n").alias("found"))
    theirs = sizes.join(F.broadcast(filled), "at").select(F.col("at").alias("to"), F.round(F.col("values") / F.col("filled"), 6).alias("uniqueness"))
    found = pairs.join(F.broadcast(sizes), "at").join(F.broadcast(theirs), "to").withColumn("share", F.round(F.col("found") / F.col("values"), 6)).filter(F.col("share") >= least)
    return found.select(F.get(name_of, F.col("at")).alias("column"), F.get(name_of, F.col("to")).alias("other"), "values", "found", "share", "uniqueness")


def suggested_keys(tables: dict[str, DataFrame], least: float = OVERLAP_MIN) -> DataFrame:
    """Of inclusions() one pair for each column and for each other one, the best first: the largest share counts, then uniqueness."""
    found = materialise(inclusions(tables, least), "inclusions")
    score: Column = F.col("share") * 2 + F.col("uniqueness")
    best = assign(found.withColumn("score", score), "column", "other", "score").select(F.col("column").alias("_c"), F.col("other").alias("_o"))
    return found.join(F.broadcast(best), (F.col("column") == F.col("_c")) & (F.col("other") == F.col("_o"))).drop("_c", "_o")  # a row per column
