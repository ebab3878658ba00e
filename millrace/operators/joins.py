"""Joins on cleaned keys, lookups with precedence, and discovery of what could be joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import code_number, given, join_key, name_key
from millrace.storage import free_names

#: Fixed value: the least share of a column's values that must be found.
OVERLAP_MIN = 0.5


def companion_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], prefix: str, how: str = "left", ignore_case: bool = True, pair: str | None = None) -> DataFrame:
    """left with the columns of right, named prefix.column, joined on cleaned keys.

    keys pair a column of left with one of right; with `pair`, rows match only if that column, which
    both hold, is equal too. Null and blank keys never match. how: left, inner or right, the latter
    being a left join of the swapped tables. The physical join is Catalyst's choice.
    """
    if how == "right":
        return companion_join(right, left, [(b, a) for a, b in keys], prefix, "left", ignore_case, pair)
    pair_name, *right_keys = free_names([*left.columns, *[f"{prefix}.{c}" for c in right.columns]], "_pair", *[f"_right_{i}" for i in range(len(keys))])
    other = right.select(
        *[join_key(F.col(f"`{b}`"), ignore_case).alias(name) for name, (_, b) in zip(right_keys, keys, strict=True)],
        *([F.col(f"`{pair}`").alias(pair_name)] if pair else []), *[F.col(f"`{c}`").alias(f"{prefix}.{c}") for c in right.columns])
    on = [join_key(F.col(f"`{a}`"), ignore_case) == F.col(name) for name, (a, _) in zip(right_keys, keys, strict=True)]
    on += [F.col(f"`{pair}`") == F.col(pair_name)] if pair else []
    return left.join(other, on, how).drop(pair_name, *right_keys)


def match_stats(joined: DataFrame, witness: str) -> DataFrame:
    """rows, matched and unmatched of a left join; witness is a column of the right side's key."""
    return joined.agg(F.count(F.lit(1)).alias("rows"), F.count(F.col(f"`{witness}`")).alias("matched"), F.count_if(F.col(f"`{witness}`").isNull()).alias("unmatched"))


def first_per_key(df: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, which must be total for reruns to agree."""
    (place,) = free_names(df.columns, "_rank")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(place, rank).filter(F.col(place) == 1).drop(place)


def resolve(facts: DataFrame, reference: DataFrame, name: str, number: str, code: str | None = None) -> DataFrame:
    """facts with ref_number, ref_name and outcome by a reference of (number, name, status).

    The name decides: a known name keeps, corrects or fills in the number, an unknown one is no_match. A number without a name is
    name_missing. Without either, the load's own `code` gives both (filled_name), else no_match. With an empty reference all is unavailable.
    Names and numbers come back as the row states them, numbers padded. Of several entries for a number or a name an active one wins, then
    the smaller pair. Other columns may be called anything but the three.
    """
    ref = reference.select(code_number(F.col("number")).alias("number"), given(F.col("name")).alias("name"), (F.lower("status") == "active").alias("live"))
    order = [F.desc_nulls_last("live"), F.col("number"), F.col("name")]
    numbers = first_per_key(ref.filter("number IS NOT NULL AND name IS NOT NULL"), ["number"], order).select(F.col("number").alias("_by_number"), F.col("name").alias("_its_name"))
    named = first_per_key(ref.withColumn("key", name_key(F.col("name"))).filter("key IS NOT NULL AND number IS NOT NULL"), ["key"], order).select(F.col("key").alias("_by_name"), F.col("number").alias("_its_number"))
    rows = facts.select(
        F.struct(*[F.col(f"`{c}`") for c in facts.columns]).alias("_row"), given(F.col(f"`{name}`")).alias("_name"), code_number(given(F.col(f"`{number}`").cast("string"))).alias("_number"),
        (code_number(F.col(f"`{code}`").cast("string")) if code else F.lit(None).cast("string")).alias("_code")).withColumn("_key", name_key(F.col("_name")))
    own = F.col("_name").isNull() & F.col("_number").isNull()
    rows = rows.join(named, F.col("_key") == F.col("_by_name"), "left").join(numbers, own & (F.col("_code") == F.col("_by_number")), "left")
    empty = ref.filter("number IS NOT NULL OR name IS NOT NULL").isEmpty()
    outcome = (
        F.when(F.lit(empty), "unavailable")
        .when(F.col("_name").isNotNull() & F.col("_its_number").isNull(), "no_match")
        .when(F.col("_name").isNotNull(), F.when(F.col("_number").isNull(), "filled_number").when(F.col("_number") == F.col("_its_number"), "kept").otherwise("corrected"))
        .when(F.col("_number").isNotNull(), "name_missing").when(F.col("_its_name").isNotNull(), "filled_name").otherwise("no_match"))
    return rows.select(
        "_row.*", F.when(own, F.when(F.col("_its_name").isNotNull(), F.col("_code"))).otherwise(F.coalesce("_its_number", "_number")).alias("ref_number"),
        F.coalesce("_name", "_its_name").alias("ref_name"), outcome.alias("outcome"))


def distinct_values(df: DataFrame, sample: int | None = None) -> DataFrame:
    """(column_name, value) of the distinct cleaned values of each column; with sample, the smallest of each column."""
    parts = F.array(*[F.struct(F.lit(c).alias("column_name"), join_key(F.col(f"`{c}`")).alias("value")) for c in df.columns])
    values = df.select(F.explode(parts).alias("p")).select("p.*").filter("value IS NOT NULL").distinct()
    if sample is None:
        return values
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy(F.xxhash64("value"), "value"))
    return values.withColumn("_rank", rank).filter(F.col("_rank") <= sample).drop("_rank")


def key_overlap(left: DataFrame, right: DataFrame, sample: int | None = None) -> DataFrame:
    """Per pair of columns that share values: the share of left's distinct values (or of a random `sample` of them) that right holds."""
    l, r = distinct_values(left, sample), distinct_values(right).withColumnRenamed("column_name", "right_column")
    sizes = l.groupBy("column_name").agg(F.count(F.lit(1)).alias("tried"))
    shared = l.join(r, "value").groupBy("column_name", "right_column").agg(F.count(F.lit(1)).alias("found"))
    return shared.join(sizes, "column_name").select(F.col("column_name").alias("left_column"), "right_column", "tried", "found", F.round(F.col("found") / F.col("tried"), 6).alias("share"))


def best_keys(left: DataFrame, right: DataFrame, least: float = OVERLAP_MIN) -> DataFrame:
    """The right column that holds most of each left column's values, if it holds at least the share `least`, and
    right_unique: whether no value repeats in it, so that a join can't multiply rows. Of equals the first by name."""
    best = first_per_key(key_overlap(left, right).filter(F.col("share") >= least), ["left_column"], [F.desc("share"), F.col("right_column")])
    parts = F.array(*[F.struct(F.lit(c).alias("right_column"), join_key(F.col(f"`{c}`")).alias("value")) for c in right.columns])
    times = right.select(F.explode(parts).alias("p")).select("p.*").filter("value IS NOT NULL").groupBy("right_column", "value").agg(F.count(F.lit(1)).alias("n"))
    unique = times.groupBy("right_column").agg((F.max("n") == 1).alias("right_unique"))  # a row per column
    return best.join(F.broadcast(unique), "right_column").select("left_column", "right_column", "tried", "found", "share", "right_unique")


def missing_keys(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Rows of left whose cleaned key right doesn't hold; blank keys never match."""
    other = right.select(*[join_key(F.col(f"`{b}`")).alias(f"_right_{i}") for i, (_, b) in enumerate(keys)])
    on = [join_key(F.col(f"`{a}`")) == F.col(f"_right_{i}") for i, (a, _) in enumerate(keys)]
    return left.join(other, on, "left_anti")


def row_changes(new: DataFrame, old: DataFrame, by: list[str], most: float = 10.0) -> DataFrame:
    """Groups whose number of rows differs by more than `most` per cent between a new load and the old one.

    new_rows, old_rows and change (per cent of the old, two places); a group without old rows has no change and isn't shown.
    """
    count = lambda df, name: df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    both = count(new, "new_rows").join(count(old, "old_rows"), by, "full").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("new_rows", "old_rows")})
    change = F.round((F.col("new_rows") - F.col("old_rows")) * 100.0 / F.nullif(F.col("old_rows"), F.lit(0)), 2).cast("double")
    return both.withColumn("change", change).filter(F.abs("change") > most)


def overlapping(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Pairs of periods (id, start, end) of a and b, equal in key, that have a day in common.

    The key keeps this an equi-join; covers says whether a's period holds all of b's.
    """
    b = b.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("id").alias("other_id"), F.col("start").alias("other_start"), F.col("end").alias("other_end"))
    on = [F.col(k) == F.col(f"_{k}") for k in key] + [F.col("start") <= F.col("other_end"), F.col("other_start") <= F.col("end")]
    covers = (F.col("start") <= F.col("other_start")) & (F.col("end") >= F.col("other_end"))
    return a.join(b, on).withColumn("covers", covers).drop(*[f"_{k}" for k in key])
