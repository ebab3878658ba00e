"""Mixing sources to target weights along a time-varying curriculum.

Every source has a budget of words and a schedule, the relative rate at which it is drawn over
training time 0 to 1. The integral of the schedule is the source's cumulative demand; its
inverse gives each document - lined up in a fixed random order, again and again while the budget
lasts - the time at which it is due. Copies of documents range-sorted by that time are the mix.

DataFrame operations only. Running totals within a source are taken over slices of the order and
then over the slices' totals, so that no source, however large, meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialise, small

#: Rows of a slice of the order, about: slices are as many as the rows need.
SLICE_ROWS = 20_000
#: The order of documents within a source; the last two are a row's place in its file.
ORDER = ("order", "doc_id", "size", "content", "file", "at")
WORD = r"[^\x20\x09-\x0D]+"


def sources(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), repeats: int = 3, ramp: float = 0.5) -> DataFrame:
    """source, source_size, weight, target and slope of each source of sizes(source, size).

    Sources ordered by code point, null last, get the weights in turn. Targets share the total
    size by weight; a target stops at `repeats` times its source's size and the excess is shared
    again: some level L gives min(weight * L, repeats * size) with the right sum. Sources reach
    their limit in the order of limit / weight, so L follows from running sums in that order.

    slope is how much a source's rate rises over training: heavy sources fall by `ramp`, light
    ones rise by it, those between are steady. One row per source, and nothing else, is sorted in one task.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(place, F.lit(len(weights))) + 1).cast("long"))
    limit = F.col("source_size") * repeats
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, all_ = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(all_) - F.coalesce(F.sum("limit").over(before), F.lit(0))) / (F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # the first source, in this order, whose limit is out of reach fixes the level of all from there on
    per = per.withColumn("limit", limit).withColumn("own_level", level)
    per = per.withColumn("level", F.first(F.when(F.col("weight") * F.col("own_level") <= F.col("limit"), F.col("own_level")), ignorenulls=True).over(all_))
    target = F.least(F.col("limit").cast("double"), F.coalesce(F.col("weight") * F.col("level"), F.col("limit").cast("double")))
    slope = F.lit(ramp) * (1 - 2 * (F.col("weight") - min(weights)) / F.lit(max(1, max(weights) - min(weights))))
    return per.select("source", "source_size", "weight", target.alias("target"), slope.alias("slope"))


def due(share: Column, slope: Column) -> Column:
    """Training time at which a source has given `share` of its budget.

    At time t its rate is 1 + slope * (2t - 1), its demand t + slope * (t^2 - t); this is the
    root of demand = share.
    """
    root = (F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share) - (1 - slope)) / (2 * slope)
    return F.when(F.abs(slope) < 1e-9, share).otherwise(root)


def _settle(rows: DataFrame, repeats: int) -> DataFrame:
    """Add or take away the one copy of each source that brings its words nearest to the target."""
    missing = rows.groupBy(F.col("source").alias("_s"), F.col("target").alias("_t")).agg(F.sum(F.col("copies") * F.col("size")).alias("_took"))
    missing = missing.select("_s", (F.col("_t") - F.col("_took")).alias("_miss"))
    miss, size = F.col("_miss"), F.col("size")
    able = F.when(miss > 0, F.col("copies") < repeats).otherwise(F.col("copies") > 0) & (size > 0)
    after = F.abs(F.abs(miss) - size)
    ranked = rows.join(missing, F.col("source").eqNullSafe(F.col("_s"))).filter(able & (after < F.abs(miss)))
    best = ranked.groupBy("_s", "_miss").agg(F.min(F.struct(after.alias("after"), *ORDER)).alias("_best"))
    best = best.select("_s", F.signum("_miss").cast("int").alias("_step"), F.col("_best.file").alias("_file"), F.col("_best.at").alias("_at"))  # a row per source at most
    chosen = (F.col("file") == F.col("_file")) & (F.col("at") == F.col("_at"))
    best = small(best) or best
    return rows.join(best, chosen, "left").withColumn("copies", F.col("copies") + F.coalesce("_step", F.lit(0))).drop("_s", "_step", "_file", "_at")


def _measured(doc_id: Column, source: Column, text: Column) -> list[Column]:
    """What the plan needs of a document."""
    return [
        doc_id.cast("long").alias("doc_id"), source.cast("string").alias("source"), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.xxhash64(F.coalesce(text, F.lit(""))).cast("string"))).cast("binary")).alias("order"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("content")]


def _placed(sizes: DataFrame, repeats: int, **options) -> DataFrame:
    """sizes (those of _measured(), file and at) with source_size, target, copies and positions of each row."""
    n = sizes.count()
    digits = 1
    while 16**digits * SLICE_ROWS < n:
        digits += 1
    sizes = sizes.withColumn("slice", F.substring("order", 1, digits))
    within = Window.partitionBy("source", "slice").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    slices = sizes.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(F.col("source").alias("_source"), F.col("slice").alias("_slice"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
    rows = sizes.withColumn("behind", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(small(slices) or slices, F.col("source").eqNullSafe(F.col("_source")) & (F.col("slice") == F.col("_slice")))
    budget = sources(sizes, repeats=repeats, **options).withColumnRenamed("source", "_of")
    rows = rows.join(small(budget) or budget, F.col("source").eqNullSafe(F.col("_of")), "left")
    middle = F.col("ahead") + F.col("behind") + F.col("size") / 2
    copies = F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(F.lit(repeats), F.ceil((F.col("target") - middle) / F.col("source_size"))))).otherwise(0).cast("int")
    rows = rows.select(*sizes.columns, "source_size", "target", "slope", middle.alias("middle"), copies.alias("copies"))
    rows = _settle(materialise(rows, "rows"), repeats)
    share = lambda k: F.least(F.lit(1.0), (F.col("middle") + k * F.col("source_size")) / F.col("target"))
    positions = F.transform(F.sequence(F.lit(0), F.greatest("copies", F.lit(1)) - 1), lambda k: due(share(k), F.col("slope")))
    return rows.withColumn("positions", F.when(F.col("copies") > 0, positions).otherwise(F.array().cast("array<double>")))


def plan(docs: DataFrame, repeats: int = 3, **options) -> DataFrame:
    """One row per row of docs(doc_id, text, source): doc_id, size, source_size, target, copies,
    taken and positions (array<double>: when each copy is due).

    size is the number of words (runs of other than ASCII white space; 0 for null texts). A copy is
    taken if its middle lies before the source's target, so a source's words miss the target by
    half a document at most; then the one copy more or less that comes nearest is settled. The order within a
    source is that of md5(doc_id), or of the text's hash without one, then doc_id, size and a hash of the text: reruns agree. Rows alike in these are
    interchangeable. Empty documents are never taken. Null sources form a source of their own; an
    empty table gives no rows. Columns beside the three are ignored.
    """
    sizes = materialise(docs.select(*_measured(F.col("doc_id"), F.col("source"), F.col("text"))), "sizes")
    rows = _placed(sizes.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at")), repeats, **options)
    return rows.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "positions")


def _in_turn(copies: DataFrame) -> DataFrame:
    """copies(position, order, file, at, copy, ...) range-sorted by position and written, with `place`, each copy's number in the whole training order from 0."""
    by = ["position", "order", "file", "at", "copy"]
    held = materialise(copies.repartitionByRange(*by).sortWithinPartitions(*by), "schedule")
    held = held.select("*", F.col("_metadata.file_name").alias("_part"), F.col("_metadata.row_index").alias("_nth"))
    counts = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row per file; their names sort as the positions do
    before = counts.select(F.col("_part").alias("_file"), (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return held.join(F.broadcast(before), F.col("_part") == F.col("_file")).withColumn("place", F.col("_before") + F.col("_nth")).drop("_part", "_nth", "_file", "_before")


def schedule(planned: DataFrame) -> DataFrame:
    """One row per copy that plan() takes: doc_id, size, copy (from 1) and position, range-sorted by position."""
    copies = planned.select("doc_id", "size", F.posexplode("positions").alias("copy", "position")).withColumn("copy", F.col("copy") + 1)
    return copies.repartitionByRange("position", "doc_id", "copy").sortWithinPartitions("position", "doc_id", "copy", "size")


def scheduled(docs: DataFrame, repeats: int = 3, **options) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, and position and place of its first and last copy, read from the written order.

    taken counts the words of the copies that stand in the training order; a row without a copy takes none and has no place. Places count copies from 0, without
    gaps. Nulls, repeated rows and empty tables as in plan().
    """
    sizes = materialise(docs.select(*_measured(F.col("doc_id"), F.col("source"), F.col("text"))), "sizes")
    rows = materialise(_placed(sizes.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at")), repeats, **options), "plan")
    copies = _in_turn(rows.select("file", "at", "order", "size", F.posexplode("positions").alias("copy", "position")))
    ends = copies.groupBy(F.col("file").alias("_file"), F.col("at").alias("_at")).agg(
        F.sum("size").alias("taken"), F.min("position").alias("first_position"), F.max("position").alias("last_position"), F.min("place").alias("first_place"), F.max("place").alias("last_place"))
    found = rows.join(small(ends) or ends, (F.col("file") == F.col("_file")) & (F.col("at") == F.col("_at")), "left")
    return found.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_position", "last_position", "first_place", "last_place")


def mix(docs: DataFrame, repeats: int = 3, position: str | None = None, **options) -> DataFrame:
    """The rows of docs with all their columns, as often as the plan takes them, in training order.

    Copies get their own positions, and rows are range-sorted by them: partition after partition they come in
    the order in which they are due. `position` names a column that holds it. Documents without words weigh nothing
    and stay, once, behind all others, their position null. Rows are told apart by their place in a file that is
    written first, so repeated and null doc_ids are planned like any others. Nulls and empty tables as in plan().
    """
    if position and position.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the documents have a column {position} already")
    held = materialise(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), "held")
    held = held.select("row", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    sizes = materialise(held.select(*_measured(F.col("row.doc_id"), F.col("row.source"), F.col("row.text")), "file", "at"), "sizes")
    rows = _placed(sizes, repeats, **options).filter("copies > 0 OR size = 0")
    rows = materialise(rows.select(F.col("file").alias("_file"), F.col("at").alias("_at"), F.explode_outer("positions").alias("position"), "order"), "due")
    mixed = held.join(small(rows) or rows, (F.col("file") == F.col("_file")) & (F.col("at") == F.col("_at")))
    place = [F.col("position").asc_nulls_last(), F.col("order"), F.col("file"), F.col("at")]
    mixed = mixed.repartitionByRange(*place).sortWithinPartitions(*place)
    return mixed.select("row.*", *([F.col("position").alias(position)] if position else []))
