"""Header rows of tables: which row names the columns, and the names that follow from it.

Tables are rows(sheet, row, cells: array<string>). A header is unlike the rows below it: texts over other kinds of values, short, not repeated. So each of the
first rows is held against what lies below it, which is the whole table's counts less those of the first rows: a suffix profile per candidate
from one aggregate, whatever the table's length. Only the first rows are put in order; of the others it is known how often each pattern of kinds occurs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import cells as C
from millrace.storage import materialise, small

# Rows that may be the header, least scores of a first and second header row, what the second must be besides, and weights of the signs.
DEPTH, LEAST, SECOND_LEAST, SECOND_CONTRAST, SECOND_TEXTNESS = 20, 0.55, 0.55, 0.5, 0.5
WEIGHTS = {"contrast": 0.30, "textness": 0.25, "uniqueness": 0.20, "fill": 0.15, "brevity": 0.10}


def column_names(labels: list[str | None]) -> list[str]:
    """Unique names from labels: lower case, other characters as _, blank ones by position, whole numbers prefixed, repeated ones counted on."""
    names: list[str] = []
    uses: dict[str, int] = {}
    for place, label in enumerate(labels, 1):
        name = re.sub(r"[^a-z0-9]+", "_", (label or "").casefold()).strip("_") or f"column_{place}"
        name = f"col_{name}" if name.isdigit() else name
        while name in uses:
            uses[name] += 1
            name = f"{name}_{uses[name]}"
        uses[name] = 1
        names.append(name)
    return names


@F.pandas_udf(T.ArrayType(T.StringType()))
def _names(labels: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in labels:
        yield batch.map(lambda row: column_names(list(row)))


def _early(rows: DataFrame) -> DataFrame:
    """The first DEPTH rows of each sheet with idx, their place: only numbers of rows are sorted, within partitions first, and then the rows up to the last wanted one."""
    nth = lambda *order: F.row_number().over(Window.partitionBy("sheet").orderBy(*order)).alias("nth")
    edges = rows.select("sheet", "row").select("sheet", "row", nth("row")).filter(F.col("nth") <= DEPTH).groupBy("sheet").agg(F.max_by("row", "nth").alias("edge"))
    ahead = rows.join(small(edges.withColumnRenamed("sheet", "_s")), F.col("sheet").eqNullSafe(F.col("_s")) & ~F.coalesce(F.col("row") > F.col("edge"), F.lit(False)))
    return materialise(ahead.select("*", nth("row", "cells")).filter(F.col("nth") <= DEPTH).select("sheet", "row", "edge", "cells", "marks", "fill", (F.col("nth") - 1).cast("long").alias("idx")), "early")


def _patterns(rows: DataFrame, early: DataFrame) -> DataFrame:
    """sheet, marks, fill, n, early and late of the rows that are alike: how many there are, the places of those in early and the first number of the others."""
    edges = early.groupBy("sheet").agg(F.max_by("edge", "idx").alias("edge")).withColumnRenamed("sheet", "_s")
    keys = ["sheet", "marks", "fill"]
    later = rows.join(small(edges), F.col("sheet").eqNullSafe(F.col("_s"))).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("row") > F.col("edge"), F.col("row"))).alias("after"), F.count_if(F.col("row") == F.col("edge")).alias("at_edge"), F.first("edge").alias("edge"))
    own = early.groupBy(*keys).agg(F.array_sort(F.collect_list("idx")).alias("early"), F.count_if(F.col("row") == F.col("edge")).alias("own_edge"))  # DEPTH at most
    own = own.select(*[F.col(k).alias(f"_{k}") for k in keys], "early", "own_edge")
    met = later.join(own, F.expr(" AND ".join(f"{k} <=> _{k}" for k in keys)), "left")
    late = F.when(F.col("at_edge") > F.coalesce("own_edge", F.lit(0)), F.col("edge")).otherwise(F.col("after"))
    return materialise(met.select(*keys, "n", F.coalesce("early", F.array().cast("array<bigint>")).alias("early"), late.alias("late")), "patterns")


def _below(patterns: DataFrame, by: list[str], name: str) -> DataFrame:
    """sheet, at, by, name and n, first: how often each value of the column `name` stands below row `at` and where first, for the first DEPTH rows."""
    counts = patterns.filter(F.col(name).isNotNull()).groupBy("sheet", *by, name).agg(F.sum("n").alias("all"), F.flatten(F.collect_list(F.when(F.size("early") > 0, F.col("early")))).alias("early"), F.min("late").alias("late"))  # DEPTH at most
    each = counts.select("sheet", *by, name, "all", "early", "late", F.explode(F.sequence(F.lit(0), F.lit(DEPTH - 1))).alias("at"))
    n = F.col("all") - F.size(F.filter("early", lambda i: i <= F.col("at")))
    ahead = F.array_min(F.filter("early", lambda i: i > F.col("at")))
    first = F.struct(ahead.isNull().alias("late"), ahead.alias("at"), F.when(ahead.isNull(), F.col("late")).alias("row"))  # below the first rows, numbers of rows tell the order
    return each.select("sheet", "at", *by, name, n.alias("n"), first.alias("first")).filter("n > 0")


def scores(early: DataFrame, patterns: DataFrame) -> DataFrame:
    """sheet, idx, cells, score, contrast and textness of each row of _early() that has another below it."""
    cells = patterns.select("sheet", "n", "early", "late", F.posexplode(C.letters(F.col("marks"))).alias("col", "mark")).withColumn("kind", C.marked_kind(F.col("mark")))
    kinds = _below(cells, ["col"], "kind").groupBy("sheet", "at", "col").agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "kind")).alias("top"))
    profile = kinds.groupBy("sheet", "at").agg(F.collect_list(F.struct("col", F.col("top.kind").alias("kind"))).alias("profile"))  # as many as the sheet is wide
    fills = _below(patterns, [], "fill").groupBy("sheet", "at").agg(F.max_by("fill", F.struct("n", "fill")).alias("modal"))
    first = early.select("sheet", "idx", "cells")
    for t, n in ((profile, "p"), (fills, "f")):
        other = t.select(F.col("sheet").alias(f"_{n}s"), F.col("at").alias(f"_{n}at"), t.columns[-1])
        first = first.join(small(other), F.col("sheet").eqNullSafe(F.col(f"_{n}s")) & (F.col("idx") == F.col(f"_{n}at")))
    line = F.col("cells")
    contrast = C.let(F.transform(line, C.kind), lambda own: C.unlike(F.transform("profile", lambda p: F.struct(F.get(own, p["col"]).alias("own"), p["kind"].alias("below")))))
    parts = {"contrast": contrast, "textness": C.textness(line), "uniqueness": C.uniqueness(line), "fill": F.least(C.fill(line) / F.col("modal"), F.lit(1.0)), "brevity": C.brevity(line)}
    return first.select("sheet", "idx", "cells", F.round(sum(WEIGHTS[k] * v for k, v in parts.items()), 9).alias("score"), parts["contrast"].alias("contrast"), parts["textness"].alias("textness"))


def find(rows: DataFrame, marked: bool = False) -> DataFrame:
    """One row per table of rows(sheet, row, cells): sheet, header (place of the header row among the rows, from 0; null without one), depth (rows of
    the header), score, labels (as written, two rows joined by a blank) and names.

    The best of the first DEPTH rows, of equals the topmost, is the header if it scores LEAST; the row below joins it if it is labels over other kinds too. A
    table of one column is headed by a text or not at all. Every row below a candidate counts. Headers that are broken over more lines than
    two aren't joined. Blank rows count as none; null sheets are one table; an empty table gives no rows. marked: rows have stripped cells, marks and fill, as of regions.tables().
    """
    if not marked:
        rows = materialise(C.marked(rows.select("sheet", "row", "cells")).drop("texts"), "lines").filter("fill > 0")
    early = _early(rows)
    patterns = _patterns(rows, early)
    size = patterns.groupBy("sheet").agg(F.sum("n").alias("n"), F.max(F.length("marks")).alias("width"))
    scored = materialise(scores(early, patterns), "scores")
    best = scored.groupBy("sheet").agg(F.max_by(F.struct("idx", "score", "cells"), F.struct("score", (-F.col("idx")).alias("up"))).alias("best"))
    side = lambda t, n: t.withColumnRenamed("sheet", f"_{n}")
    found = size.join(side(best, "b"), F.col("sheet").eqNullSafe(F.col("_b")), "left")
    under = scored.filter((F.col("score") >= SECOND_LEAST) & (F.col("contrast") >= SECOND_CONTRAST) & (F.col("textness") >= SECOND_TEXTNESS)).select(F.col("sheet").alias("_u"), F.col("idx").alias("_ui"), F.col("cells").alias("second"))
    found = found.join(under, F.col("sheet").eqNullSafe(F.col("_u")) & (F.col("best.idx") + 1 == F.col("_ui")), "left")
    lead = F.get("best.cells", F.lit(0))
    heads = F.coalesce((F.col("best.score") >= LEAST) & ~((F.col("width") == 1) & (C.kind(lead) != "text")), F.lit(False))
    two = heads & F.col("second").isNotNull() & (F.col("best.idx") + 2 < F.col("n"))
    place = F.sequence(F.lit(0), F.col("width") - 1)
    at = lambda name: (lambda i: C.stripped(F.get(name, i)))
    label = lambda gap: F.transform(place, lambda i: F.nullif(F.concat_ws(gap, at("best.cells")(i), F.when(two, at("second")(i))), F.lit("")))
    none = F.transform(place, lambda i: F.lit(None).cast("string"))
    named = found.select(
        "sheet", F.when(heads, F.col("best.idx")).alias("header"), F.when(two, 2).when(heads, 1).otherwise(0).alias("depth"), F.coalesce("best.score", F.lit(0.0)).alias("score"),
        F.when(heads, label(" ")).otherwise(none).alias("labels"))
    return named.withColumn("names", _names("labels"))
