"""Which way up a table is: fields across the top, or down the first column.

Tables are rows(sheet, row, cells: array<string>). In an upright table each column holds one kind of value while each row is mixed, and the labels
of its first row don't repeat; a sideways one is the other way round. Both shares come from one aggregate of the cells. Turning a table over swaps the
coordinates of its cells, at any width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import cells as C
from millrace.operators import headings
from millrace.storage import materialise, small

# How far the scores must lie apart to decide alone, the least score of a header that decides otherwise and the lines it must be among, columns of a pivot and their filled share.
MARGIN, CLEAR, AMONG, PIVOT_COLUMNS, PIVOT_SHARE = 0.3, 0.65, 3, 3, 0.9
#: Marks of the kinds of values; whole numbers and decimals are one, a text that is a number all the same is a text.
FAMILIES = {"date_string": C.LETTERS["date_string"], "id_string": C.LETTERS["id_string"], "number": C.LETTERS["int"] + C.LETTERS["float"], "text": C.LETTERS["text"] + C.NUMBER_TEXT}


def transpose(rows: DataFrame) -> DataFrame:
    """rows with rows and columns swapped: sheet, row (the old column) and cells (by the old row, in order). Columns without a value become blank rows."""
    width = rows.groupBy("sheet").agg(F.max(F.size("cells")).alias("_width"))
    full = _with(rows, width, "sheet", "inner").filter("_width > 0")  # short rows get as many cells as the others, so a record's are just sorted
    line = F.concat("cells", F.array_repeat(F.lit(None).cast("string"), F.col("_width") - F.size("cells")))
    # all that is worked out of a line comes before the generator: beside it, it would be worked out for every cell
    lines = full.select("sheet", F.col("row").alias("_old"), F.xxhash64("cells").alias("_line"), line.alias("_cells"))
    cells = lines.select("sheet", "_old", "_line", F.posexplode("_cells").alias("row", "cell"))
    turned = cells.groupBy("sheet", "row").agg(F.sort_array(F.collect_list(F.struct("_old", "_line", "cell"))).alias("_cells"))  # a record is as wide as the sheet was high
    return turned.select("sheet", F.col("row").cast("long").alias("row"), F.col("_cells.cell").alias("cells"))


def _side(table: DataFrame, name: str) -> DataFrame:
    return table.withColumnRenamed("sheet", f"_{name}")


def _with(rows: DataFrame, table: DataFrame, name: str, how: str = "left") -> DataFrame:
    return rows.join(small(_side(table, name)), F.col("sheet").eqNullSafe(F.col(f"_{name}")), how).drop(f"_{name}")


def _marked(rows: DataFrame) -> DataFrame:
    """rows that aren't blank with texts, marks and effective fill of their cells, each of which is looked at once."""
    return materialise(C.marked(rows.select("sheet", "row", "cells")), "rows").filter("fill > 0")


def _count(letters: str) -> Column:
    """How many of the marks are one of the letters."""
    return F.length("marks") - F.length(F.translate("marks", letters + letters.upper(), ""))


def scores(rows: DataFrame) -> DataFrame:
    """sheet, row_score, column_score, records, fields and pivot of each table, titles above it left aside.

    row_score speaks for upright: the mean share of the commonest kind in the columns but the first, and the share of distinct values in the first
    row. column_score is the same of rows and of the first column. pivot: the first row ends with three or more different labels of one kind that isn't that of all
    labels before them, over numbers.
    """
    return _scores(_marked(rows))


def _scores(rows: DataFrame) -> DataFrame:
    start = rows.groupBy("sheet").agg(F.coalesce(F.min(F.when(F.col("fill") > 1, F.col("row"))), F.min("row")).alias("start"))
    body = _with(rows, start, "s").filter("row >= start").withColumn("head", F.col("row") == F.col("start"))
    filled = C.filled_marks(F.col("marks"))
    commonest = F.greatest(*map(_count, FAMILIES.values())) / filled
    held = F.array_compact("texts")
    per_row = body.groupBy("sheet").agg(
        F.avg(F.when(~F.col("head"), commonest)).alias("rows_alike"), F.max(F.when(F.col("head"), F.size(F.array_distinct(held)) / F.size(held))).alias("first_row"),
        F.max(F.when(F.col("head"), F.struct("cells", "texts", "marks"))).alias("first"), (F.count(F.lit(1)) - 1).alias("records"), F.max(F.size("cells")).cast("int").alias("fields"))
    # rows that are alike are counted before their cells are told apart; the marks of a wide row are one key, not a column each
    alike = body.groupBy("sheet", "head", "marks").agg(F.count(F.lit(1)).alias("n"))
    cells = alike.select("sheet", "head", "n", F.posexplode(F.split("marks", "")).alias("col", "mark")).filter(F.col("mark") != C.BLANK)
    family = F.coalesce(*[F.when(F.lower("mark").isin(*letters), name) for name, letters in FAMILIES.items()])
    counts = cells.groupBy("sheet", "col", family.alias("kind")).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(~F.col("head"), F.col("n"))), F.lit(0)).alias("below"))
    columns = materialise(counts.groupBy("sheet", "col").agg((F.max("n") / F.sum("n")).alias("alike"), F.sum(F.when(F.col("kind") == "number", F.col("below")).otherwise(0)).alias("numbers"), F.sum("below").alias("below")), "columns")
    across = columns.groupBy("sheet").agg(F.avg(F.when(F.col("col") > 0, F.col("alike"))).alias("columns_alike"))
    values = body.select("sheet", F.get("texts", F.lit(0)).alias("cell")).filter("cell IS NOT NULL").groupBy("sheet", "cell").agg(F.count(F.lit(1)).alias("n")).groupBy("sheet").agg((F.count(F.lit(1)) / F.sum("n")).alias("first_column"))
    # the kinds of the first row as one string: its end is as long as what the last letter can be trimmed off by
    kinds = F.lower(F.translate("first.marks", C.NUMBER_TEXT + C.NUMBER_TEXT.upper(), C.LETTERS["text"] * 2))
    found = per_row.withColumns({"size": F.size("first.cells"), "last": F.right(kinds, F.lit(1)), "lead": F.length(F.rtrim(kinds, F.right(kinds, F.lit(1))))}).withColumn("tail", F.col("fields") - F.col("lead"))
    heads = F.slice("first.texts", F.col("lead") + 1, F.greatest(F.col("size") - F.col("lead"), F.lit(0)))
    found = found.withColumn("labels", F.when((F.col("tail") >= PIVOT_COLUMNS) & (F.col("lead") > 0) & (F.col("size") == F.col("fields")) & (F.col("last") != C.BLANK), F.size(F.array_distinct(heads))))
    found = materialise(_with(_with(found.drop("first"), across, "a"), values, "v"), "lines")
    ends = _with(columns, found.select("sheet", "lead"), "l", "inner").filter("col >= lead").groupBy("sheet").agg(F.sum("numbers").alias("numbers"), F.sum("below").alias("below"))
    found = _with(found, ends, "e")
    pivot = (F.col("labels") == F.col("tail")) & (F.col("numbers") == F.col("below")) & (F.col("below") >= PIVOT_SHARE * F.col("tail") * F.col("records"))
    return found.select(
        "sheet", (F.coalesce("columns_alike", F.lit(0.0)) + F.coalesce("first_row", F.lit(0.0))).alias("row_score"), (F.coalesce("rows_alike", F.lit(0.0)) + F.coalesce("first_column", F.lit(0.0))).alias("column_score"),
        "records", "fields", F.coalesce(pivot, F.lit(False)).alias("pivot"))


def _clear(rows: DataFrame, name: str) -> DataFrame:
    """sheet and `name`: whether one of the first lines is a convincing header with a record below."""
    found = headings.find(rows)
    return found.select("sheet", F.coalesce((F.col("score") >= CLEAR) & (F.col("header") <= AMONG), F.lit(False)).alias(name))


def decide(rows: DataFrame) -> DataFrame:
    """scores() with transposed and decided_by.

    A pivot is upright. Scores that lie MARGIN apart decide. Closer ones leave a table upright that leans so and has a clear header, or that has one only as
    written; else it is sideways if it has fewer records than fields. Tables of one line or one column are upright. An empty table gives no rows.
    """
    rows = _marked(rows)
    found = materialise(_scores(rows), "scores")
    rows = rows.select("sheet", "row", "cells")
    close = found.filter((F.abs(F.col("row_score") - F.col("column_score")) < MARGIN) & ~F.col("pivot"))
    nothing = close.isEmpty()
    asked = None if nothing else materialise(rows.join(small(close.select(F.col("sheet").alias("_c"))), F.col("sheet").eqNullSafe(F.col("_c")), "left_semi"), "close")
    none = F.lit(None).cast("boolean")
    found = found.withColumns({"as_written": none, "turned": none}) if nothing else _with(_with(found, _clear(asked, "as_written"), "w"), _clear(transpose(asked), "turned"), "t")
    apart, lean = F.abs(F.col("row_score") - F.col("column_score")) >= MARGIN, F.col("row_score") >= F.col("column_score")
    written, turned = F.coalesce("as_written", F.lit(False)), F.coalesce("turned", F.lit(False))
    by = F.when((F.col("records") < 1) | (F.col("fields") < 2), "too small").when(F.col("pivot"), "pivot").when(apart, "scores").when(lean & written, "scores and header").when(written & ~turned, "header").otherwise("shape")
    sideways = F.when(by == "scores", ~lean).when(by == "shape", F.col("records") < F.col("fields")).otherwise(False)
    return found.select("sheet", "row_score", "column_score", "records", "fields", sideways.alias("transposed"), by.alias("decided_by"))


def upright(rows: DataFrame) -> DataFrame:
    """rows(sheet, row, cells) with every sideways table turned over; the others keep their rows."""
    rows = materialise(rows.select("sheet", "row", "cells"), "given")  # what makes them is done once
    turn = materialise(decide(rows).filter("transposed").select(F.col("sheet").alias("_turn")), "sideways")
    on = F.col("sheet").eqNullSafe(F.col("_turn"))
    return rows.join(small(turn), on, "left_anti").unionByName(transpose(rows.join(small(turn), on, "left_semi")))
