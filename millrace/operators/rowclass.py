"""Row classes of report-shaped tables: records, totals on several levels, footers, repeated headers, group labels.

Tables are rows of cells, rows(sheet, row, cells: array<string>). A record fills about as many cells as most rows of its
sheet; a row that fills far fewer is a candidate. Arithmetic decides about candidates. Each cell is read once, to a letter and a number, and rows that are
alike are counted together. Rows are numbered once; the records between two other rows are a segment, whose number is how many rows that aren't records
stand above, so the row below has the same one: one aggregate brings a candidate and the sum of what is right above it together, and what all rows above sum
to is a running total of segments. Records themselves never meet in a join. Nothing here needs a sheet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import cells as C
from millrace.operators.numbering import numbered
from millrace.storage import materialise, small

# Least share of the usual fill for a record, tolerances of sums, what makes a restated header, share of records under a group label.
SPARSE_RATIO, TOLERANCE, RELATIVE = 0.6, 0.01, 1e-9
HEADER_CONTRAST, HEADER_TEXTNESS, GROUP_BLANK_SHARE = 0.6, 0.8, 0.5
# Words that hint at a total or a footer. They never decide alone.
TOTAL_WORDS = r"(?i)\b(total|subtotal|sum|sub-total|gesamt|totale|suma)\b"
FOOTER_WORDS = r"(?i)(end of report|confidential|for queries|generated on|prepared by|page \d+)"
#: Segments whose running totals one window makes; totals of whole blocks are carried on from block to block.
BLOCK = 1 << 14
#: Classes of rows that aren't records.
DROPPED = ("FOOTER", "SUBTOTAL", "GRAND_TOTAL", "REPEATED_HEADER", "UNVERIFIED_TOTAL", "GROUP_LABEL")


def _read(rows: DataFrame) -> DataFrame:
    """rows with texts, kinds and numbers of their cells."""
    return rows.withColumn("_read", C.read(F.col("cells"))).select(*rows.columns, F.col("_read.text").alias("texts"), F.col("_read.kind").alias("kinds"), F.col("_read.number").alias("numbers"))


def _profile(rows: DataFrame) -> DataFrame:
    cells = rows.select("sheet", "row", F.posexplode("kinds").alias("col", "kind"))
    counts = cells.groupBy("sheet", "col", "kind").agg(F.when(F.col("kind").isNotNull(), F.count(F.lit(1))).otherwise(0).alias("n"), F.min("row").alias("first"))
    best = counts.groupBy("sheet", "col").agg(F.max_by("kind", F.struct("n", (-F.col("first")).alias("early"))).alias("kind"))
    return best.groupBy("sheet").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "kind"))), lambda p: p["kind"]).alias("profile"))  # as long as the sheet is wide


def profile(rows: DataFrame) -> DataFrame:
    """sheet and profile (array of kinds by column, null for an empty one): the most frequent kind of each column, of equals the one met first."""
    return _profile(_read(rows))


def usual_fill(rows: DataFrame) -> DataFrame:
    """sheet and modal: how many cells most rows of the sheet fill, of equally frequent numbers the larger; merged titles count as one."""
    counts = rows.select("sheet", C.effective_fill(F.col("cells")).alias("fill")).filter("fill > 0").groupBy("sheet", "fill").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("sheet").agg(F.max_by("fill", F.struct("n", "fill")).alias("modal"))


def _join(rows: DataFrame, per_sheet: DataFrame) -> DataFrame:
    """rows with the columns of per_sheet; a sheet without a row there keeps nulls."""
    other = per_sheet.withColumnRenamed("sheet", "_sheet")
    return rows.join(small(other), F.col("sheet").eqNullSafe(F.col("_sheet")), "left").drop("_sheet")


def _filled() -> Column:
    return C.filled_marks(F.col("marks"))


def _shapes(rows: DataFrame) -> DataFrame:
    """The rows that are alike (sheet, marks, fill, n_numbers) with their class by fill and kinds alone; SPARSE_KEPT is what arithmetic has yet to decide."""
    kinds = F.lower(F.translate("marks", C.NUMBER_TEXT + C.NUMBER_TEXT.upper(), C.LETTERS["text"] * 2))
    shapes = materialise(rows.groupBy("sheet", "marks", "fill", "n_numbers").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first")).withColumn("kinds", kinds), "shapes")
    modal = shapes.groupBy("sheet", "fill").agg(F.sum("n").alias("n")).groupBy("sheet").agg(F.max_by("fill", F.struct("n", "fill")).alias("modal"))
    cells = shapes.select("sheet", "n", "first", F.posexplode(F.split("kinds", "")).alias("col", "kind"))
    counts = cells.groupBy("sheet", "col", "kind").agg(F.when(F.col("kind") != C.BLANK, F.sum("n")).otherwise(0).alias("n"), F.min("first").alias("first"))
    best = counts.groupBy("sheet", "col").agg(F.max_by("kind", F.struct("n", (-F.col("first")).alias("early"))).alias("kind"))
    profile = best.groupBy("sheet").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "kind"))), lambda p: p["kind"]), "").alias("profile"))  # as long as the sheet is wide
    shapes = _join(_join(shapes, modal), profile)
    letters = lambda c: F.transform(F.split(c, ""), lambda k: F.when(k != C.BLANK, k))
    contrast = C.unlike(F.arrays_zip(letters("kinds").alias("own"), letters("profile").alias("below")))
    fill, texts = _filled(), F.length("kinds") - F.length(F.translate("kinds", C.LETTERS["text"], ""))
    restates = (fill >= 2) & (texts / fill >= HEADER_TEXTNESS) & (contrast >= HEADER_CONTRAST)
    least = F.greatest(F.col("modal") * SPARSE_RATIO, F.when(F.length("profile") > 1, 2).otherwise(1))
    class_ = F.when(restates, "REPEATED_HEADER").when(fill >= least, "DATA").when((fill <= 1) & (F.col("n_numbers") == 0), "FOOTER").otherwise("SPARSE_KEPT")
    return shapes.select(F.col("sheet").alias("_s"), F.col("marks").alias("_m"), F.col("fill").alias("_f"), F.col("n_numbers").alias("_n"), class_.alias("class"))


def _echoed(header: Column) -> Column:
    """Whether a row restates the labels of a known header."""
    folded = lambda texts: F.transform(F.array_compact(texts), F.lower)
    labels = F.transform(header, C.stripped)
    pairs = F.filter(F.arrays_zip(F.col("texts").alias("own"), labels.alias("label")), lambda p: p["own"].isNotNull() & p["label"].isNotNull())
    echoes = C.let(pairs, lambda held: (F.size(held) >= 2) & F.forall(held, lambda p: F.lower(p["own"]) == F.lower(p["label"])))
    return F.coalesce(header.isNotNull() & ((folded("texts") == folded(labels)) | echoes), F.lit(False))


def _numbers(rows: DataFrame, *extra: str) -> DataFrame:
    """sheet, idx, extra, col and value of every number."""
    return rows.select("sheet", "idx", *extra, F.posexplode("numbers").alias("col", "value")).filter("value IS NOT NULL")


def _whole(value: str) -> Column:
    return F.rint(F.col(value))


def _part(value: str) -> Column:
    return F.col(value) - F.rint(F.col(value))


def _near(whole: str, part: str, value: str) -> Column:
    """Whether a sum, kept as the sums of whole numbers and of what is left of them, so that long columns lose no cents, is a value."""
    return F.abs((F.col(whole) - _whole(value)) + (F.col(part) - _part(value))) <= TOLERANCE


def _runs_above(values: DataFrame, member: Column, wanted: Column) -> DataFrame:
    """sheet, idx, col of the wanted values that are the sum of the unbroken run of members right above them, with `rows` of the run.

    values are (sheet, idx, col, value); a run breaks where idx does, and at a member without a value.
    """
    marked = values.withColumn("is_member", member.cast("int")).withColumn("wanted", wanted).filter("is_member = 1 OR wanted")
    ranked = materialise(numbered(marked, ["sheet", "col"], ["idx"], nth="_place", sums={"before": "is_member"}), "ranked")
    runs = ranked.filter("is_member = 1").groupBy("sheet", "col", (F.col("idx") - F.col("before")).alias("run")).agg(F.max("idx").alias("last"), F.sum(_whole("value")).alias("whole"), F.sum(_part("value")).alias("part"), F.count(F.lit(1)).alias("rows"))
    runs = runs.select(F.col("sheet").alias("_sheet"), F.col("col").alias("_col"), "last", "whole", "part", "rows")
    asked = ranked.filter("wanted").select("sheet", "idx", "col", "value")
    found = asked.join(runs, F.col("sheet").eqNullSafe(F.col("_sheet")) & (F.col("col") == F.col("_col")) & (F.col("idx") - 1 == F.col("last")))
    return found.filter(_near("whole", "part", "value")).select("sheet", "idx", "col", "rows")


def _segments(rows: DataFrame) -> DataFrame:
    """sheet, segment and col with the sum (whole, part) of the records' numbers, n and first (their least idx), and value and at of the candidate below."""
    member = F.col("class") == "DATA"
    cells = _numbers(rows.filter(F.col("class").isin("DATA", "SPARSE_KEPT")), "segment", "class")
    of = lambda value: F.when(member, value)
    return materialise(cells.groupBy("sheet", "segment", "col").agg(
        F.coalesce(F.sum(of(_whole("value"))), F.lit(0.0)).alias("whole"), F.coalesce(F.sum(of(_part("value"))), F.lit(0.0)).alias("part"), F.count_if(member).alias("n"), F.min(of(F.col("idx"))).alias("first"),
        F.max(F.when(~member, F.col("value"))).alias("value"), F.max(F.when(~member, F.col("idx"))).alias("at")), "segments")


def _sums_right_above(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """sheet, idx, col of the candidates that sum the unbroken run of records right above them, with `rows` of the run."""
    asked = segments.filter("n > 0 AND at IS NOT NULL")
    found = asked.filter((F.col("n") == F.col("at") - F.col("first")) & _near("whole", "part", "value")).select("sheet", F.col("at").alias("idx"), "col", F.col("n").alias("rows"))
    broken = asked.filter(F.col("n") != F.col("at") - F.col("first")).select(F.col("sheet").alias("_s"), F.col("segment").alias("_g"), F.col("col").alias("_c"))
    if broken.isEmpty():
        return found
    # a record without a value breaks the run inside its segment: there, and only there, values are put in order
    values = _numbers(rows.filter(F.col("class").isin("DATA", "SPARSE_KEPT")), "segment", "class")
    values = materialise(values.join(small(broken), F.col("sheet").eqNullSafe(F.col("_s")) & (F.col("segment") == F.col("_g")) & (F.col("col") == F.col("_c")), "left_semi"), "broken")
    return found.unionByName(_runs_above(values, F.col("class") == "DATA", F.col("class") == "SPARSE_KEPT"))


def _sums_of_all_above(others: DataFrame, segments: DataFrame) -> DataFrame:
    """sheet, idx, col of the candidates that are the sum of all records above them, or of all subtotals, with `rows`, how many those are."""
    none, zero, is_sub = F.lit(None), F.lit(0.0), F.col("class") == "SUBTOTAL"
    ends = _numbers(others.filter(F.col("class").isin("SPARSE_KEPT", "SUBTOTAL")), "segment", "class")
    of = lambda value: F.when(is_sub, value).otherwise(zero)
    ends = ends.select("sheet", "segment", "col", zero.alias("whole"), zero.alias("part"), F.lit(0).cast("long").alias("n"), of(_whole("value")).alias("sub_whole"), of(_part("value")).alias("sub_part"), is_sub.cast("long").alias("subs"), F.when(~is_sub, F.col("value")).alias("value"), F.when(~is_sub, F.col("idx")).alias("at"))
    inner = segments.filter("n > 0").select("sheet", "segment", "col", "whole", "part", "n", zero.alias("sub_whole"), zero.alias("sub_part"), F.lit(0).cast("long").alias("subs"), none.cast("double").alias("value"), none.cast("long").alias("at"))
    sums, keys = ["whole", "part", "n", "sub_whole", "sub_part", "subs"], ["sheet", "col", "block"]
    each = ends.unionByName(inner).withColumn("block", F.floor(F.col("segment") / BLOCK))
    blocks = each.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], F.count("at").alias("asked"))
    ahead = Window.partitionBy("sheet", "col").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    before = materialise(blocks.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"_{c}") for c in sums], "asked").filter("asked > 0"), "blocks")
    each = each.join(small(before), F.expr(" AND ".join(f"{k} <=> _{k}" for k in keys)))
    # records of its own segment and all subtotals of other ones stand above a candidate; it is neither itself
    inside = Window.partitionBy(*keys).orderBy("segment").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    summed = each.select("sheet", "col", "value", "at", *[(F.sum(c).over(inside) + F.col(f"_{c}")).alias(c) for c in sums]).filter("at IS NOT NULL")
    summed = materialise(summed, "running")
    hit = lambda whole, part, n: summed.filter((F.col(n) >= 1) & _near(whole, part, "value")).select("sheet", F.col("at").alias("idx"), "col", F.col(n).alias("rows"))
    return hit("whole", "part", "n").unionByName(hit("sub_whole", "sub_part", "subs"))


def _settle(rows: DataFrame, found: DataFrame, name: Column) -> DataFrame:
    """rows whose class becomes `name` where found(sheet, idx, col, rows) has them, by the first column that agrees."""
    first = found.groupBy("sheet", "idx").agg(F.min(F.struct("col", "rows")).alias("_hit")).select(F.col("sheet").alias("_s"), F.col("idx").alias("_i"), "_hit")
    rows = rows.join(small(first), F.col("sheet").eqNullSafe(F.col("_s")) & (F.col("idx") == F.col("_i")), "left")
    hit = F.col("_hit").isNotNull() & (F.col("class") == "SPARSE_KEPT")
    return rows.withColumns({"class": F.when(hit, name).otherwise(F.col("class")), "summed": F.when(hit, F.col("_hit.rows")).otherwise(F.col("summed")), "column": F.when(hit, F.col("_hit.col")).otherwise(F.col("column"))}).drop("_s", "_i", "_hit")


def _dense_total(rows: DataFrame, others: DataFrame) -> DataFrame:
    """_d (the sheet), _last and _above of the sheets whose last record sums the others, which makes it a grand total; above says how many those are.

    Every number of it must be its column's sum, and it must have fewer labels than any row above; or two and more are sums, not 0, and one at most is
    none, over two rows or more.
    """
    few = ["sheet", "idx", "class", "numbers", (_filled() - F.col("n_numbers")).alias("labels")]
    kept = rows.filter("class = 'DATA'").select(*few).unionByName(others.filter("class = 'SPARSE_KEPT'").select(*few))
    last = materialise(kept.groupBy("sheet").agg(F.max("idx").alias("last"), F.max_by("class", "idx").alias("last_class"), F.count(F.lit(1)).alias("kept")).filter("kept >= 2 AND last_class = 'DATA'"), "last")
    sides = _join(kept, last.select("sheet", "last")).filter("last IS NOT NULL").withColumn("is_last", F.col("idx") == F.col("last"))
    names = sides.groupBy("sheet").agg(F.max("last").alias("last"), F.max(F.when(F.col("is_last"), F.col("labels"))).alias("own"), F.min(F.when(~F.col("is_last"), F.col("labels"))).alias("least"), F.count_if(~F.col("is_last")).alias("above"))
    sums = _numbers(sides, "is_last").groupBy("sheet", "col").agg(F.sum(F.when(F.col("is_last"), F.col("value"))).alias("value"), F.coalesce(F.sum(F.when(~F.col("is_last"), F.col("value"))), F.lit(0.0)).alias("total")).filter("value IS NOT NULL")
    agrees = F.abs(F.col("total") - F.col("value")) <= F.greatest(F.lit(TOLERANCE), F.abs("value") * RELATIVE)
    votes = sums.groupBy("sheet").agg(F.count_if(agrees & (F.col("value") != 0)).alias("matched"), F.count_if(~agrees).alias("missed"))
    votes = _join(votes, names).filter("(matched >= 2 AND missed <= 1 AND above >= 2) OR (matched >= 1 AND missed = 0 AND own < least)")
    return materialise(votes.select(F.col("sheet").alias("_d"), F.col("last").alias("_last"), F.col("above").alias("_above")), "dense")


def classify(rows: DataFrame, headers: DataFrame | None = None, levels: int = 1, cells: bool = True) -> DataFrame:
    """rows(sheet, row, cells) with idx (the row's place in its sheet, from 0), class, level, summed and column.

    headers(sheet, header: array<string>) name the sheets' columns, if known. Classes are DATA; REPEATED_HEADER (the header, two or more of its
    labels in place, or text where the columns hold other kinds); SUBTOTAL and GRAND_TOTAL (a sparse row that sums the run of records above it, or all of
    them, or all subtotals above; a last record that sums the rest); UNVERIFIED_TOTAL (a sparse row that says so, but sums nothing);
    FOOTER; GROUP_LABEL (alone in the first column, above records that leave it blank); SPARSE_KEPT (a record with gaps). summed says how many rows
    a total adds up and column which column agreed. With `levels` above 1 a sparse row that sums the run of totals of one level right above it
    (records between them don't matter) is a subtotal of the next, level says which. Blank rows belong to no table and are left out. Null sheets are one
    sheet; rows equal in sheet and row keep their own idx in any order. An empty table gives no rows. Sums are of doubles. Without `cells` rows come
    without them, and they aren't carried through the sort.
    """
    texts = ["texts"] if headers is not None else []
    own = ["cells"] if cells else []
    lead = F.get(F.array_compact("texts"), F.lit(0))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = C.marked(rows.select("sheet", "row", "cells").repartition(n, "sheet", "row")).withColumn("numbers", C.numbers(F.col("texts")))  # few rows that cost much to read shouldn't lie in one task
    rows = rows.select("sheet", "row", *own, *texts, "marks", "fill", "numbers", F.size(F.array_compact("numbers")).alias("n_numbers"), lead.rlike(TOTAL_WORDS).alias("says_total"), lead.rlike(FOOTER_WORDS).alias("says_end"))
    rows = materialise(rows, "cells").filter("fill > 0")  # all that looks at texts, but for headers
    rows = rows.join(small(_shapes(rows)), F.expr("sheet <=> _s AND marks = _m AND fill = _f AND n_numbers = _n")).drop("_s", "_m", "_f", "_n")
    if headers is not None:
        rows = materialise(_join(rows, headers.select("sheet", "header")).withColumn("class", F.when(_echoed(F.col("header")), "REPEATED_HEADER").otherwise(F.col("class"))).drop("header", "texts"), "echoes")
    rows = rows.drop("fill").withColumn("is_data", (F.col("class") == "DATA").cast("int"))
    rows = numbered(rows, ["sheet"], ["row"], nth="idx", sums={"ahead": "is_data"}).drop("is_data")
    rows = materialise(rows.withColumn("segment", F.col("idx") - F.col("ahead")), "classes")

    # From here on records stay as they are; what changes is decided about the other rows
    nothing = {"summed": F.lit(None).cast("long"), "column": F.lit(None).cast("int"), "level": F.lit(0)}
    others = rows.filter("class <> 'DATA'").withColumns(nothing)
    wanted = F.col("class") == "SPARSE_KEPT"
    segments = _segments(rows)
    totals = rows.groupBy("sheet").agg(F.count_if(F.col("class") == "DATA").alias("records"))
    others = _join(_settle(others, _sums_right_above(rows, segments), F.lit("SUBTOTAL")), totals)
    whole = (F.col("class") == "SUBTOTAL") & (F.col("summed") == F.col("records"))
    others = others.withColumns({"class": F.when(whole, "GRAND_TOTAL").otherwise(F.col("class")), "level": F.when(F.col("class") == "SUBTOTAL", 1).otherwise(0)}).drop("records")
    others = materialise(others, "subtotals")
    for level in range(2, levels + 1):
        below = others.filter((F.col("level") == level - 1) | wanted).withColumn("at", F.col("idx")).drop("idx")
        below = numbered(below, ["sheet"], ["at"], nth="idx")  # totals of the level below stand side by side now
        found = _runs_above(_numbers(below, "class", "level"), F.col("level") == level - 1, wanted).filter("rows > 1")
        back = below.select(F.col("sheet").alias("_b"), F.col("idx").alias("_n"), "at")
        found = found.join(small(back), F.col("sheet").eqNullSafe(F.col("_b")) & (F.col("idx") == F.col("_n"))).select("sheet", F.col("at").alias("idx"), "col", "rows")
        others = _settle(others.withColumn("_was", F.col("class")), found, F.lit("SUBTOTAL"))
        others = materialise(others.withColumn("level", F.when((F.col("class") == "SUBTOTAL") & (F.col("_was") != "SUBTOTAL"), level).otherwise(F.col("level"))).drop("_was"), f"level-{level}")
    others = materialise(_settle(others, _sums_of_all_above(others, segments), F.lit("GRAND_TOTAL")), "totals")
    dense = small(_dense_total(rows, others))
    data = rows.filter("class = 'DATA'").join(dense, F.expr("sheet <=> _d AND idx = _last"), "left")
    others = _labels(others, data.filter("_last IS NULL"))
    kept = ["sheet", "row", *own, "idx"]
    records = data.select(*kept, F.when(F.col("_last").isNull(), "DATA").otherwise("GRAND_TOTAL").alias("class"), nothing["level"].alias("level"), F.col("_above").alias("summed"), nothing["column"].alias("column"))
    return records.unionByName(others.select(*kept, "class", "level", "summed", "column"))


def _labels(rows: DataFrame, data: DataFrame) -> DataFrame:
    """rows that aren't records with what is left decided by wording and place: unverified totals, group labels, footers; data are the records."""
    rows = rows.withColumn("class", F.when((F.col("class") == "SPARSE_KEPT") & F.col("says_total"), "UNVERIFIED_TOTAL").otherwise(F.col("class")))
    first = F.length("marks") - F.length(F.ltrim("marks", F.lit(C.BLANK)))
    heads = F.coalesce(F.substring("marks", 1, 1) != C.BLANK, F.lit(False))  # rows without a cell are blank and not here
    about = data.groupBy("sheet").agg(F.count(F.lit(1)).alias("records"), F.count_if(~heads).alias("blank"), F.min(first).cast("int").alias("key"), F.max("idx").alias("last_record"))
    about = materialise(about, "about")
    rows = _join(rows, about)
    trailing = (F.col("class") == "SPARSE_KEPT") & (F.col("idx") > F.col("last_record")) & (F.col("n_numbers") == 0)
    single = _filled() == 1
    alone = single & heads & (F.col("blank") / F.col("records") >= GROUP_BLANK_SHARE)
    rows = rows.withColumn("class", F.when(trailing, "FOOTER").otherwise(F.col("class")))

    # The records next to each footer: records are numbered, and `ahead` says how many stand above a row
    at_key = F.col("marks").substr(F.col("key") + 1, F.lit(1))
    keyed = (at_key != "") & (at_key != C.BLANK) & F.get("numbers", F.col("key")).isNull()
    footers = rows.filter((F.col("class") == "FOOTER") & ~trailing).select("sheet", "idx", "ahead", "key")
    sides = footers.select("sheet", "idx", "key", F.explode(F.array(F.struct((F.col("ahead") - 1).alias("number"), F.lit(True).alias("above")), F.struct(F.col("ahead").alias("number"), F.lit(False).alias("above")))).alias("s")).select("sheet", "idx", "key", "s.*")
    records = data.select(F.col("sheet").alias("_s"), F.col("ahead").alias("_n"), F.col("idx").alias("_at"), "marks", "numbers", (~heads).alias("_blank"))
    beside = records.join(small(sides), F.col("sheet").eqNullSafe(F.col("_s")) & (F.col("number") == F.col("_n")))
    beside = beside.groupBy("sheet", "idx").agg(F.bool_and(keyed).alias("_both"), F.count(F.lit(1)).alias("_sides"), F.bool_or(~F.col("above") & (F.col("_at") == F.col("idx") + 1) & F.col("_blank")).alias("_heads"))
    beside = beside.select(F.col("sheet").alias("_f"), F.col("idx").alias("_fi"), (F.col("_both") & (F.col("_sides") == 2)).alias("_between"), "_heads")
    rows = rows.join(small(materialise(beside, "beside")), F.col("sheet").eqNullSafe(F.col("_f")) & (F.col("idx") == F.col("_fi")), "left")
    footer = F.col("class") == "FOOTER"
    only_key = single & keyed & ~F.col("says_end") & ~F.col("says_total")
    class_ = F.when(footer & ~trailing & alone & F.coalesce("_heads", F.lit(False)), "GROUP_LABEL").when(footer & ~trailing & F.coalesce("_between", F.lit(False)) & only_key, "SPARSE_KEPT").otherwise(F.col("class"))
    return rows.withColumn("class", class_)


def carry_labels(classified: DataFrame) -> DataFrame:
    """The records of classify(), a blank first cell taking the group label above it."""
    marked = classified.withColumn("is_label", (F.col("class") == "GROUP_LABEL").cast("int"))
    marked = numbered(marked, ["sheet"], ["idx"], nth="_place", sums={"labels": "is_label"})
    labels = marked.filter("is_label = 1").select(F.col("sheet").alias("_s"), (F.col("labels") + 1).alias("_labels"), F.get("cells", F.lit(0)).alias("label"))
    rows = marked.filter(~F.col("class").isin(*DROPPED)).join(small(labels), F.col("sheet").eqNullSafe(F.col("_s")) & (F.col("labels") == F.col("_labels")), "left")
    first = F.coalesce(C.stripped(F.get("cells", F.lit(0))), F.col("label"))
    return rows.select("sheet", "row", F.when(F.size("cells") > 0, F.concat(F.array(first), F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0))))).otherwise(F.col("cells")).alias("cells"), "class")
