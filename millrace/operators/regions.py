"""Tables inside sheets: runs of rows that belong together, then runs of columns inside them.

Sheets are rows of cells, rows(sheet, row, cells: array<string>). Blank rows cut a sheet into runs; a run belongs to the table above it if both fill the
same columns with the same kinds of values. Each cell is read once, to a letter; rows whose letters are alike are counted together, and all else follows from
these counts. What is needed of a run is small - its last rows' kinds, how many cells its rows fill; one pass over the runs of a sheet, in order and
with a state of constant size, decides. Columns are cut in the same way, from one row per column. Rows themselves are only ever counted, joined and sliced.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import cells as C
from millrace.operators.numbering import numbered
from millrace.storage import materialise, small

# Least shares of common columns and of equal kinds, of common rows of two blocks side by side; the widest gap inside a table; rows of
# decoration; rows that a block's kinds are taken from; the least rows of a table; a list without a second column.
PROFILE_MATCH, COVERAGE_MATCH, EXTENT_MATCH, GUTTER = 0.7, 0.7, 0.75, 1
JUNK_ROWS, PROFILE_ROWS, TABLE_ROWS = 2, 5, 2
LIST_ROWS, LIST_SHARE = 10, 0.9


@lru_cache(10_000)
def _kinds(marks: str) -> list[str | None]:
    """The kinds of a line of marks."""
    return [C.KINDS.get(mark.lower()) for mark in marks]


@lru_cache(10_000)
def _profile(lines: tuple[str, ...]) -> dict[int, str]:
    """The most frequent kind of each column filled in the lines of marks, of equals the first met. Runs of a table are mostly alike, so it is kept."""
    columns: dict[int, Counter] = {}
    for line in lines:
        for at, kind in enumerate(_kinds(line)):
            if kind is not None:
                columns.setdefault(at, Counter())[kind] += 1
    return {at: kinds.most_common(1)[0][0] for at, kinds in columns.items()}


def _family(kind: str) -> str:
    return "number" if kind in ("int", "float") else kind


def _modal(fills: Counter) -> int:
    return max(fills, key=lambda f: (fills[f], f), default=0)


class Block:
    """What is known of the rows of a table so far: their number, fills, last rows, and whether a lone row reads like labels."""

    def __init__(self, run: dict[str, Any]) -> None:
        self.rows, self.fills, self.labels = 0, Counter(), run["labels"]
        self.first, self.tail = None, deque(maxlen=PROFILE_ROWS)
        self.add(run)

    def add(self, run: dict[str, Any]) -> None:
        tail = run["tail"]
        if not self.rows:
            self.first = run["first_marks"]
            tail = tail[1:] if len(tail) == run["rows"] else tail
        self.tail.extend(tail)
        self.rows += run["rows"]
        for fill, n in run["fills"].items():
            self.fills[fill] += n

    def profile(self) -> dict[int, str]:
        """Of the last rows but for the first, which may be a header; of the first if there is no other."""
        return _profile(tuple(self.tail) if self.rows > 1 else (self.first,))


def _heads(line: list[str | None], profile: dict[int, str]) -> bool:
    """Whether a lone row of labels stands over exactly the columns that a profile fills, and is unlike them."""
    own = {at for at, kind in enumerate(line) if kind is not None}
    if not profile.keys() <= own or len(own - profile.keys()) > len(own) // 4:
        return False
    return sum(line[at] != kind for at, kind in profile.items()) >= 0.5 * len(profile)


def continues(above: Block, below: Block) -> bool:
    """Whether a run of rows belongs to the table above it."""
    one, other = above.profile(), below.profile()
    if above.rows == 1 and above.labels and _heads(_kinds(above.first), other):
        return True
    if _modal(below.fills) < _modal(above.fills) and below.rows <= JUNK_ROWS and other.keys() <= one.keys():
        return True
    shared, every = one.keys() & other.keys(), one.keys() | other.keys()
    alike = sum(_family(one[at]) == _family(other[at]) for at in shared)
    return bool(shared) and len(shared) >= COVERAGE_MATCH * len(every) and alike >= PROFILE_MATCH * len(shared)


def _number_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sheet, block, region = None, None, 0
    for b in batches:
        out = []
        for run in b.to_pylist(maps_as_pydicts="strict"):
            new = Block(run)
            if block is None or sheet != (run["sheet"],):
                sheet, region, block = (run["sheet"],), 1, new
            elif continues(block, new):
                block.add(run)
            else:
                region, block = region + 1, new
            out.append(region)
        yield pa.record_batch([b.column("sheet"), b.column("run"), pa.array(out, pa.int64())], ["sheet", "run", "region"])


def _on(side: str, *keys: str) -> Column:
    return F.expr(" AND ".join(f"{k} <=> _{side}_{k}" for k in keys))


def _side(df: DataFrame, side: str, *keys: str) -> DataFrame:
    """df with its keys renamed for a join by _on()."""
    return df.withColumnsRenamed({k: f"_{side}_{k}" for k in keys})


def read(rows: DataFrame) -> DataFrame:
    """rows(sheet, row, cells) that aren't blank: cells stripped, marks (a letter per cell), fill (the effective one), and whether a row is labels alone."""
    lines = C.marked(rows.select("sheet", "row", "cells"))
    labels = (C.filled_marks(F.col("marks")) >= 2) & ~F.lower("marks").rlike(f"[^{C.LETTERS['text']}{C.NUMBER_TEXT}{C.BLANK}]")
    lines = materialise(lines.select("sheet", "row", F.col("texts").alias("cells"), "marks", "fill", F.when(labels, C.brevity(F.col("cells")) == 1).otherwise(F.lit(False)).alias("labels")), "read")
    return lines.filter("fill > 0")


def row_regions(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows(sheet, row, cells): the rows of read() with idx (place among them, from 0) and run; the region (from 1) of each run: runs of rows that are one table; patterns of each run.

    A pattern is how often rows with the same marks, fill and labels occur in a run, with the first and last idx; one each for every
    remainder of idx by the number of rows that end a run, so that the rows which do are among the last ones.
    """
    rows, ending = numbered(read(rows), ["sheet"], ["row"], nth="idx").withColumn("run", F.col("row") - F.col("idx")), PROFILE_ROWS + 1
    patterns = rows.groupBy("sheet", "run", (F.col("idx") % ending).alias("turn"), "marks", "fill", "labels").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"), F.max("idx").alias("last"))
    patterns = materialise(patterns, "patterns")
    turns = patterns.groupBy("sheet", "run", "turn").agg(F.sum("n").alias("rows"), F.max(F.struct("last", "marks")).alias("tail"), F.min(F.struct("first", "marks", "labels")).alias("head"))
    spans = turns.groupBy("sheet", "run").agg(F.sum("rows").alias("rows"), F.min("head").alias("head"), F.array_sort(F.collect_list("tail")).alias("tail"))  # six rows at most
    fills = patterns.groupBy("sheet", "run", "fill").agg(F.sum("n").alias("n")).groupBy("sheet", "run").agg(F.map_from_entries(F.collect_list(F.struct("fill", "n"))).alias("fills"))  # as many as the sheet is wide
    ends = F.transform(F.filter("tail", lambda t: t["last"] > F.element_at("tail", -1)["last"] - ending), lambda t: t["marks"])
    runs = spans.join(_side(fills, "f", "sheet", "run"), _on("f", "sheet", "run")).select(
        "sheet", "run", F.col("head.first").alias("first"), "rows", "fills", ends.alias("tail"), F.col("head.marks").alias("first_marks"), F.col("head.labels").alias("labels"))
    runs = runs.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sheet").sortWithinPartitions("sheet", "first")  # one record per run of rows
    found = materialise(runs.mapInArrow(_number_runs, f"sheet {rows.schema['sheet'].dataType.simpleString()}, run long, region long"), "regions")
    return rows, found, patterns


def with_region(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with the region of their run: that of most runs of their sheet but for the others, so that a long table doesn't cost a lookup row per run."""
    usual = found.groupBy("sheet", "region").agg(F.count(F.lit(1)).alias("n")).groupBy("sheet").agg(F.max_by("region", F.struct("n", "region")).alias("_usual"))
    usual = small(_side(usual, "u", "sheet"))
    other = found.join(usual, _on("u", "sheet")).filter(F.col("region") != F.col("_usual")).select("sheet", "run", F.col("region").alias("_other"))
    placed = rows.join(usual, _on("u", "sheet")).join(small(_side(other, "o", "sheet", "run")), _on("o", "sheet", "run"), "left")
    return placed.select(*rows.columns, F.coalesce("_other", "_usual").alias("region"))


def _cut_columns(columns: list[dict], pairs: list[dict], labels: list[dict]) -> list[tuple[int, int]]:
    """(column, part) of the filled columns of a region: parts are tables side by side."""
    at_row: dict[int, dict[int, str]] = {}
    for label in labels:
        at_row.setdefault(label["idx"], {})[label["col"]] = label["label"]

    def first_labels(inside: set[int]) -> set[str]:
        """The labels of the first row with two or more texts in some columns."""
        first = min((p["idx"] for p in pairs if p["left"] in inside and p["right"] in inside), default=None)
        return {text for col, text in at_row.get(first, {}).items() if col in inside and text} if first is not None else set()

    runs: list[list[dict]] = []
    for c in sorted(columns, key=lambda c: c["col"]):
        if runs and runs[-1][-1]["col"] == c["col"] - 1:
            runs[-1].append(c)
        else:
            runs.append([c])
    extent = lambda run: (min(c["first"] for c in run), max(c["last"] for c in run))
    parts = [list(runs[0])]
    for before, run in zip(runs, runs[1:], strict=False):
        left, right = extent(before), extent(run)
        common = min(left[1], right[1]) - max(left[0], right[0]) + 1
        match = common > 0 and common / max(left[1] - left[0] + 1, right[1] - right[0] + 1) >= EXTENT_MATCH
        gutter = left == right or (run[0]["col"] - before[-1]["col"] - 1 <= GUTTER and match)
        # a header that says the same again is another table's
        span = set(range(parts[-1][0]["col"], parts[-1][-1]["col"] + 1))
        if gutter and len(first_labels(span) & first_labels({c["col"] for c in run})) >= 2:
            gutter = False
        parts[-1].extend(run) if gutter else parts.append(list(run))
    return [(c["col"], number) for number, part in enumerate(parts, 1) for c in part]


def column_parts(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """(sheet, region, part, columns) of the regions in patterns(sheet, region, marks, first, last): the columns of each table, ascending; blank ones between them are left out.

    rows(sheet, idx, cells, marks) are those that the patterns count.
    """
    keys = ["sheet", "region"]
    patterns = patterns.groupBy(*keys, "marks").agg(F.min("first").alias("first"), F.max("last").alias("last")).withColumn("letters", C.letters(F.col("marks")))
    columns = patterns.select(*keys, "first", "last", F.posexplode("letters").alias("col", "mark")).filter(F.col("mark") != C.BLANK).groupBy(*keys, "col").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    columns = columns.groupBy(*keys).agg(F.collect_list(F.struct("col", "first", "last")).alias("columns"))  # as many as the sheet is wide
    no_number = lambda mark: F.lower(mark).isin(*[C.LETTERS[k] for k in ("date_string", "id_string", "text")])
    texts = F.array_compact(F.transform("letters", lambda mark, i: F.when(no_number(mark), i)))
    beside = F.transform(F.slice("at", 1, F.greatest(F.size("at") - 1, F.lit(0))), lambda c, i: F.struct(c.alias("left"), F.get("at", i + 1).alias("right")))
    pairs = patterns.select(*keys, "first", texts.alias("at")).select(*keys, "first", F.explode(beside).alias("p")).groupBy(*keys, "p.left", "p.right").agg(F.min("first").alias("idx"))
    heads = pairs.select(*keys, F.col("idx").alias("_h_idx")).distinct().withColumnRenamed("sheet", "_h_sheet")
    label = F.regexp_replace(F.lower("cell"), "[^a-z0-9]", "")
    lines = rows.select("sheet", "idx", "cells", "marks").join(small(heads), _on("h", "sheet", "idx")).select(*keys, "idx", F.posexplode(F.arrays_zip("cells", C.letters(F.col("marks")).alias("mark"))).alias("col", "c"))
    labels = lines.select(*keys, "idx", "col", F.col("c.cells").alias("cell"), F.col("c.mark").alias("mark")).filter(no_number(F.col("mark")))
    labels = labels.groupBy(*keys).agg(F.collect_list(F.struct("idx", "col", label.alias("label"))).alias("labels"))  # a few rows
    pairs = pairs.groupBy(*keys).agg(F.collect_list(F.struct("left", "right", "idx")).alias("pairs"))
    facts = columns.join(_side(pairs, "p", *keys), _on("p", *keys), "left").join(_side(labels, "l", *keys), _on("l", *keys), "left").select(*keys, "columns", "pairs", "labels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(r["sheet"], r["region"], col, part) for r in b.to_pylist() for col, part in _cut_columns(r["columns"], r["pairs"] or [], r["labels"] or [])]
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (b.schema.field("sheet").type, pa.int64(), pa.int32(), pa.int32()), strict=True)], ["sheet", "region", "col", "part"])

    cut = facts.mapInArrow(run, f"sheet {rows.schema['sheet'].dataType.simpleString()}, region long, col int, part int")
    return cut.groupBy(*keys, "part").agg(F.array_sort(F.collect_list("col")).alias("columns"))


def tables(rows: DataFrame) -> DataFrame:
    """The rows of every table in the sheets of rows(sheet, row, cells): sheet, region, part, row, first_column and cells, its own alone.

    region counts the tables of a sheet from above, part those side by side from the left, both from 1. Blank rows, and rows that are blank in a
    table's columns, are left out. What can't be a table is too: fewer than two rows, titles and notes (rows that mostly fill one cell, unless they
    are ten or more values of one kind that isn't text; long sentences and comments under the first row). Null sheets are one sheet; an empty table gives no rows.
    Rows that share a sheet and a number stand one after the other. marks and fill, of the cells, spare headings.find() another look at them.
    """
    keys = ["sheet", "region", "part"]
    lines, found, patterns = row_regions(rows)
    parts = materialise(column_parts(lines, patterns.join(small(_side(found, "r", "sheet", "run")), _on("r", "sheet", "run"))), "parts")
    cut = with_region(lines, found).join(small(_side(parts, "p", "sheet", "region")), _on("p", "sheet", "region"))
    own = F.rpad(F.array_join(F.transform("columns", lambda c: F.substring(F.col("marks"), c + 1, F.lit(1))), ""), F.size("columns"), F.lit(C.BLANK))
    cut = cut.select(*keys, "row", "idx", F.col("fill").alias("whole"), C.filled_marks(F.col("marks")).alias("held"), F.get("columns", F.lit(0)).alias("first_column"), F.transform("columns", lambda c: F.get("cells", c)).alias("cells"), own.alias("marks"))
    fill = F.when(C.filled_marks(F.col("marks")) == F.col("held"), F.col("whole")).otherwise(C.effective_texts(F.col("cells")))
    cut = materialise(cut.withColumn("fill", fill).drop("whole", "held"), "tables").filter("fill > 0")
    patterns = materialise(cut.groupBy(*keys, "marks", "fill").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"), F.max("idx").alias("last")), "kinds")
    size = patterns.groupBy(*keys).agg(F.sum("n").alias("height"), F.min("first").alias("_top"), F.max(C.filled_marks(F.col("marks"))).alias("most"))
    fills = patterns.groupBy(*keys, "fill").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.max_by("fill", F.struct("n", "fill")).alias("modal"))
    kinds = patterns.select(*keys, "n", F.explode(C.letters(F.col("marks"))).alias("mark")).filter(F.col("mark") != C.BLANK).groupBy(*keys, C.marked_kind(F.col("mark")).alias("kind")).agg(F.sum("n").alias("n"))
    kinds = kinds.groupBy(*keys).agg(F.max_by("kind", "n").alias("kind"), F.max("n").alias("n"), F.sum("n").alias("all"))
    notes = patterns.join(small(_side(size.select(*keys, "_top"), "z", *keys)), _on("z", *keys)).filter("last > _top").groupBy(*keys).agg(F.bool_and(~F.col("marks").rlike("[a-z]")).alias("only_notes"))
    about = size.join(_side(fills, "f", *keys), _on("f", *keys)).join(_side(kinds, "k", *keys), _on("k", *keys)).join(_side(notes, "n", *keys), _on("n", *keys), "left")
    listed = (F.col("most") == 1) & (F.col("all") >= LIST_ROWS) & (F.col("kind") != "text") & (F.col("n") >= LIST_SHARE * F.col("all"))
    good = about.filter((F.col("height") >= TABLE_ROWS) & ~F.coalesce("only_notes", F.lit(False)) & ((F.col("modal") >= 2) | listed)).select(*keys)
    return cut.drop("idx").join(small(_side(good, "g", *keys)), _on("g", *keys), "left_semi")
