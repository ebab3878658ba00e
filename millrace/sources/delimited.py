"""Delimited text files of unknown encoding and separator, read as rows of cells.

Files are split among tasks as Spark's text source splits them. A quoted field may hold line breaks, so whether a line begins inside one depends on
all lines before it. Each task follows its split from both possible states, for each separator; a table of one row per split says which of them was
true, and the lines of a record meet again by the place of its first line. What is decided per file is a small aggregate of its lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.text import blank_to_null
from millrace.storage import small

# The separators in the order in which they are preferred, the lines they are judged by, and the texts of failed formulas.
SEPARATORS = (",", ";", "\t", "|")
OPENING = 20
ERRORS = ("#VALUE!", "#REF!", "#DIV/0!", "#N/A", "#NAME?", "#NULL!", "#NUM!")
#: The bytes 80 to 9F as Latin-1 and as Windows-1252 read them, but for those that the latter leaves open.
_HIGH = {chr(b): bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


#: The states in which a split can be read: each separator, outside and inside a quoted field.
STATES = [(s, inside) for s in SEPARATORS for inside in (False, True)]
_OPENS = {s: re.compile(rf'(?:(?!{re.escape(s)})\s)*"') for s in SEPARATORS}
_CLOSES = re.compile('[^"]*(?:""[^"]*)*"(?!")')


def ends_inside(line: str, separator: str, inside: bool) -> bool:
    """Whether a quoted field is still open at the end of a line. A quote opens a field only where the field begins."""
    at, begins = 0, not inside
    while True:
        if begins and (found := _OPENS[separator].match(line, at)):
            at, inside = found.end(), True
        if inside:
            if not (found := _CLOSES.match(line, at)):
                return True
            at, inside = found.end(), False
        at = line.find(separator, at) + 1
        if not at:
            return False
        begins = True


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to the lines of (file, block, raw), in the order of the files: nth in the split, and for each of STATES as bits whether the line begins
    and ends inside a field, and where in the split the record began whose line it is (-1: before it)."""
    key, nth = None, 0
    state, start = np.zeros(len(STATES), bool), np.zeros(len(STATES), np.int64)
    bits = 1 << np.arange(len(STATES))
    for b in batches:
        files, blocks, raw = b.column(0), b.column(1).to_numpy(), b.column(2)
        quoted = pc.match_substring(raw, '"').to_numpy(zero_copy_only=False)
        n = b.num_rows
        before, after, starts, place = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros((n, len(STATES)), np.int64), np.zeros(n, np.int64)
        new = np.ones(n, bool)
        new[:1] = True  # the first line of a batch is looked at, whatever it is
        new[1:] = (blocks[1:] != blocks[:-1]) | pc.not_equal(files.slice(1), files.slice(0, max(n - 1, 0))).to_numpy(zero_copy_only=False)
        events = np.flatnonzero(new | quoted).tolist()  # between them no state changes
        for at, to in zip(events, [*events[1:], n], strict=True):
            if at and new[at] or at == 0 and (files[0].as_py(), blocks[0]) != key:
                state, start, nth = np.array([inside for _, inside in STATES]), np.full(len(STATES), -1, np.int64), 0
            place[at:to] = np.arange(nth, nth + to - at)
            start = np.where(state, start, nth)
            starts[at], before[at] = start, bits[state].sum()
            if quoted[at]:
                line = raw[at].as_py().decode("latin-1")
                state = np.array([ends_inside(line, s, bool(inside)) for (s, _), inside in zip(STATES, state, strict=True)])
            after[at:to] = before[at + 1:to] = bits[state].sum()
            starts[at + 1:to] = np.where(state, start, place[at + 1:to, None])
            start, nth = np.where(state, start, nth + to - at - 1), nth + to - at
        if n:
            key = (files[n - 1].as_py(), blocks[n - 1])
        lists = pa.ListArray.from_arrays(np.arange(0, n * len(STATES) + 1, len(STATES), dtype=np.int32), starts.ravel())
        yield pa.record_batch([files, b.column(1), pa.array(place), raw, pa.array(before), pa.array(after), lists], ["file", "block", "nth", "raw", "before", "after", "starts"])


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, at (block and nth: sorts as the lines stand in their file), raw (bytes), and what follows from each of STATES: before, after, starts."""
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("raw"))
    found = read.mapInArrow(_follow, "file string, block long, nth long, raw binary, before int, after int, starts array<long>")
    return found.select("file", F.struct("block", "nth").alias("at"), "raw", "before", "after", "starts")


def records(texts: DataFrame) -> DataFrame:
    """file, at and text of each record of texts(file, separator, at, text, before, after, starts), other columns being the file's and kept.

    The lines of a quoted field are one record, with a line feed between. A quote that is never closed opens nothing: from its line on every line is a record.
    """
    def bit(mask: str, state: Column) -> Column:
        return F.call_function("shiftright", F.col(mask), state).bitwiseAND(F.lit(1)) == 1

    outside = F.element_at(F.create_map(*[x for k, (s, inside) in enumerate(STATES) if not inside for x in (F.lit(s), F.lit(k))]), F.col("separator"))
    own = [c for c in texts.columns if c not in ("at", "text", "before", "after", "starts")]
    # One row per split: in which state it ends, from each of its beginnings, and where the record began that is open then
    ends = texts.groupBy("file", "separator", "at.block").agg(F.max_by(F.struct("after", "starts"), "at.nth").alias("end"))
    ends = ends.select("file", "block", outside.alias("base"), "end.after", "end.starts")
    result = lambda k: F.struct(bit("after", F.col("base") + k).alias("inside"), F.get("starts", F.col("base") + k).alias("start"))
    ends = ends.select("file", "block", result(0).alias("from_outside"), result(1).alias("from_inside"))
    step = F.when(F.col("from_outside.inside") == F.col("from_inside.inside"), F.col("from_outside.inside"))  # known whatever came before
    order = Window.partitionBy("file").orderBy("block")  # a row per split
    upto, back = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flips = F.sum((step.isNull() & F.col("from_outside.inside")).cast("int"))
    ends = ends.withColumns({"flips": flips.over(back), "sure": step})
    ends = ends.withColumn("anchor", F.when(F.col("sure").isNotNull(), F.struct("sure", "flips")))
    last = F.last("anchor", ignorenulls=True)
    inside_after = lambda anchor: F.coalesce(anchor["sure"], F.lit(False)) != ((F.col("flips") - F.coalesce(anchor["flips"], F.lit(0))) % 2 != 0)
    ends = ends.withColumn("inside_after", inside_after(last.over(back)))
    ends = ends.withColumn("inside", F.coalesce(F.lag("inside_after").over(order), F.lit(False)))
    opened = F.when(F.col("inside"), F.col("from_inside.start")).otherwise(F.col("from_outside.start"))
    ends = ends.withColumn("open", F.when(F.col("inside_after") & (opened >= 0), F.struct("block", opened.alias("nth"))))
    ends = ends.withColumn("earlier", F.last("open", ignorenulls=True).over(upto))
    whole = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.withColumn("unclosed", F.when(F.last("inside_after").over(whole), F.last("open", ignorenulls=True).over(whole)))
    splits = ends.select(F.col("file").alias("_file"), F.col("block").alias("_block"), F.col("inside").cast("int").alias("_from"), F.col("earlier").alias("_earlier"), F.col("unclosed").alias("_unclosed"))

    found = texts.join(small(splits), (F.col("file") == F.col("_file")) & (F.col("at.block") == F.col("_block")))
    state = outside + F.col("_from")
    start = F.get("starts", state)
    begins = F.when(start >= 0, F.struct(F.col("at.block").alias("block"), start.alias("nth"))).otherwise(F.col("_earlier"))
    found = found.select(*own, "at", "text", (bit("before", state) | bit("after", state)).alias("_several"), F.coalesce(begins, F.col("at")).alias("_begins"), "_unclosed")
    several = F.col("_several") & ~F.coalesce(F.col("_begins") == F.col("_unclosed"), F.lit(False))
    joined = found.filter(several).groupBy("file", "_begins").agg(
        *[F.first(c).alias(c) for c in own if c != "file"], F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n").alias("text"))  # the lines of one cell
    return found.filter(~several).select(*own, "at", "text").unionByName(joined.select(*own, F.col("_begins").alias("at"), "text"))


def encodings(read: DataFrame) -> DataFrame:
    """file and encoding: utf-8 if every line is, else cp1252 if no byte is undefined in it, else latin-1."""
    undefined = F.decode("raw", "ISO-8859-1").rlike("[\x81\x8d\x8f\x90\x9d]")
    held = read.groupBy("file").agg(F.bool_and(F.is_valid_utf8(F.col("raw").cast("string"))).alias("utf8"), F.bool_or(undefined).alias("undefined"))
    return held.select("file", F.when(F.col("utf8"), "utf-8").when(F.col("undefined"), "latin-1").otherwise("cp1252").alias("encoding"))


def _decoded(encoding: Column) -> Column:
    latin = F.decode("raw", "ISO-8859-1")
    text = F.when(encoding == "utf-8", F.col("raw").cast("string")).when(encoding == "cp1252", F.translate(latin, "".join(_HIGH), "".join(_HIGH.values()))).otherwise(latin)
    return F.regexp_replace(text, "^\ufeff", "")


def separators(texts: DataFrame) -> DataFrame:
    """file, separator and ties of texts(file, at, text), by the filled ones of the first OPENING lines.

    The separator is the one whose most frequent number of occurrences, which mustn't be zero, holds for the most
    lines, then the one with the larger number, then the preferred; `ties` lists the others as good but for preference. Without any: the comma.
    """
    counts = texts.groupBy("file", F.col("at.block").alias("block")).agg(F.count(F.lit(1)).alias("n"))
    above = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per split
    first = counts.select(F.col("file").alias("_file"), F.col("block").alias("_block"), above.alias("_above")).filter(F.col("_above") < OPENING)
    opening = texts.join(small(first), (F.col("file") == F.col("_file")) & (F.col("at.block") == F.col("_block")))
    opening = opening.filter((F.col("_above") + F.col("at.nth") < OPENING) & blank_to_null(F.col("text")).isNotNull())
    counts = F.array(*[F.struct(F.lit(i).alias("choice"), (F.length("text") - F.length(F.replace("text", F.lit(s), F.lit("")))).alias("n")) for i, s in enumerate(SEPARATORS)])
    times = opening.select("file", F.explode(counts).alias("c")).groupBy("file", "c.choice", "c.n").agg(F.count(F.lit(1)).alias("times"))
    modal = times.groupBy("file", "choice").agg(F.max(F.struct("times", (-F.col("n")).alias("low"))).alias("m"), F.sum("times").alias("of"))
    scored = modal.filter("m.low < 0").select("file", F.struct((F.col("m.times") / F.col("of")).alias("share"), (-F.col("m.low")).alias("n")).alias("score"), "choice")
    best = scored.groupBy("file").agg(F.max("score").alias("score"), F.collect_list(F.struct("choice", "score")).alias("all"))  # four at most
    equal = F.array_sort(F.transform(F.filter("all", lambda x: x["score"] == F.col("score")), lambda x: x["choice"]))
    name = F.array(*map(F.lit, SEPARATORS))
    found = best.select("file", F.transform(equal, lambda i: F.get(name, i)).alias("good"))
    return texts.select("file").distinct().join(found, "file", "left").select(
        "file", F.coalesce(F.get("good", F.lit(0)), F.lit(",")).alias("separator"), F.coalesce(F.slice("good", 2, len(SEPARATORS)), F.array().cast("array<string>")).alias("ties"))


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, files): rows are file, at and cells; files are file, encoding, separator, ties, width.

    Cells are stripped; blank ones and texts of failed formulas are null. All rows of a file have its greatest width, blank lines
    inside it too; blank rows at its end are left out. An empty file has no row in either table. A record takes the place of its first line.
    """
    raw = lines(spark, path)
    texts = raw.join(small(encodings(raw)), "file").withColumn("text", _decoded(F.col("encoding")))
    split = records(texts.drop("raw").join(small(separators(texts)), "file"))
    choice = F.lit(None).cast("array<string>")
    for s in SEPARATORS:  # a field is quoted as a whole or holds no separator
        q = "\\" + s if s == "|" else s
        fields = F.regexp_extract_all(F.concat(F.lit(s), F.col("text")), F.lit(rf'{q}(\s*"[^"]*+(?:""[^"]*+)*+"[^{q}]*|[^{q}]*)'), F.lit(1))
        choice = F.when(F.col("separator") == s, fields).otherwise(choice)
    plain = lambda x: blank_to_null(F.replace(F.regexp_replace(x, r'^\s*"([^"]*+(?:""[^"]*+)*+)"', "$1"), F.lit('""'), F.lit('"')))
    rows = split.withColumn("cells", F.transform(choice, lambda x: F.when(~plain(x).isin(*ERRORS), plain(x))))
    filled = F.exists("cells", lambda x: x.isNotNull())
    files = rows.groupBy("file").agg(F.first("encoding").alias("encoding"), F.first("separator").alias("separator"), F.first("ties").alias("ties"), F.max(F.when(filled, F.col("at"))).alias("last"))
    widths = rows.join(files.select("file", "last"), "file").filter(F.col("at") <= F.col("last"))
    widths = widths.groupBy("file").agg(F.max(F.size("cells")).alias("width"))
    files = files.join(widths, "file", "left")
    ends = files.select("file", "last", "width")
    padded = F.concat("cells", F.array_repeat(F.lit(None).cast("string"), F.col("width") - F.size("cells")))
    return rows.join(ends, "file").filter(F.col("at") <= F.col("last")).select("file", "at", padded.alias("cells")), files.drop("last")
