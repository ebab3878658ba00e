"""What a cell of a sheet, read as text, looks like: its kind, its number, and what a line of cells looks like."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a date, an identifier and a number look like; the first that fits decides, everything else is text.
DATE_LIKE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?)?$"
ID_LIKE = r"^[A-Za-z]{1,5}[-_]?\d{2,}$"
NUMBER_LIKE = r"^-?[\d,]*\.?\d+$"
# Fixed value: what a number is without separators, per cent and dollar signs.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# A text longer than this on average is prose, not a label; a longer cell is a note.
LABEL_LENGTH, NOTE_LENGTH = 30, 80
#: The letters of marked(), by kind; of a text that is a number all the same; of a blank cell.
LETTERS = {"date_string": "d", "id_string": "i", "int": "n", "float": "f", "text": "t"}
NUMBER_TEXT, BLANK = "m", "."
#: The kind that a letter stands for.
KINDS = {letter: kind for kind, letter in LETTERS.items()} | {NUMBER_TEXT: "text"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once however often body names it; inside lambdas Spark shares nothing by itself."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stripped(cell: Column) -> Column:
    """A cell without blanks around it; null if nothing is left."""
    bare = (F.substring(cell, 1, 1) > " ") & F.substring(cell, -1, 1).between("!", "~")  # most cells: nothing to strip
    return F.when(cell.isNull() | bare, cell).otherwise(let(F.regexp_replace(cell, r"^\s+|\s+$", ""), lambda text: F.when(text != "", text)))


def _kind(text: Column) -> Column:
    return (
        F.when(text.isNull(), F.lit(None).cast("string")).when(text.rlike(DATE_LIKE), "date_string").when(text.rlike(ID_LIKE), "id_string")
        .when(text.rlike(NUMBER_LIKE), F.when(F.contains(text, F.lit(".")), "float").otherwise("int")).otherwise("text"))


def _number(text: Column) -> Column:
    signed = let(F.trim(F.regexp_replace(text, r"[,%$]", "")), lambda bare: F.when(bare.rlike(NUMBER), bare.try_cast("double")))
    return F.when(text.rlike(NUMBER), text.try_cast("double")).when(text.rlike(r"[,%$]"), signed)  # most cells have none of them


def kind(cell: Column) -> Column:
    """date_string, id_string, int, float or text; null for a blank cell."""
    return let(stripped(cell), _kind)


def family(kind_: Column) -> Column:
    """Whole numbers and decimals are one kind of value."""
    return let(kind_, lambda k: F.when(k.isin("int", "float"), "number").otherwise(k))


def number(cell: Column) -> Column:
    """A cell as double, without thousands separators, per cent and dollar signs; null if it is no number."""
    return _number(stripped(cell))


def read(cells: Column) -> Column:
    """The cells as structs of text (stripped), kind and number, each cell looked at once."""
    return F.transform(cells, lambda c: let(stripped(c), lambda text: F.struct(text.alias("text"), _kind(text).alias("kind"), _number(text).alias("number"))))


def numbers(texts: Column) -> Column:
    """The numbers of stripped cells, as number() of each."""
    return F.transform(texts, _number)


def _letter(text: Column) -> Column:
    number = F.trim(F.regexp_replace(text, r"[,%$]", "")).rlike(NUMBER)  # without let(), whose arrays cost more than a second regular expression
    letter = (
        F.when(text.isNull(), BLANK).when(text.rlike(DATE_LIKE), LETTERS["date_string"]).when(text.rlike(ID_LIKE), LETTERS["id_string"])
        .when(text.rlike(NUMBER_LIKE), F.when(F.contains(text, F.lit(".")), LETTERS["float"]).otherwise(LETTERS["int"])).when(number, NUMBER_TEXT).otherwise(LETTERS["text"]))
    return F.when(F.startswith(text, F.lit("--")) | (F.length(text) > NOTE_LENGTH), F.upper(letter)).otherwise(letter)


def marked(rows: DataFrame) -> DataFrame:
    """rows(cells) with texts (the cells stripped), marks (one string: a letter per cell for its kind, a capital if the cell is a note) and fill (the effective one); each cell is looked at once."""
    rows = rows.withColumn("texts", F.transform("cells", stripped))
    return rows.select("*", F.array_join(F.transform("texts", _letter), "").alias("marks"), _effective(F.array_compact("texts")).alias("fill"))


def filled_marks(marks: Column) -> Column:
    """How many cells aren't blank by their marks, joined to one string."""
    return F.length(F.translate(marks, BLANK, ""))


def letters(marks: Column) -> Column:
    """The marks as an array."""
    return F.regexp_extract_all(marks, F.lit("."), F.lit(0))


def marked_kind(mark: Column) -> Column:
    """The kind that a mark stands for; null for a blank cell."""
    return F.get(F.array(*map(F.lit, KINDS.values())), F.instr(F.lit("".join(KINDS)), F.lower(mark)) - 1)


def filled(cells: Column) -> Column:
    """The stripped cells of a line that aren't blank."""
    return F.array_compact(F.transform(cells, stripped))


def fill(cells: Column) -> Column:
    return F.size(filled(cells))


def _effective(held: Column) -> Column:
    return F.when((F.size(held) >= 2) & (F.size(F.array_distinct(held)) == 1), 1).otherwise(F.size(held))


def effective_fill(cells: Column) -> Column:
    """Filled cells; several that all hold one value, as a merged title does, count as one."""
    return let(filled(cells), _effective)


def effective_texts(texts: Column) -> Column:
    """effective_fill() of cells that are stripped already."""
    return _effective(F.array_compact(texts))


def share(cells: Column, of: Column) -> Column:
    """of / the number of filled cells, 0 without any."""
    return let(fill(cells), lambda n: F.when(n > 0, of / n).otherwise(F.lit(0.0)))


def textness(cells: Column) -> Column:
    return share(cells, F.size(F.filter(cells, lambda c: kind(c) == "text")))


def uniqueness(cells: Column) -> Column:
    return share(cells, F.size(F.array_distinct(filled(cells))))


def brevity(cells: Column) -> Column:
    """1 if the filled cells are short on average, 0.5 if they aren't, 0 without any. Cells count as written."""
    written = F.filter(cells, lambda c: stripped(c).isNotNull())
    length = lambda held: F.aggregate(held, F.lit(0).cast("long"), lambda a, c: a + F.length(c))
    return let(written, lambda held: F.when(F.size(held) == 0, 0.0).when(length(held) / F.size(held) <= LABEL_LENGTH, 1.0).otherwise(0.5))


def unlike(pairs: Column) -> Column:
    """Share of the pairs (own, below: kinds), of those filled in both, that differ; 0 without any."""
    both = F.filter(pairs, lambda p: p["own"].isNotNull() & p["below"].isNotNull())
    return let(both, lambda held: F.when(F.size(held) > 0, F.size(F.filter(held, lambda p: p["own"] != p["below"])) / F.size(held)).otherwise(F.lit(0.0)))


def contrast(cells: Column, profile: Column) -> Column:
    """Share of the places filled in both where a line's kind differs from the profile's (an array of kinds)."""
    return unlike(F.arrays_zip(F.transform(cells, kind).alias("own"), profile.alias("below")))
