"""Rows of text into a typed table: a mapping and a catalogue say which column feeds which, and of what type."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import dates, numbers
from millrace.functions.digest import normal
from millrace.functions.text import blank_to_null
from millrace.operators.profile import unreadable


@dataclass(frozen=True)
class Target:
    """A column of the typed table: its name and type, and whether it belongs to the business key."""

    name: str
    kind: str
    key: bool = False


def cast(value: Column, target: Target) -> Column:
    """value as target's type: string, date, timestamp, int, bigint, boolean or decimal(p,s); null if it can't be read."""
    kind = target.kind
    if kind == "date":
        return dates.parse_date(value)
    if kind == "timestamp":
        return dates.parse_timestamp(value)
    if kind == "boolean":
        return numbers.flag(value)
    if kind in ("int", "bigint"):
        return numbers.whole(value, kind, months=target.name.endswith("_month"))
    if kind.startswith("decimal"):
        precision, scale = (int(n) for n in kind[8:-1].split(","))
        return numbers.fit(numbers.amount(value), precision, scale)
    return blank_to_null(value.cast("string"))


def transform(df: DataFrame, mapping: dict[str, str], catalogue: list[Target], fills: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """One row per row of df: the catalogue's columns, business_key_hash, row_hash and invalid_columns.

    mapping names the source of each target; targets without a source are null. `fills` gives targets that take a part (year or month) of a
    date where they are null. The hashes are of the values as typed; invalid_columns names, comma-joined, those whose
    value is there but can't be read. All of it is one projection; a column is parsed once.
    """
    raw = {t.name: F.col(f"`{mapping[t.name]}`") if t.name in mapping else F.lit(None).cast("string") for t in catalogue}
    rows = df.select(*[raw[t.name].cast("string").alias(f"raw {t.name}") for t in catalogue], *[cast(raw[t.name], t).alias(t.name) for t in catalogue])
    bad = unreadable({t.name: (blank_to_null(F.col(f"`raw {t.name}`")), F.col(t.name)) for t in catalogue})
    rows = rows.select(*[t.name for t in catalogue], F.array_join(bad, ",").alias("invalid_columns"))
    for name, (source, part) in (fills or {}).items():
        kind = next(t.kind for t in catalogue if t.name == name)
        rows = rows.withColumn(name, F.coalesce(name, (F.year(source) if part == "year" else F.month(source)).cast(kind)))
    kinds = dict(rows.dtypes)
    digest = lambda names: F.sha2(F.concat_ws("\u001f", *[normal(F.col(c), kinds[c]) for c in names]), 256)
    keys = [t.name for t in catalogue if t.key]
    return rows.withColumns({"business_key_hash": digest(keys) if keys else F.lit(None).cast("string"), "row_hash": digest([t.name for t in catalogue])})


def quality(transformed: DataFrame, catalogue: list[Target]) -> DataFrame:
    """Per target: rows, filled and invalid values."""
    parts = [F.struct(F.lit(t.name).alias("target"), F.count(F.lit(1)).alias("rows"), F.count(t.name).alias("filled"), F.count_if(F.array_contains(F.split("invalid_columns", ","), t.name)).alias("invalid")) for t in catalogue]
    return transformed.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")
