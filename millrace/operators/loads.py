"""Loads that write: versions of a table as Parquet, each complete before it is named the current one.

A table is a folder with one sub-folder per version (its files, by load) and a manifest, a file per commit. A load writes a new version, checks what it
wrote by metrics observed on the way, and then creates the next commit, which only one writer can: a second one that started from the same version is refused and
starts again from the new one. Until then readers see the old version, so a run that dies half-way changes nothing, and a run that is repeated with the same
load id replaces what it wrote before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.operators.joins import first_per_key

MANIFEST = "load_id string, version string, rows long, state string, number long"


class Conflict(ValueError):
    """Another writer committed first."""


@dataclass(frozen=True)
class Contract:
    """What must hold of the rows that come in: how many, columns without nulls, columns with any value, and sums."""

    rows: int | None = None
    filled: tuple[str, ...] = ()
    used: tuple[str, ...] = ()
    sums: dict[str, Decimal | int] = field(default_factory=dict)

    def metrics(self) -> list[Column]:
        """What is observed while rows are written, at no further scan."""
        count = lambda c: F.count(F.col(f"`{c}`"))
        return [F.count(F.lit(1)).alias("rows"), *[count(c).alias(f"filled {c}") for c in dict.fromkeys([*self.filled, *self.used])], *[F.sum(F.col(f"`{c}`").cast("decimal(38,6)")).alias(f"sum {c}") for c in self.sums]]

    def broken(self, seen: dict) -> list[str]:
        """Which clauses the observed metrics break, in words."""
        said = []
        if self.rows is not None and seen["rows"] != self.rows:
            said.append(f"{seen['rows']} rows, not {self.rows}")
        said += [f"{seen['rows'] - seen[f'filled {c}']} rows without {c}" for c in self.filled if seen[f"filled {c}"] != seen["rows"]]
        said += [f"no value in {c}" for c in self.used if seen["rows"] and not seen[f"filled {c}"]]
        said += [f"{c} sums to {seen[f'sum {c}'] or 0}, not {want}" for c, want in self.sums.items() if (seen[f"sum {c}"] or 0) != want]
        return said


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def head(spark: SparkSession, path: str) -> int:
    """Number of the last commit, 0 for a new table; one that a writer left unfinished counts, but says nothing."""
    files, place = _folder(spark, path)
    if not files.exists(place):
        return 0
    names = [s.getPath().getName() for s in files.listStatus(place)]
    return max((int(n.split(".")[0]) for n in names if n.endswith(".json") and n[0] != "."), default=0)


def commit(spark: SparkSession, path: str, row: dict) -> None:
    """Create the commit `number`; raises Conflict if there is one already. The file system must create files one writer at a time."""
    files, place = _folder(spark, path)
    try:
        out = files.create(spark._jvm.org.apache.hadoop.fs.Path(place, f"{row['number']:012d}.json"), False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            raise Conflict(f"another load committed number {row['number']} of {path}") from e
        raise
    out.write(bytearray(json.dumps(row).encode()))
    out.close()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """load_id, version, rows, state and number of each load, in no order; empty for a new table."""
    if not head(spark, path):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json(f"{path}/manifest").filter("number IS NOT NULL")


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of the current version, with _load_id; None for a new table."""
    last = manifest(spark, path).orderBy(F.desc("number")).limit(1).collect()
    return spark.read.option("mergeSchema", "true").parquet(f"{path}/{last[0]['version']}") if last else None


def _swap(incoming: DataFrame, path: str, load_id: str, make: Callable[[DataFrame | None, DataFrame], DataFrame], contract: Contract, tries: int) -> int:
    """Write make(current rows, incoming) as the next version and name it the current one; returns its rows."""
    spark = incoming.sparkSession
    if "_load_id" in incoming.columns:
        raise ValueError("the input has a column _load_id already")
    for left in reversed(range(tries)):
        number, before, seen = head(spark, path) + 1, current(spark, path), Observation(f"load-{uuid.uuid4().hex}")
        rows = make(before, incoming.observe(seen, *contract.metrics()).withColumn("_load_id", F.lit(load_id)))
        version = f"version-{uuid.uuid4().hex}"
        rows.write.partitionBy("_load_id").parquet(f"{path}/{version}")
        if broken := contract.broken(found := seen.get):
            raise ValueError(f"load {load_id}: {'; '.join(broken)}")
        written = spark.read.parquet(f"{path}/{version}")
        counts = {r["_load_id"]: r["n"] for r in written.groupBy("_load_id").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per load
        if counts.get(load_id, 0) > found["rows"]:
            raise ValueError(f"load {load_id} wrote {counts[load_id]} rows, more than came in")
        try:
            commit(spark, path, {"load_id": load_id, "version": version, "rows": counts.get(load_id, 0), "state": "loaded", "number": number})
        except Conflict:
            if not left:
                raise
        else:
            return sum(counts.values())
    raise ValueError("a load is tried once at least")


def load(incoming: DataFrame, path: str, load_id: str, replaces: list[str] | None = None, evolve: bool = True, contract: Contract = Contract(), tries: int = 3) -> int:
    """Add incoming as load `load_id`, instead of the loads it replaces and of its own earlier run; returns the table's rows.

    Columns are matched by name. New ones are added, missing ones are null, unless `evolve` is False, which refuses another set of columns. Rows that earlier
    runs loaded without an id stay. A broken contract, or a writer that was always first, leaves the table as it was.
    """
    def make(before: DataFrame | None, rows: DataFrame) -> DataFrame:
        if before is None:
            return rows
        if not evolve and {*before.columns} != {*rows.columns}:
            raise ValueError("the columns differ from the table's")
        gone = [load_id, *(replaces or [])]
        return before.filter(~F.coalesce(F.col("_load_id").isin(gone), F.lit(False))).unionByName(rows, allowMissingColumns=True)

    return _swap(incoming, path, load_id, make, contract, tries)


def merge(incoming: DataFrame, path: str, load_id: str, keys: list[str], order: list[Column] | None = None, contract: Contract = Contract(), tries: int = 3) -> int:
    """Upsert: rows of the table that share all keys with a row of incoming give way to it, the others stay, new ones are added.

    Of rows that come in with the same keys one is taken, the first by `order` (by default by a hash of the row). Rows with a null key match nothing; they are added,
    and a repeated run replaces those it added. Columns, contracts, and writers at the same time: as in load().
    """
    def make(before: DataFrame | None, rows: DataFrame) -> DataFrame:
        keyed = F.lit(True)
        for k in keys:
            keyed = keyed & F.col(f"`{k}`").isNotNull()
        by = order or [F.xxhash64(*[F.col(f"`{c}`") for c in incoming.columns]), F.to_json(F.struct(*[F.col(f"`{c}`") for c in incoming.columns]))]
        fresh = first_per_key(rows.filter(keyed), [F.col(f"`{k}`") for k in keys], by).unionByName(rows.filter(~keyed))
        if before is None:
            return fresh
        stay = before.filter(~F.coalesce(F.col("_load_id") == load_id, F.lit(False)))
        return stay.join(fresh.select(*[F.col(f"`{k}`") for k in keys]), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)

    return _swap(incoming, path, load_id, make, contract, tries)
