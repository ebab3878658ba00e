"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A lookup table with at most this many rows and bytes may be broadcast; both are counted first.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20

#: Rows that a task of an exchange over a counted table takes, whatever the table's size.
TASK_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. In local mode it may be unset; elsewhere that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"{tempfile.gettempdir()}/checkpoints"
    return f"{root.rstrip('/')}/millrace-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "part") -> DataFrame:
    """df written as Parquet and read back: its lineage ends there, and a lost executor costs no more than a reread."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly over as many partitions as a shuffle has: few rows that cost much to read shouldn't lie in one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df of so many rows, those alike in keys together, over as many partitions as keep each near TASK_ROWS, but no fewer than a shuffle has."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS)), *keys)


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if a count finds it within the bounds, else df."""
    wide = sum((F.octet_length(F.col(f"`{f.name}`").cast("string")) for f in df.schema if f.dataType.typeName() in ("string", "binary", "array", "map", "struct")), F.lit(0))
    rows, size = df.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.sum(F.coalesce(wide, F.lit(0)) + 8 * len(df.columns))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else df


def free_names(taken: list[str], *names: str) -> list[str]:
    """names, each with underscores in front until no column is called so, whatever the case."""
    held, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        out.append(name)
    return out
