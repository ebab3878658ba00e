"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts of the operators spell it.
SPACE = r"[\x20\x09-\x0D]+"
#: A lookup table with at most this many rows and bytes may be broadcast; both are counted first.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    In local mode, where they are one process, it may be unset; elsewhere that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"{tempfile.gettempdir()}/checkpoints"
    return f"{root.rstrip('/')}/millrace-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "part") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files below a materialised table that nothing will read again."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame | None:
    """df with a broadcast hint if a count finds at most `rows` rows of BROADCAST_BYTES together, else None."""
    wide = sum((F.octet_length(F.col(f"`{f.name}`").cast("string")) for f in df.schema if f.dataType.typeName() in ("string", "binary", "array")), F.lit(0))
    found = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(F.coalesce(wide, F.lit(0)) + 8 * len(df.columns))).first()
    return F.broadcast(df) if found[0] <= rows and (found[1] or 0) <= BROADCAST_BYTES else None


def unused(taken: list[str], *names: str) -> list[str]:
    """names, each with underscores in front until no column is called so, whatever the case."""
    held, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        out.append(name)
    return out


def semi(rows: DataFrame, keys: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """Semi or anti join that treats nulls as equal; broadcasts keys only if counted small."""
    keys = keys.select(F.col(on).alias("_key")).distinct()
    keys = small(keys) or keys
    return rows.join(keys, rows[on].eqNullSafe(keys["_key"]), how)


def lookup(facts: DataFrame, dims: DataFrame, on: str, weight: str, per_key: int) -> DataFrame:
    """Left join of facts with dims, which hold each key once, when few keys own many facts.

    `weight` is the column of dims that counts the facts of the key. Keys with more than
    `per_key` facts are joined by broadcast: there are at most count(facts) / per_key of
    them, so per_key must be a share of that count. The rest meet in a shuffled join.
    """
    extra = [c for c in dims.columns if c not in (on, weight)]
    heavy = F.broadcast(dims.filter(F.col(weight) > per_key).select(F.col(on), *[F.col(c).alias(f"_h_{c}") for c in extra], F.lit(True).alias("_heavy")))
    marked = facts.join(heavy, on, "left")
    light = dims.filter(F.col(weight) <= per_key).select(F.col(on).alias("_key"), *[F.col(c).alias(f"_l_{c}") for c in extra])
    rest = marked.filter("_heavy IS NULL").join(light, F.col(on) == F.col("_key"), "left")
    own = facts.columns
    return rest.select(*own, *[F.col(f"_l_{c}").alias(c) for c in extra]).unionByName(
        marked.filter("_heavy").select(*own, *[F.col(f"_h_{c}").alias(c) for c in extra]))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def squeeze(text: Column) -> Column:
    """Null as empty, and each run of ASCII white space as one space.

    The pattern leaves single spaces alone, which need no replacement.
    """
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def bounded_share(n: int, parts: int = 2000, least: int = 200) -> int:
    """A per_key for lookup() that lets at most `parts` keys count as heavy."""
    return max(least, -(-n // parts))


class Memo(dict):
    """memo[key] is make(key), remembered in two generations of bounded size.

    Keys longer than `longest` aren't kept. When the young generation is full it becomes
    the old one, so that what is in use survives.
    """

    def __init__(self, make: Callable[[Any], Any], generation: int, longest: int = 40) -> None:
        super().__init__()
        self.make, self.generation, self.longest, self.old = make, generation, longest, {}

    def __missing__(self, key: Any) -> Any:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.generation:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value
