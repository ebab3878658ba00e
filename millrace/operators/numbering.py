"""Row numbers and running totals over all rows of a table, or of each group, however large a group is.

Rows are range-sorted, so that a group that is too large for a task lies in several partitions one after the other. Each
partition counts for itself; one row per partition says what its first group holds in the partitions before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.storage import free_names, materialise


def _counted(kinds: list[type]):
    """A function for mapInArrow that appends partition, place in it, number in the group and the sums before, of the columns from the second on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, key = TaskContext.get().partitionId(), 0, None
        held = [kind(0) for kind in (np.int64, *kinds)]  # rows and sums of the open group
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            keys = b.column(0)
            new = np.ones(n, bool)
            new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            new[0] = keys[0].as_py() != key
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))  # -1: the group goes on from the batch before
            added = []
            for i, values in enumerate([np.ones(n, np.int64), *[pc.fill_null(b.column(1 + i), 0).to_numpy(zero_copy_only=False) for i in range(len(kinds))]]):
                before = np.concatenate([[0], np.cumsum(values)[:-1]])
                within = before - np.where(start >= 0, before[start], -held[i])
                held[i] = within[-1] + values[-1]
                added.append(pa.array(within))
            key = keys[n - 1].as_py()
            yield pa.record_batch([*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), *added],
                                  [*b.schema.names, "part", "at", "nth", *[f"before{i}" for i in range(len(kinds))]])
            at += n

    return run


def numbered(df: DataFrame, by: list[str], order: list[str | Column], nth: str = "nth", sums: dict[str, str] | None = None, partitions: int | None = None) -> DataFrame:
    """df with `nth`, the row's number from 0 among the rows alike in `by`, in `order`, and the running totals `sums`.

    sums maps a new column to one of numbers, whose sum over the rows before it holds (null counts as 0): whole numbers as long, all others as double. Nulls
    in `by` are one value and come first, as they do in `order`. Rows alike in `by` and `order` are numbered in any order, but
    each once. An empty table gives no rows. Without `by` all rows are one group; no group has to fit in a task. Rows come
    sorted by `by` and `order`, as files; only the columns of `order` are sampled by the driver, so they should be narrow.
    """
    spark, cols, sums = df.sparkSession, df.columns, sums or {}
    if clash := {c.lower() for c in cols} & {c.lower() for c in [nth, *sums]}:
        raise ValueError(f"the table has columns {sorted(clash)} already")
    keys = [F.col(f"`{c}`") for c in by]
    whole = {s: isinstance(df.schema[c].dataType, (T.IntegralType, T.BooleanType)) for s, c in sums.items()}
    key = F.to_json(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])) if by else F.lit("")
    order = [*keys, *[F.col(f"`{o}`") if isinstance(o, str) else o for o in order]]
    rows = df.select(
        key.alias("key"), *[F.col(f"`{c}`").cast("long" if whole[s] else "double").alias(f"sum{i}") for i, (s, c) in enumerate(sums.items())],
        F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), *[o.alias(f"order{i}") for i, o in enumerate(order)])
    places = [f"order{i}" for i in range(len(order))]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, *places).sortWithinPartitions(*places).drop(*places)
    width, kinds = len(sums), [np.int64 if w else np.float64 for w in whole.values()]
    added = [T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("nth", T.LongType()), *[T.StructField(f"before{i}", T.LongType() if w else T.DoubleType()) for i, w in enumerate(whole.values())]]
    held = materialise(rows.mapInArrow(_counted(kinds), T.StructType([*rows.schema.fields, *added])), "numbered")

    count = [(F.col("nth") + 1).alias("nth"), *[(F.col(f"before{i}") + F.coalesce(f"sum{i}", F.lit(0))).alias(f"before{i}") for i in range(width)]]
    ends = held.groupBy("part").agg(F.min_by("key", "at").alias("first"), F.max_by(F.struct("key", *count), "at").alias("last"))  # a row per partition
    totals = ["nth", *[f"before{i}" for i in range(width)]]
    tails = ends.select("part", F.lit(1).alias("is_tail"), F.col("last.key").alias("key"), *[F.col(f"last.{t}").alias(t) for t in totals])
    heads = ends.select("part", F.lit(0).alias("is_tail"), F.col("first").alias("key"), *[F.lit(0).cast(held.schema[t].dataType).alias(t) for t in totals])
    ahead = Window.partitionBy("key").orderBy("part", "is_tail").rowsBetween(Window.unboundedPreceding, -1)
    carried = heads.unionByName(tails).select(F.col("part").alias("_part"), F.col("key").alias("_key"), "is_tail", *[F.sum(t).over(ahead).alias(f"_{t}") for t in totals]).filter("is_tail = 0")
    joined = held.join(F.broadcast(carried), (F.col("part") == F.col("_part")) & (F.col("key") == F.col("_key")), "left")
    total = lambda t: (F.col(t) + F.coalesce(F.col(f"_{t}"), F.lit(0)))
    return joined.select("row.*", total("nth").alias(nth), *[total(f"before{i}").alias(s) for i, s in enumerate(sums)])
