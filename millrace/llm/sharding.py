"""Sharding by a hypergeometric communication matrix.

A uniform shuffle into shards of exact sizes sends, from each source partition to each shard, a
number of rows that follows a multivariate hypergeometric law. These counts are drawn first; each
partition, as it lies in its file, then permutes its rows and cuts them by its counts, the rows are exchanged, and
each shard permutes what it received. Only counts pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialise, small

#: Rows of a shard that are permuted together, about: a block of the random key.
BLOCK_ROWS = 1 << 14


def communication_matrix(rows: list[int], capacities: list[int], seed: int) -> np.ndarray:
    """Counts [partition, shard] with the given margins, drawn as a uniform shuffle would, at any size.

    Every row first goes to any shard, independently (multinomial counts); then shards that got
    too many give rows, chosen uniformly among theirs, to those that got too few. Neither step knows one row
    from another, so all assignments with the right sizes stay equally likely: the counts follow the
    hypergeometric law exactly. About the square root of the rows is chosen one by one.
    """
    rng, left = np.random.default_rng(seed), np.array(capacities, np.int64)
    if not left.sum():
        return np.zeros((len(rows), len(capacities)), np.int64)
    matrix = rng.multinomial(np.array(rows, np.int64), left / left.sum()).astype(np.int64)
    excess, moved = matrix.sum(axis=0) - left, [np.empty(0, np.int64)]
    for s in np.flatnonzero(excess > 0):
        upto = matrix[:, s].cumsum()
        given = np.searchsorted(upto, rng.choice(int(upto[-1]), int(excess[s]), replace=False), side="right")
        np.subtract.at(matrix, (given, s), 1)
        moved.append(given)
    short = np.repeat(np.arange(len(left)), np.maximum(-excess, 0))
    np.add.at(matrix, (rng.permutation(np.concatenate(moved)), short), 1)
    return matrix


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """df with shard and slot: a uniform shuffle into `shards` shards, counts at most one apart.

    slot numbers the rows of a shard from 0 without gaps, in shuffled order. Source partitions are df's own, written
    out first. The draw depends on how rows lie in them, on their number and the seed, neither on values nor on
    spark.sql.shuffle.partitions: reruns over the same files agree. Rows that repeat are
    dealt like any others, nulls and all other columns go along as they are. An empty df gives no rows. A column
    named shard or slot is refused.
    """
    if {"shard", "slot"} & {c.lower() for c in df.columns}:
        raise ValueError("the input has a column shard or slot already")
    spark = df.sparkSession
    held = materialise(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")), "rows")
    rows = held.select("row", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    counts = sorted((r["file"].partition("-c000")[0], r["file"], r["n"]) for r in rows.groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect())  # a row per partition
    sizes = [n for *_, n in counts]
    total = sum(sizes)
    capacities = [total // shards + (s < total % shards) for s in range(shards)]
    upto = communication_matrix(sizes, capacities, seed).cumsum(axis=1)
    matrix = spark.createDataFrame([(file, p, n, upto[p].tolist()) for p, (_, file, n) in enumerate(counts)], "_of string, part int, n long, upto array<long>")  # partitions x shards numbers

    @F.pandas_udf("long")
    def permuted(columns: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        """Place of each row in its partition's permutation, which is drawn once per partition and task."""
        held, order = None, np.empty(0, np.int64)
        for part, n, at in columns:
            place = np.empty(len(at), np.int64)
            for p in part.unique():
                own = (part == p).to_numpy()
                if held != p:
                    held, order = p, np.random.default_rng([seed, 1, int(p)]).permutation(int(n[own].iat[0]))
                place[own] = order[at[own].to_numpy()]
            yield pd.Series(place)

    rows = rows.join(small(matrix) or matrix, F.col("file") == F.col("_of"))
    rows = rows.withColumn("place", permuted("part", "n", "at"))
    rows = rows.select("row", "part", "at", F.size(F.filter("upto", lambda u: u <= F.col("place"))).cast("int").alias("shard"))
    return _slots(rows, F.xxhash64(F.lit(f"{seed}/exchange"), "part", "at"), total // shards).select("row.*", "shard", "slot")


def _slots(rows: DataFrame, key: Column, per_shard: int) -> DataFrame:
    """Number each shard's rows in the order of a random key, block of the key by block."""
    blocks = 1 << max(0, (per_shard // BLOCK_ROWS).bit_length())
    keyed = materialise(rows.withColumn("key", key).withColumn("block", F.pmod(F.shiftright("key", 24), F.lit(blocks)).cast("int")), "dealt")
    sizes = keyed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))  # shards x blocks rows
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("shard").alias("_s"), F.col("block").alias("_b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "block").orderBy("key", "part", "at")
    numbered = keyed.withColumn("nth", F.row_number().over(inside)).join(small(starts) or starts, (F.col("shard") == F.col("_s")) & (F.col("block") == F.col("_b")))
    return numbered.withColumn("slot", (F.col("start") + F.col("nth") - 1).cast("long"))
