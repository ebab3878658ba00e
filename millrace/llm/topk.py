"""Exact top-k search by inner product with multi-resolution segment statistics.

Cut into segments of m components, |q - x|^2 is at least the sum of m * ((mean_q - mean_x)^2 +
(dev_q - dev_x)^2). As q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2, this lower bound of the distance caps
the inner product at the sum of m * (mean_q * mean_x + dev_q * dev_x). Candidates are dropped by the cap
of long segments first, then of shorter ones; only survivors are multiplied out.

Candidates are sorted by norm and cut into blocks, each with an envelope: the extremes of its segment
statistics. Every query first meets the block of longest vectors, which gives the score that others must
reach; then queries are held against envelopes, and only blocks that some query of a query block may need
have their vectors joined with it. All groups are bounded; nothing of the vectors is broadcast.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialise, partitions, small

#: Components of a block of queries and of candidates, and envelopes that a query block meets at once.
QUERY_CELLS, CANDIDATE_CELLS, ENVELOPES = 1 << 19, 1 << 22, 4096
#: Queries that are multiplied with a block at once.
STRIP = 128
#: Segments of an envelope.
COARSE = 4


def resolutions(size: int) -> list[int]:
    """Numbers of segments, coarse to fine: the powers of 4 that leave segments of 2 or more."""
    return [s for s in (1, 4, 16, 64, 256, 1024) if s * 2 <= size]


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each row's segments, each scaled by the root of the segment's length."""
    edges = np.arange(segments + 1) * x.shape[1] // segments
    size = np.diff(edges)
    with np.errstate(over="ignore", invalid="ignore"):
        mean = np.add.reduceat(x, edges[:-1], axis=1) / size
        dev = np.sqrt(np.maximum(np.add.reduceat(x * x, edges[:-1], axis=1) / size - mean**2, 0))
        return np.hstack([mean * np.sqrt(size), dev * np.sqrt(size)])


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of integers held as doubles: exact, by Python's integers where doubles could round."""
    if q.size and x.size and np.abs(q).max() * np.abs(x).max() * q.shape[1] >= 2.0**53:
        whole = np.frompyfunc(int, 1, 1)
        return whole(q).dot(whole(x).T)
    return q @ x.T


def best(q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int) -> tuple[list, list, list]:
    """(query id, candidate id, score) of each query's k best candidates that reach least[query], ties to smaller ids.

    Bounds are compared with some slack; values beyond doubles give no bound (a NaN), and drop nothing.
    """
    order = np.argsort(x_ids, kind="stable")
    x_ids, x = x_ids[order], x[order]
    levels = [(statistics(q, s), statistics(x, s)) for s in resolutions(x.shape[1])]
    with np.errstate(over="ignore", invalid="ignore"):
        slack = 1e-6 + 1e-9 * np.sqrt((q**2).sum(axis=1)) * (np.sqrt((x**2).sum(axis=1)).max() if len(x) else 0)
    out: tuple[list, list, list] = ([], [], [])
    for at in range(0, len(q), STRIP):
        strip, columns = slice(at, at + STRIP), np.arange(len(x))
        reach = least[strip].astype(float)
        for n, (query_stats, stats) in enumerate(levels):
            with np.errstate(over="ignore", invalid="ignore"):
                cap = query_stats[strip] @ stats[columns].T
            if n == 0 and len(columns) > 8 * k:
                # the candidates of highest cap, multiplied out, give a score that survivors must reach
                first = np.unique(np.argpartition(-cap, 2 * k, axis=1)[:, : 2 * k])[: 8 * k]
                seed = products(q[strip], x[first]).astype(float)
                seed[q_ids[strip, None] == x_ids[first]] = -np.inf
                reach = np.maximum(reach, np.sort(seed, axis=1)[:, -k])
            live = (~(cap < (reach - slack[strip])[:, None])).any(axis=0)
            columns = columns[live]
            if not len(columns):
                break
        score = products(q[strip], x[columns])
        for i, row in enumerate(score):
            own, ids = np.flatnonzero(x_ids[columns] != q_ids[at + i]), x_ids[columns]
            if len(own) > k:
                kth = np.partition(row[own], len(own) - k)[len(own) - k]
                own = own[row[own] >= kth]
            own = own[np.argsort(-row[own], kind="stable")][:k]  # columns ascend by id
            out[0].extend([q_ids[at + i]] * len(own))
            out[1].extend(ids[own])
            out[2].extend(row[own])
    return out


def _matrix(t: pa.Table) -> np.ndarray:
    """The vectors of a table, all of one length, as rows."""
    flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 0))


def _envelopes(held: DataFrame) -> DataFrame:
    """low, high (extremes of segment means) and spread (largest deviations) of each length and block of held."""
    schema = "length int, block int, low array<double>, high array<double>, spread array<double>"

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.table(b)
            for keys in t.group_by(["length", "block"]).aggregate([]).to_pylist():
                own = t.filter((pa.compute.field("length") == keys["length"]) & (pa.compute.field("block") == keys["block"]))
                x = _matrix(own)
                segments = min(COARSE, x.shape[1])
                s = statistics(x, segments) if segments else np.zeros((own.num_rows, 0))
                mean, dev = s[:, :segments], s[:, segments:]
                yield pa.record_batch([pa.array([keys["length"]], pa.int32()), pa.array([keys["block"]], pa.int32()), *[
                    pa.array([v.tolist()], pa.list_(pa.float64())) for v in (mean.min(axis=0), mean.max(axis=0), dev.max(axis=0))]], ["length", "block", "low", "high", "spread"])

    parts = held.mapInArrow(part, schema).groupBy("length", "block").agg(*[F.collect_list(c).alias(c) for c in ("low", "high", "spread")])  # a row per batch
    pick = lambda c, f: F.transform(F.sequence(F.lit(0), F.size(F.get(c, F.lit(0))) - 1), lambda i: f(F.transform(c, lambda v: F.get(v, i))))
    extreme = lambda c, f: F.when(F.col("length") > 0, pick(F.col(c), f)).otherwise(F.array().cast("array<double>")).alias(c)
    return parts.select("length", "block", extreme("low", F.array_min), extreme("high", F.array_max), extreme("spread", F.array_max))


def search(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0, query_cells: int = QUERY_CELLS, candidate_cells: int = CANDIDATE_CELLS) -> DataFrame:
    """query_id, rank, vec_id and score (long) of the k highest inner products of each query.

    Components become floor(scale * x). Queries are the rows of vectors(vec_id, embedding) whose
    vec_id is divisible by `every`; candidates are all rows but those of the query's own vec_id.
    Ties go to the smaller vec_id. Rows whose vec_id or vector is null, or whose vector holds a null or
    non-finite component, take no part; vectors of another length than the query's are no
    candidates. If a query's vec_id repeats, its smallest vector asks; repeated candidates count as
    often as they stand. Ranks follow exact products; a score beyond 64 bits is shown as the nearest number that fits.
    Queries without candidates have no rows. An empty table gives none. Other columns are ignored.
    """
    if k < 1 or every < 1:
        raise ValueError("k and every must be positive")
    spark = vectors.sparkSession
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    # NaN is greater than infinity in Spark, so it fails this test as well
    whole = whole.filter(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
    whole = whole.select("vec_id", F.size("v").alias("length"), F.transform("v", lambda x: F.when(F.abs(x * scale) < 2.0**53, F.floor(x * scale).cast("double")).otherwise(x * scale)).alias("v"))
    asks = F.col("vec_id") % every == 0
    counts = whole.agg(F.count(F.lit(1)), F.count_if(asks), F.max("length")).first()
    width = max(1, counts[2] or 0)
    x_blocks, q_blocks = max(partitions(spark), -(-counts[0] * width // candidate_cells)), max(1, -(-counts[1] * width // query_cells))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    held = whole.repartitionByRange(x_blocks, "length", F.desc(norm), "vec_id", F.monotonically_increasing_id()).withColumn("block", F.spark_partition_id())
    held = materialise(held.select("length", "block", "vec_id", "v"), "candidates")
    asked = whole.filter(asks).groupBy("vec_id", "length").agg(F.min("v").alias("v")).groupBy("vec_id").agg(F.min(F.struct("length", "v")).alias("s"))
    asked = materialise(asked.select("vec_id", "s.length", "s.v", F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int").alias("qb")), "queries")
    result = "query_id long, vec_id long, score double, exact decimal(38,0)"
    limit = 10**38 - 1

    def tile(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            least = left.column("least").to_numpy(zero_copy_only=False) if "least" in left.column_names else np.full(left.num_rows, -np.inf)
            ids = lambda t: t.column("vec_id").to_numpy()
            found = best(ids(left), _matrix(left), least, ids(right), _matrix(right), k)
        with decimal.localcontext(prec=60):
            exact = [decimal.Decimal(max(-limit, min(limit, int(s)))) for s in found[2]]
        return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array([float(s) for s in found[2]], pa.float64()), pa.array(exact, pa.decimal128(38, 0))], ["query_id", "vec_id", "score", "exact"])

    tiles = ["length", "qb", "block"]
    envelopes = materialise(_envelopes(held), "envelopes")
    # 1. every query meets the block of its length's longest vectors
    top = envelopes.groupBy("length").agg(F.min("block").alias("block"))
    top = small(top) or top
    blocks = F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))
    near = asked.join(top, "length").groupBy(*tiles).cogroup(held.join(top, ["length", "block"]).withColumn("qb", blocks).groupBy(*tiles)).applyInArrow(tile, result)
    near = materialise(near, "near")
    kth = Window.partitionBy("query_id").orderBy(F.desc("exact"), "vec_id")
    reach = near.withColumn("nth", F.row_number().over(kth)).filter(F.col("nth") == k).select(F.col("query_id").alias("_id"), F.col("score").alias("least"))
    asked = materialise(asked.join(reach, F.col("vec_id") == F.col("_id"), "left").drop("_id").withColumn("least", F.coalesce("least", F.lit(float("-inf")))), "asked")

    # 2. queries against envelopes: which blocks may still hold one of the k best
    def need(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        keep: list[int] = []
        if left.num_rows and right.num_rows:
            q, low, high, spread = _matrix(left), *[np.array(right.column(c).to_pylist(), float).reshape(right.num_rows, -1) for c in ("low", "high", "spread")]
            segments, least = low.shape[1], left.column("least").to_numpy()
            s = statistics(q, segments) if segments else np.zeros((len(q), 0))
            with np.errstate(over="ignore", invalid="ignore"):
                mean, dev = s[:, :segments], s[:, segments:]
                cap = np.maximum(mean, 0) @ high.T + np.minimum(mean, 0) @ low.T + dev @ spread.T
                slack = 1e-6 + 1e-9 * np.sqrt((s**2).sum(axis=1))[:, None] * np.sqrt((np.maximum(np.abs(low), np.abs(high)) ** 2 + spread**2).sum(axis=1))
                live = (~(cap < least[:, None] - slack)).any(axis=0)
            keep = right.column("block").to_numpy()[live].tolist()
        length, qb, _ = (v.as_py() for v in key)
        return pa.table([pa.array([v] * len(keep), pa.int32()) for v in (length, qb)] + [pa.array(keep, pa.int32())], ["length", "qb", "block"])

    some = (F.col("block") / ENVELOPES).cast("int")
    spans = F.explode(F.sequence(F.lit(0), F.lit(x_blocks // ENVELOPES)))
    rest = envelopes.join(top.withColumnRenamed("block", "_top"), "length").filter("block <> _top").drop("_top")
    pairs = asked.withColumn("span", spans).groupBy("length", "qb", "span").cogroup(rest.withColumn("qb", blocks).withColumn("span", some).groupBy("length", "qb", "span")).applyInArrow(need, "length int, qb int, block int")
    pairs = materialise(pairs, "pairs")
    pairs = small(pairs) or pairs

    # 3. vectors of the blocks that are needed meet the queries that need them
    far = asked.join(pairs, ["length", "qb"]).groupBy(*tiles).cogroup(held.join(pairs, ["length", "block"]).groupBy(*tiles)).applyInArrow(tile, result)
    ranked = near.unionByName(far).withColumn("rank", F.row_number().over(kth)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.least(F.greatest(F.col("exact"), F.lit(-(2**63 - 1))), F.lit(2**63 - 1)).cast("long").alias("score"))
