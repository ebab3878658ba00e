"""SimHash near-deduplication with bit-sliced comparison.

Fingerprints are compared vertically: bit plane p holds bit p of 64 fingerprints in one
word, so that one XOR and a few AND/XOR of carry-save counters advance 64 distances at once.
A word is abandoned as soon as every distance in it exceeds the radius.

Which fingerprints meet is settled by the pigeonhole principle: cut 64 bits into `radius + s`
slices; fingerprints within the radius agree on at least `s` of them, for some choice of s
slices. A bucket of one choice that is too large for a task is cut into chunks, and each pair
of chunks becomes a tile of its own: every pair is compared, no task holds a whole hot bucket,
and a tile returns a forest of links rather than its pairs.

One fingerprint of 64 bits estimates a similarity coarsely. With several parts, each a fingerprint
over hashes of its own, a pair is a candidate if any part lies within the radius, and a link if all
parts together lie within a second bound: more parts find more pairs, and the bound keeps others out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bounded_share, discard, lookup, materialise, partitions, semi, small

BITS, SEED = 64, 42
#: Bytes of a text whose words are held at once, but for a word that is longer.
PIECE, BLANK = 1 << 18, re.compile(rb"[\x20\x09-\x0D]")
#: Fingerprints of one chunk; a tile holds two chunks at most.
CHUNK = 2048
#: (fingerprint, word of 64 lanes) pairs that are compared at once.
STEP = 1 << 14
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def remixed(h: np.ndarray, part: int) -> np.ndarray:
    """Hashes of one part: h itself for part 0, else h with the part added and the bits mixed again."""
    if not part:
        return h
    h = h + np.uint64(part * 0x9E3779B97F4A7C15 % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about PIECE bytes that end where a word does, so that long texts take no more memory than short ones."""
    at = 0
    while at < len(text):
        gap = BLANK.search(text, at + PIECE)
        to = gap.end() if gap else len(text)
        yield text[at:to]
        at = to


def majorities(h: np.ndarray, parts: int) -> np.ndarray:
    """How many of the hashes set each bit, one row a part."""
    bits = lambda p: np.unpackbits(remixed(h, p).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.stack([bits(p).sum(axis=0, dtype=np.int64) for p in range(parts)])


def fingerprint(text: bytes | None, width: int = 4, parts: int = 1) -> list[int]:
    """SimHash of the word shingles of a text, repeats included, one number a part; 0 for a text without words."""
    digest, count, carry, ones = xxhash.xxh64_intdigest, 0, [], np.zeros((parts, BITS), np.int64)
    for piece in pieces(text or b""):
        words = carry + piece.lower().split()
        last = len(words) - width + 1
        if last > 0:
            h = np.fromiter((digest(b" ".join(words[i: i + width]), SEED) for i in range(last)), np.uint64, last)
            count, ones = count + last, ones + majorities(h, parts)
        carry = words[max(last, 0):]
    if not count and carry:
        count, ones = 1, majorities(np.array([digest(b" ".join(carry), SEED)], np.uint64), parts)
    return np.packbits(2 * ones > count, axis=1, bitorder="little").view(np.uint64).ravel().tolist()


def part_names(parts: int) -> list[str]:
    return ["fingerprint", *[f"part_{p}" for p in range(1, parts)]]


def fingerprints(docs: DataFrame, width: int = 4, parts: int = 1) -> DataFrame:
    """doc_id and the part_names (longs: the same 64 bits, signed) of each row of docs(doc_id, text)."""
    names = part_names(parts)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            prints = np.array([fingerprint(t.as_py(), width, parts) for t in texts], np.uint64).reshape(-1, parts).view(np.int64)
            yield pa.record_batch([b.column("doc_id"), *[pa.array(prints[:, p].copy()) for p in range(parts)]], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        of, f"doc_id long, {', '.join(f'{n} long' for n in names)}")


def choices(n: int, radius: int, copy: int = 200) -> list[list[tuple[int, int]]]:
    """The (offset, bits) slices of each bucketing: cheapest for n fingerprints.

    More slices a key mean smaller buckets but more copies of each fingerprint. A copy costs
    about as much as `copy` comparisons. Every choice finds every pair.
    """
    best, plan = float("inf"), []
    for s in range(1, 5):
        cut = radius + s
        edges = [BITS * i // cut for i in range(cut + 1)]
        slices = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
        bits = s * (BITS // cut)
        cost = comb(cut, s) * (1 + n / 2.0**bits / copy)
        if cost < best:
            best, plan = cost, [list(c) for c in combinations(slices, s)]
    return plan


def _bucket(fp: Column, slices: list[tuple[int, int]]) -> Column:
    key, at = F.lit(0).cast("long"), 0
    for offset, bits in slices:
        key = key.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, offset).bitwiseAND(F.lit((1 << bits) - 1)), at))
        at += bits
    return key


def exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose bit-sliced counter is above the radius."""
    above, equal = np.zeros_like(counters[0]), np.full_like(counters[0], FULL)
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            above |= equal & counters[k]
            equal &= ~counters[k]
    return above


def compare(fps: np.ndarray, query: np.ndarray, word: np.ndarray, planes: np.ndarray, valid: np.ndarray, radius: int):
    """The (query, lane) pairs within the radius, of the given (query, word) pairs."""
    width = radius.bit_length()
    over, counters = ~valid[word], [np.zeros(len(query), np.uint64) for _ in range(width)]
    for p in range(BITS):
        carry = planes[p][word] ^ (np.uint64(0) - ((fps[query] >> np.uint64(p)) & np.uint64(1)))
        for k in range(width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if p % 4 == 3 and p > radius:
            live = (over | exceeds(counters, radius)) != FULL
            if not live.any():
                return np.empty(0, np.int64), np.empty(0, np.int64)
            if live.mean() < 0.8:
                query, word, over, counters = query[live], word[live], over[live], [c[live] for c in counters]
    near = ~(over | exceeds(counters, radius))
    at, lane = np.nonzero(np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return query[at], word[at] * 64 + lane


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a and b: the smallest index that is known to be reachable."""
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label == before).all() and (label[a] == label[b]).all():
            return label


def forest(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: np.ndarray, radius: int, accept: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links of rows within the radius, inside each run starts[i]:ends[i], as a forest.

    second[i] is where the second chunk of the run begins (its end, if it has one chunk). Of the rows
    within the radius only those are linked that `accept`, given their places, says yes to.
    """
    lone = second == ends
    low = np.where(lone, starts, second)
    words = -(-(ends - low) // 64)
    offset = np.cumsum(words) - words
    lanes, row = np.zeros(int(words.sum()) * 64, np.uint64), np.full(int(words.sum()) * 64, -1, np.int64)
    run = np.repeat(np.arange(len(starts)), ends - low)
    index = np.arange(len(run)) - np.repeat(np.cumsum(ends - low) - (ends - low), ends - low)
    place = offset[run] * 64 + index
    lanes[place], row[place] = fps[low[run] + index], low[run] + index
    pack = lambda bits: np.packbits(bits.reshape(-1, 64), axis=1, bitorder="little").view(np.uint64).ravel()
    valid = pack(row >= 0)
    planes = np.stack([pack(((lanes >> np.uint64(p)) & np.uint64(1)).astype(bool)) for p in range(BITS)])
    asks = second - starts
    query = np.repeat(starts, asks) + np.arange(int(asks.sum())) - np.repeat(np.cumsum(asks) - asks, asks)
    of = np.repeat(np.arange(len(starts)), asks)
    first = np.where(lone[of], (query - starts[of]) // 64, 0)  # in a single chunk, only the words from its own on
    each = words[of] - first
    label = np.arange(len(fps))
    total = np.cumsum(each)
    at = 0
    while at < len(query):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP, "right")))
        q = np.repeat(np.arange(at, to), each[at:to])
        w = offset[of[q]] + first[q] + np.arange(len(q)) - np.repeat(np.cumsum(each[at:to]) - each[at:to], each[at:to])
        a, lane = compare(fps, query[q], w, planes, valid, radius)
        b = row[lane]
        apart = label[a] != label[b]  # what is linked already needs no second look
        if accept is not None and apart.any():
            a, b = a[apart], b[apart]
            apart = accept(a, b)
        if apart.any():
            label = _join(label, a[apart], b[apart])
        at = to
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return linked, label[linked]


def links(prints: DataFrame, radius: int, n: int, node: str = "fingerprint", parts: int = 1, within: int | None = None) -> DataFrame:
    """Links (a, b) between distinct nodes that connect all those with a part within the radius.

    With `within`, all parts together must differ in at most so many bits as well. A bucket holds
    nodes that agree in slices of one part, the choice's; rows carry all parts.
    """
    names, plan = part_names(parts), choices(n, radius, 200 * parts)
    carried = list(dict.fromkeys([node, *names]))
    tables = [F.struct(F.lit(p * len(plan) + t).alias("choice"), _bucket(F.col(name), s).alias("bucket")) for p, name in enumerate(names) for t, s in enumerate(plan)]
    keyed = prints.select(*carried, F.explode(F.array(*tables)).alias("k")).select(*carried, "k.choice", "k.bucket")
    hot = keyed.groupBy("choice", "bucket").count().filter(F.col("count") > CHUNK).select("choice", "bucket", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))
    hot = materialise(hot, "hot")
    tiles = keyed.join(small(hot) or hot, ["choice", "bucket"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    mine = F.pmod(F.xxhash64(node, "choice"), F.col("chunks")).cast("int")
    tiles = tiles.withColumn("mine", mine).select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")).select(
        "choice", "bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
        (F.col("mine") > F.col("other")).cast("int").alias("side"), *carried)
    tiles = tiles.repartition(partitions(prints.sparkSession), "choice", "bucket", "i", "j").sortWithinPartitions("choice", "bucket", "i", "j", "side")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def run(t: dict[str, np.ndarray]) -> pa.RecordBatch:
            key = np.stack([t[c] for c in ("choice", "bucket", "i", "j")])
            starts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)])
            ends = np.r_[starts[1:], key.shape[1]]
            second = starts + np.add.reduceat(1 - t["side"], starts)
            many = (ends - starts > 1) & (second > starts)
            words = np.stack([t[c].view(np.uint64) for c in names])
            fps = words[t["choice"] // len(plan), np.arange(words.shape[1])]
            accept = None if within is None else lambda a, b: np.bitwise_count(words[:, a] ^ words[:, b]).sum(axis=0, dtype=np.int64) <= within
            a, b = forest(fps, starts[many], ends[many], second[many], radius, accept) if many.any() else (np.empty(0, np.int64),) * 2
            return pa.record_batch([pa.array(t[node][a]), pa.array(t[node][b])], ["a", "b"])

        for b in batches:
            t = {c: b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in b.schema.names}
            if rest is not None:
                t = {c: np.concatenate([rest[c], t[c]]) for c in t}
            if not len(t["side"]):
                continue
            last = [t[c] == t[c][-1] for c in ("choice", "bucket", "i", "j")]
            same = np.logical_and.reduce(last)
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            rest = {c: v[cut:] for c, v in t.items()}
            if cut:
                yield run({c: v[:cut] for c, v in t.items()})
        if rest is not None:
            yield run(rest)

    return tiles.mapInArrow(scan, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) for each node of edges(a, b).

    Large-star and small-star rounds: each node hands its neighbours the smallest one it
    knows, until nothing changes. Hubs are looked up by broadcast, see lookup().
    """
    edge = lambda e: e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    seal = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    now = materialise(edge(edges), "edges")
    mark = seal(now)
    while mark[0]:
        per_key = bounded_share(2 * mark[0])
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select(F.col("a").alias("b"), F.least("a", "m").alias("m"), "n")
        large = lookup(now, low, "b", "n", per_key).select("a", F.col("m").alias("b"))
        large = materialise(edge(large), "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        found = lookup(large, low, "a", "n", per_key)
        after = materialise(edge(found.select("a", F.col("m").alias("b")).unionByName(found.select(F.col("b").alias("a"), F.col("m").alias("b")))), "edges")
        discard(large)
        discard(now)
        now, before, mark = after, mark, seal(after)
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, parts: int = 1, within: int | None = None) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    Words are runs of other than ASCII white space, with A-Z lower-cased. component_id is the
    smallest doc_id that can be reached over fingerprints that differ in at most `radius` bits;
    null if the component has no doc_id but null. With several parts one of them must lie within
    the radius, and all together within `within` bits; fingerprint is the first part. Null texts
    count as empty; texts without words have fingerprint 0. Repeated rows are each returned.
    Columns beside doc_id and text are ignored. An empty table gives an empty result.
    """
    if not 1 <= radius <= 15:
        raise ValueError("radius must lie between 1 and 15")
    names, node = part_names(parts), "fingerprint" if parts == 1 else "node"
    prints = fingerprints(docs, width, parts)
    prints = materialise(prints if parts == 1 else prints.withColumn(node, F.xxhash64(*names)), "fingerprints")
    held = [F.min(c).alias(c) for c in names if c != node]
    read = unique = materialise(prints.groupBy(node).agg(*held, F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "unique")
    n, rows = unique.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    roots = components(links(unique, radius, n, node, parts, within)).withColumnRenamed("node", "linked")
    unique = unique.join(roots, F.col(node) == F.col("linked"), "left").select(node, "least", "n", F.coalesce("root", node).alias("root"))
    unique = materialise(unique, "rooted")
    discard(read)
    groups = unique.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    named = materialise(lookup(unique, groups, "root", "members", bounded_share(n)).select(node, "component_id", "n"), "named")
    discard(unique)
    prints = prints.select(*dict.fromkeys(["doc_id", "fingerprint", node]))
    return lookup(prints, named, node, "n", bounded_share(rows)).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, radius: int = 4, width: int = 4, parts: int = 1, within: int | None = None) -> DataFrame:
    """The rows of docs, with all their columns, without those that a smaller doc_id stands for.

    Only the ids of dropped documents travel. Rows without doc_id stay, and so do all rows of a
    doc_id that repeats and represents a component with one of them.
    """
    found = materialise(near_duplicates(docs, radius, width, parts, within), "components")
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
    stay = found.filter("doc_id = component_id").select(F.col("doc_id").alias("_id")).distinct()
    return semi(docs, gone.join(stay, F.col("doc_id") == F.col("_id"), "left_anti"), "doc_id", "left_anti")
