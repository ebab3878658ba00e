"""Vector code compression: product codes with memoised grid cells.

Vectors are cut into equal parts and each part is replaced by the index of the nearest entry of its codebook. A part lies in a
coarse cell of a grid over its components. The cell's box bounds the distance to each entry from below and above; an entry
whose least distance exceeds the smallest greatest distance of any entry is nowhere in the box the nearest. Cells are found by hash
and remember the entries that are left, so a part is compared exactly with those alone. Codebooks are refined by rounds of
assignment and floor-averaging; tasks send sums of a codebook's size, never vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bounded_share, lookup, materialise

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Side of a cell, in scaled units; cells that are remembered; vectors that are coded at once.
SIDE, REMEMBERED, AT_ONCE = 24, 200_000, 1024
#: Scaled components beyond this can't be summed exactly in 64 bits.
LIMIT = 1 << 27


class Cells:
    """Nearest entries of `parts` codebooks, shaped (parts, entries, components), by remembered cells."""

    def __init__(self, books: np.ndarray, side: int = SIDE, remembered: int = REMEMBERED) -> None:
        self.books, self.side, self.remembered = books, side, remembered
        self.slots: dict[bytes, int] = {}
        self.kept = np.zeros((1024, -(-books.shape[1] // 8)), np.uint8)  # bit e of a row: entry e may be the nearest in the cell

    def candidates(self, part: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """(cells, entries): which entries aren't dominated across the boxes of the given cells."""
        entry = self.books[part]
        low = (cell * self.side)[:, None, :]
        high = low + self.side - 1
        least = np.maximum(np.maximum(low - entry, entry - high), 0)
        most = np.maximum(np.abs(entry - low), np.abs(entry - high))
        return (least * least).sum(2) <= (most * most).sum(2).min(1, keepdims=True)

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """Rows of candidate masks for distinct keys (part, cell), computed for those not remembered."""
        names = [k.tobytes() for k in keys]
        if len(self.slots) + len(names) > self.remembered:
            self.slots.clear()
        new = [i for i, k in enumerate(names) if k not in self.slots]
        for at in range(0, len(new), AT_ONCE):
            some = new[at: at + AT_ONCE]
            masks = np.packbits(self.candidates(keys[some, 0], keys[some, 1:]), axis=1, bitorder="little")
            first = len(self.slots)
            while len(self.kept) < first + len(some):
                self.kept = np.concatenate([self.kept, np.zeros_like(self.kept)])
            self.kept[first: first + len(some)] = masks
            self.slots.update(zip([names[i] for i in some], range(first, first + len(some)), strict=True))
        return np.unpackbits(self.kept[[self.slots[k] for k in names]], axis=1, bitorder="little")[:, : self.books.shape[1]].astype(bool)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry, the lower of equals, and squared distance of each part: two arrays (vectors, parts)."""
        parts, _, width = self.books.shape
        x = vectors.reshape(-1, width)
        part = np.tile(np.arange(parts), len(vectors))
        keys = np.concatenate([part[:, None], x // self.side], axis=1)
        h = np.zeros(len(keys), np.uint64)
        for column in keys.T:
            h = (h ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        _, first, cell = np.unique(h, return_index=True, return_inverse=True)
        if (keys[first][cell] != keys).any():  # two cells share a hash
            _, first, cell = np.unique(keys, axis=0, return_index=True, return_inverse=True)
            cell = cell.ravel()
        masks = self.look_up(keys[first])
        entries, many = np.nonzero(masks)[1], masks.sum(1)
        counts = many[cell]
        begin = np.cumsum(counts) - counts
        row = np.repeat(np.arange(len(x)), counts)
        entry = entries[np.repeat((np.cumsum(many) - many)[cell] - begin, counts) + np.arange(len(row))]
        gap = x[row] - self.books[part[row], entry]
        distance = (gap * gap).sum(1)
        least = np.minimum.reduceat(distance, begin)
        best = np.minimum.reduceat(np.where(distance == least[row], entry, self.books.shape[1]), begin)
        return best.reshape(-1, parts), least.reshape(-1, parts)


@lru_cache(maxsize=1)
def _cells(books: bytes, shape: tuple[int, int, int], side: int) -> Cells:
    return Cells(np.frombuffer(books, np.int64).reshape(shape), side)


def usable(embedding: Column) -> Column:
    """Whether a vector is there and holds only finite numbers."""
    return embedding.isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def scaled(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """The vectors of an Arrow batch as rows of whole numbers floor(scale * x), missing components at the end 0."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(flat) and np.abs(flat).max() > LIMIT:
        raise ValueError(f"components beyond {LIMIT // scale} can't be coded exactly")
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat.astype(np.int64)
    return out


def train(vectors: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, side: int = SIDE) -> np.ndarray:
    """Codebooks (parts, entries, components) of vectors(vec_id, embedding): bounded by their own size, so the driver holds them.

    They start as the parts of the first vectors by vec_id (null last, equal ones by their components); a round assigns every part
    and replaces each entry by the floor of its parts' mean; entries without parts stay. Fewer vectors than entries give shorter codebooks.
    """
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").toArrow()
    start = scaled(first.column(0).combine_chunks(), width, scale)
    books = np.ascontiguousarray(start.reshape(len(start), parts, width // parts).transpose(1, 0, 2))
    if not len(start):
        return books
    for _ in range(rounds):
        shared, shape = vectors.sparkSession.sparkContext.broadcast(books.tobytes()), books.shape

        def sums(batches: Iterator[pa.RecordBatch], shared=shared, shape=shape) -> Iterator[pa.RecordBatch]:
            cells, total, count = _cells(shared.value, shape, side), np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
            for b in batches:
                for at in range(0, b.num_rows, AT_ONCE):
                    x = scaled(b.column("embedding").slice(at, AT_ONCE), width, scale)
                    best, _ = cells.nearest(x)
                    place = (np.arange(shape[0]), best)
                    np.add.at(total, place, x.reshape(len(x), shape[0], -1))
                    np.add.at(count, place, 1)
            used = np.flatnonzero(np.repeat(count.ravel() > 0, shape[2]))
            yield pa.record_batch([pa.array(used), pa.array(total.ravel()[used]), pa.array(np.repeat(count.ravel(), shape[2])[used])], ["slot", "total", "n"])

        found = vectors.select("embedding").mapInArrow(sums, "slot long, total long, n long").groupBy("slot").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()  # a row per number of the codebooks
        flat = books.ravel().copy()
        for slot, total, n in found:
            flat[slot] = total // n
        books = flat.reshape(shape)
    return books


def text(books: np.ndarray) -> str:
    return ",".join(map(str, books.ravel().tolist()))


def encode(vectors: DataFrame, books: np.ndarray, width: int, scale: int = SCALE, side: int = SIDE, extra: tuple[str, ...] = ()) -> DataFrame:
    """vec_id, code (two hex digits a part) and error (squared distances summed) of each of vectors, with `extra` columns."""
    shared, shape = vectors.sparkSession.sparkContext.broadcast(books.tobytes()), books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = _cells(shared.value, shape, side)
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                some = b.slice(at, AT_ONCE)
                best, distance = cells.nearest(scaled(some.column("embedding"), width, scale))
                codes = [row.tobytes().hex() for row in best.astype(np.uint8)]
                yield pa.record_batch([some.column("vec_id"), *[some.column(c) for c in extra], pa.array(codes), pa.array(distance.sum(1))], ["vec_id", *extra, "code", "error"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.select(*extra).schema)
    return vectors.select("vec_id", *extra, "embedding").mapInArrow(run, f"vec_id long, {kinds + ', ' if kinds else ''}code string, error long")


def compress(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, side: int = SIDE) -> DataFrame:
    """One row per usable row of table(vec_id, embedding, label): vec_id, code, error, label_error and codebooks_sha256.

    Components become floor(scale * x). Rows whose vector is null or holds null or non-finite components are left out. Vectors whose
    length `parts` doesn't divide, or that are shorter than others, are filled up with zeros. error is the sum of squared
    distances to the entries, label_error its sum over equal labels, null labels being equal. Rows that repeat and null vec_ids are each
    coded. Other columns are ignored. An empty table gives no rows. At most 256 entries; components beyond LIMIT / scale raise.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    label = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    vectors = table.filter(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    longest = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = max(1, -(-longest // parts)) * parts
    books = train(vectors, width, parts, entries, rounds, scale, side)
    if not books.shape[1]:
        return vectors.select("vec_id", F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")], F.lit("").alias("codebooks_sha256")).limit(0)
    coded = materialise(encode(vectors, books, width, scale, side, ("label",)), "codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n"))
    rows = lookup(coded, sums, "label", "_n", bounded_share(coded.count()))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(text(books).encode()).hexdigest()).alias("codebooks_sha256"))
