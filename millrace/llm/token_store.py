"""Token ids in a content-addressed store.

A rolling hash over the ids of a document cuts its id stream into chunks, so that equal
passages give equal chunks wherever they stand. The files are

* ``raw/kind=chunk``: each distinct chunk once, as (hash, n, payload); the hash is BLAKE2b-128 of the payload,
  which holds the ids little-endian in 2 bytes (4 for vocabularies beyond 65,536);
* ``recipes``: one row per document in ascending doc_id order (part, nth in it, doc_id, start, n_tokens,
  hashes, root); start counts the ids of all documents before it, root is the Merkle root of its chunk hashes;
* ``manifest``: one row per part of the recipes (part, documents, start, n_tokens, root), root being the
  Merkle root of its documents' roots.

Encoding, cutting and hashing happen in one pass over the documents. Chunks a task has met
lately are dropped at once, the others meet by hash in one exchange.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm.common import Memo, bounded_share, discard, lookup, materialise, partitions

#: Ids of the rolling window, mean, least and most ids of a chunk.
WINDOW, MEAN, LEAST, MOST = 16, 256, 64, 1024
#: So many words, and so many pieces of words, are remembered in each of two generations.
WORDS, PIECES = 300_000, 400_000
#: So many hashes of chunks a task remembers in each of two generations, and so many roots are folded at once.
RECENT, FOLD = 500_000, 1024
HASH = 16
#: The normaliser and pre-tokeniser whose words and pieces PLAIN and PIECE cut.
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None}
#: Blanks beyond ASCII, and controls that Python splits at but the tokenizer may not.
ODD_BLANK = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
ASCII_BLANK = re.compile("[\t-\r ]+")
#: Words of printable ASCII without the apostrophe and of the letters of Latin-1, which no
#: normal form changes, and their pieces.
PLAIN = re.compile("[!-&(-~À-ÖØ-öø-ÿ]+")
PIECE = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-z0-9ß-öø-ÿ]+")
#: Texts of PLAIN words and ASCII blanks alone.
PLAIN_TEXT = re.compile("[\t-\r !-&(-~À-ÖØ-öø-ÿ]*")


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 stands for itself, the other bytes for the characters from U+0100 on.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def added_mark(content: str) -> tuple[str, str]:
    """What a text with this added token holds: its longest run without case, and its first word in lower case."""
    first = ([*content.split(), ""])[0].lower()
    runs = "".join(c if c.lower() == c.upper() else " " for c in first).split()
    return max(runs, key=len, default=""), first


class WordEncoder:
    """Encodes texts with a tokenizer whose pieces never cross white space, word by word.

    The ids of words and pieces are remembered. PLAIN words go to the tokenizer's model piece by piece; all
    others take its whole path, and so do whole texts that may hold one of its added tokens. A
    definition with another normaliser or pre-tokeniser than KNOWN takes the whole path with every text.
    """

    def __init__(self, definition: str) -> None:
        held = json.loads(definition)
        self.known = all(held.get(k) == v for k, v in KNOWN.items()) and not any(t.get("lstrip") or t.get("rstrip") for t in held.get("added_tokens") or [])
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenize = self.tokenizer.model.tokenize
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self.added = [added_mark(t["content"]) for t in held.get("added_tokens") or []]
        self.words, self.pieces = Memo(self._word, WORDS), Memo(self._piece, PIECES)

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.tokenize(piece)]).tobytes()

    def _word(self, word: str) -> bytes:
        if PLAIN.fullmatch(word):
            return b"".join(map(self.pieces.__getitem__, PIECE.findall(word.lower())))
        return self._whole(word)

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.known or any(mark in text and content in text.lower() for mark, content in self.added):
            return self._whole(text)
        if PLAIN_TEXT.fullmatch(text):
            return b"".join(map(self.pieces.__getitem__, PIECE.findall(text.lower())))
        words = [w for w in ASCII_BLANK.split(text) if w] if ODD_BLANK.search(text) else (text.lower() if text.isascii() else text).split()
        return b"".join(map(self.words.__getitem__, words))


@lru_cache(maxsize=1)
def word_encoder(definition: str) -> WordEncoder:
    return WordEncoder(definition)


@lru_cache(maxsize=1)
def _gear(size: int) -> np.ndarray:
    return np.random.default_rng(0).integers(0, 1 << 64, size, dtype=np.uint64)


def cut(ids: np.ndarray) -> list[int]:
    """Where the chunks of an id stream end."""
    h = _gear(1 << 16)[ids & 0xFFFF]
    span = 1
    while span < WINDOW:  # h[i] covers the last `span` ids; doubled each time
        h = h + np.concatenate([np.zeros(min(span, len(h)), np.uint64), h[:-span] << np.uint64(span)])
        span *= 2
    marks = np.flatnonzero(h < np.uint64((1 << 64) // (MEAN - LEAST))) + 1
    ends, at = [], 0
    for mark in [*marks.tolist(), len(ids)]:
        while mark - at > MOST:
            at += MOST
            ends.append(at)
        if mark - at >= LEAST or mark == len(ids) and mark > at:
            at = mark
            ends.append(at)
    return ends


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=HASH).digest()


def merkle(hashes: list[bytes]) -> bytes:
    """Root of a binary tree over the hashes; a last one without a partner moves up as it is."""
    while len(hashes) > 1:
        pairs = [digest(a + b) for a, b in zip(hashes[::2], hashes[1::2], strict=False)]
        hashes = pairs + hashes[len(pairs) * 2:]
    return hashes[0] if hashes else digest(b"")


class Recent:
    """Says whether a hash was met lately; what it forgets is only stored twice for a while."""

    def __init__(self, generation: int = RECENT) -> None:
        self.generation, self.young, self.old = generation, set(), set()

    def first(self, h: bytes) -> bool:
        if h in self.young:
            return False
        new = h not in self.old
        if len(self.young) >= self.generation:
            self.young, self.old = set(), self.young
        self.young.add(h)
        return new


CHUNK = "hash binary, n long, payload binary"
ROW = f"kind string, doc_id long, hashes array<binary>, root binary, {CHUNK}"


def write(docs: DataFrame, definition: str, end_id: int, path: str) -> None:
    """Encode docs(doc_id, text) and write the store below `path`.

    Null texts count as empty: they hold the end id alone. A null doc_id comes first, repeated
    doc_ids are each stored, ordered by their Merkle roots. Other columns are ignored. An empty
    table gives empty files.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = word_encoder(shared.value), Recent()
        end, width = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize
        for b in batches:
            for at in range(0, b.num_rows, 500):
                out: list[tuple] = []
                part = b.slice(at, 500)
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    data = enc.encode(text or "") + end
                    hashes, begin = [], 0
                    for to in cut(np.frombuffer(data, enc.dtype)):
                        chunk = data[begin * width: to * width]
                        hashes.append(digest(chunk))
                        if seen.first(hashes[-1]):
                            out.append(("chunk", None, None, None, hashes[-1], to - begin, chunk))
                        begin = to
                    out.append(("recipe", doc_id, hashes, merkle(hashes), None, begin, None))
                kinds = [pa.string(), pa.int64(), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
                names = [f.split()[0] for f in ROW.split(", ")]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # 16 bytes for each chunk of a shuffle partition
        for b in batches:
            fresh = []
            for h in b.column("hash").to_pylist():
                fresh.append(h is None or h not in seen)
                seen.add(h)
            yield b.filter(pa.array(fresh, pa.bool_()))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, ids = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            n = b.column("n").to_numpy()
            upto = ids + np.cumsum(n)
            new = [pa.array(np.full(len(n), part), pa.int32()), pa.array(np.arange(nth, nth + len(n)), pa.int64()), pa.array(upto - n, pa.int64())]
            yield pa.record_batch([*new, *b.columns], ["part", "nth", "within", *b.schema.names])
            nth, ids = nth + len(n), int(upto[-1]) if len(n) else ids

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ROW)
    # recipes, a fifteenth of the bytes, ride along: to write them apart first costs more than to exchange them
    # and are dealt one by one, for any number of documents may be equal
    rows = rows.repartition(F.coalesce("hash", F.monotonically_increasing_id().cast("string").cast("binary"))).mapInArrow(once, ROW)
    rows.write.partitionBy("kind").parquet(f"{path}/raw")
    raw = _raw(spark, path)

    order = ["doc_id", "root", "n"]
    sorted_ = raw.filter("kind = 'recipe'").select("doc_id", "n", "hashes", "root").repartitionByRange(partitions(spark), *order, F.xxhash64("hashes")).sortWithinPartitions(*order)
    placed = materialise(sorted_.mapInArrow(number, "part int, nth long, within long, doc_id long, n long, hashes array<binary>, root binary"), "recipes")
    sums = placed.groupBy("part").agg(F.sum("n").alias("n"))  # as many rows as partitions
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    recipes = placed.join(F.broadcast(before), "part").select("part", "nth", "doc_id", (F.col("before") + F.col("within")).alias("start"), F.col("n").alias("n_tokens"), "hashes", "root")
    recipes.write.parquet(f"{path}/recipes")
    discard(placed)
    _part_roots(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")


def _raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROW.replace("kind string, ", "") + ", kind string").parquet(f"{path}/raw")


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return _raw(spark, path).filter("kind = 'chunk'").select("hash", "n", "payload")


def _part_roots(recipes: DataFrame) -> DataFrame:
    """part, documents, start, n_tokens and root of each part: its documents' roots folded FOLD by FOLD.

    FOLD is a power of two, so that the folds of the folds give the root of the binary tree over all.
    """
    @F.pandas_udf("binary")
    def root(roots: pd.Series) -> pd.Series:
        return roots.map(lambda r: merkle(list(r)))

    level = recipes.select("part", "nth", F.lit(1).cast("long").alias("documents"), "start", "n_tokens", "root")
    most = recipes.agg(F.max("nth")).first()[0] or 0
    while True:
        level = level.groupBy("part", (F.col("nth") / FOLD).cast("long").alias("up")).agg(
            F.sum("documents").alias("documents"), F.min("start").alias("start"), F.sum("n_tokens").alias("n_tokens"),
            F.transform(F.array_sort(F.collect_list(F.struct("nth", "root"))), lambda s: s["root"]).alias("roots"))  # FOLD roots at most
        level = level.select("part", F.col("up").alias("nth"), "documents", "start", "n_tokens", root("roots").alias("root"))
        most //= FOLD
        if not most:
            return level.drop("nth")


def verify_manifest(spark: SparkSession, path: str) -> None:
    """Raise unless the recipes give the roots and totals that the manifest states."""
    stated = spark.read.parquet(f"{path}/manifest")
    found = _part_roots(spark.read.parquet(f"{path}/recipes")).select(*stated.columns)
    both = found.withColumn("side", F.lit(1)).unionByName(stated.withColumn("side", F.lit(-1)))
    if not both.groupBy(*stated.columns).agg(F.sum("side").alias("side")).filter("side <> 0").isEmpty():
        raise ValueError(f"the recipes in {path} differ from their manifest")


def _joined(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """The chunks of each document in turn, with the columns of known(hash, ...).

    Chunks that stand in a two-thousandth of all places or more are looked up by broadcast: there are
    two thousand of them at most. The others meet by hash.
    """
    recipes = spark.read.parquet(f"{path}/recipes")
    steps = recipes.select("start", "doc_id", "n_tokens", "root", F.posexplode("hashes").alias("pos", "hash"))
    share = bounded_share(int(recipes.agg(F.sum(F.size("hashes"))).first()[0] or 0))
    often = F.broadcast(steps.groupBy("hash").agg(F.count(F.lit(1)).alias("uses")).filter(F.col("uses") > share))
    return lookup(steps, known.join(often, "hash", "left").withColumn("uses", F.coalesce("uses", F.lit(0))), "hash", "uses", share)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (array<int>) of each stored document, verified.

    Raises if a chunk's bytes or a document's root aren't what the store says.
    """
    joined = _joined(spark, path, _chunks(spark, path))
    joined = joined.repartition("start").sortWithinPartitions("start", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def whole() -> tuple:
            start, doc_id, n, root = key
            if any(p is None for p, _ in held):
                raise ValueError(f"document {doc_id} at {start} can't be verified")
            data = b"".join(p for p, _ in held)
            ids = np.frombuffer(data, np.dtype(f"<u{len(data) // sum(c for _, c in held)}"))
            if merkle([digest(p) for p, _ in held]) != root or len(ids) != n:
                raise ValueError(f"document {doc_id} at {start} can't be verified")
            return doc_id, start, n, ids

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            a, b, c, d = zip(*rows, strict=True)
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array([x.astype(np.int32) for x in d], pa.list_(pa.int32()))], ["doc_id", "start", "n_tokens", "ids"])

        for b in batches:
            out = []
            for start, doc_id, n, root, payload, count in zip(*(b.column(c).to_pylist() for c in ("start", "doc_id", "n_tokens", "root", "payload", "n")), strict=True):
                if key is not None and start != key[0]:
                    out.append(whole())
                    held = []
                key = (start, doc_id, n, root)
                held.append((payload, count))
            if out:
                yield batch(out)
        if held:
            yield batch([whole()])

    return joined.mapInArrow(run, "doc_id long, start long, n_tokens long, ids array<int>")


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo that of CRC-32, bit-reflected."""
    product = np.zeros(np.broadcast(a, b).shape, np.uint32)
    for bit in reversed(range(32)):
        product ^= np.where(a >> np.uint32(bit) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return product


@lru_cache(maxsize=1)
def _shifts() -> np.ndarray:
    """[i, j]: what a CRC-32 is multiplied by when j * 1024^i further ids of 4 bytes follow."""
    table, step = np.empty((4, 1024), np.uint32), np.uint32(1 << 31 - 8)  # one byte
    step = _times(_times(step, step), _times(step, step))
    for row in table:
        row[0] = 1 << 31
        power = np.array(step, np.uint32)
        for bit in range(10):
            row[1 << bit: 2 << bit] = _times(row[: 1 << bit], power)
            power = _times(power, power)
        step = power
    return table


def fold_crc32(crcs: np.ndarray, counts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """CRC-32 of each run offsets[i]:offsets[i + 1] of pieces end to end, from the pieces' CRC-32s
    and numbers of ids (4 bytes each); up to 2^40 ids a run."""
    total = np.concatenate([[0], np.cumsum(counts)])
    run = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    after = total[offsets[1:]][run] - total[1:]
    part = crcs.astype(np.uint32)
    for i, table in enumerate(_shifts()):
        digit = after >> 10 * i & 1023
        if digit.any():
            part = _times(table[digit], part)
    out = np.zeros(len(offsets) - 1, np.uint32)
    np.bitwise_xor.at(out, run, part)
    return out.astype(np.int64)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids in 4 bytes) of each stored document, verified.

    Each stored chunk is read, checked against its hash and summed once; a document's sum is
    put together from those of its chunks, so no payload is moved. Raises like read().
    """
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc, size = [], b.column("n").to_pylist()
            for h, n, payload in zip(b.column("hash").to_pylist(), size, b.column("payload").to_pylist(), strict=True):
                if digest(payload) != h:
                    raise ValueError(f"chunk {h.hex()} can't be verified")
                crc.append(zlib.crc32(np.frombuffer(payload, np.dtype(f"<u{len(payload) // n}")).astype("<u4").tobytes()))
            yield pa.record_batch([b.column("hash"), pa.array(crc, pa.int64()), b.column("n")], ["hash", "crc", "n"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, crcs, counts = (b.column(c) for c in ("hashes", "crcs", "counts"))
            ends, n = np.asarray(hashes.offsets), np.asarray(counts.flatten())
            hashes = hashes.flatten().to_pylist()
            for i, (doc_id, start, root, total) in enumerate(zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "root", "n_tokens")), strict=True)):
                own = slice(ends[i] - ends[0], ends[i + 1] - ends[0])
                if crcs.slice(i, 1).flatten().null_count or merkle(hashes[own]) != root or n[own].sum() != total:
                    raise ValueError(f"document {doc_id} at {start} can't be verified")
            crc = fold_crc32(np.asarray(crcs.flatten()), n, np.asarray(ends) - ends[0])
            yield pa.record_batch([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    known = materialise(_chunks(spark, path).mapInArrow(sums, "hash binary, crc long, n long"), "sums")
    steps = _joined(spark, path, known).groupBy("start", "doc_id", "n_tokens", "root").agg(
        F.array_sort(F.collect_list(F.struct("pos", "hash", "crc", "n"))).alias("steps"))
    steps = steps.select("start", "doc_id", "n_tokens", "root", F.col("steps.hash").alias("hashes"), F.col("steps.crc").alias("crcs"), F.col("steps.n").alias("counts"))
    return steps.mapInArrow(fold, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_and_check(docs: DataFrame, definition: str | Path, end_id: int, path: str) -> DataFrame:
    """Write the store, verify its manifest, and return the digests read back from it."""
    write(docs, definition if isinstance(definition, str) else definition.read_text(), end_id, path)
    verify_manifest(docs.sparkSession, path)
    return read_digests(docs.sparkSession, path)
