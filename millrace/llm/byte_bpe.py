"""Byte-level BPE encoding and decoding against a rank file.

A text is cut into pieces by the vocabulary's pattern and each piece is encoded on its own.
Bytes are mapped to Latin-1 characters so that one Aho-Corasick automaton over the vocabulary
finds, in a single pass, the longest token that starts at each byte. From these the encoder
walks left to right, always trying the longest token first and falling back to the next
shorter one, or a step back, when two neighbouring tokens could not stand side by side in a
merged sequence. A sequence is what the merges yield exactly if all its neighbours are
compatible, so the walk reproduces the merges; each position is given up at most once, hence
linear time. Compatibility of a pair of tokens is memoised.
"""

from __future__ import annotations

import base64
import hashlib
import re
import threading
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Memo

#: White space as the pattern's \s means it: Unicode White_Space (Python's re adds \x1c-\x1f).
BLANK = r"\t-\r \x85\xa0  -     　"
# Fixed value: the pattern that STRETCH is made for. Texts are cut by it only under this pattern.
STRETCH_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Stretches that no match of the pattern crosses: a run of other characters with one blank
#: before it, and what is left of a run of blanks.
STRETCH = re.compile(rf" ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
#: Stretches are remembered in two generations of this many, and so many pairs of tokens: about 200 MB in each worker.
GENERATION, PAIRS = 300_000, 300_000
#: A worker that has had no text for so many seconds gives this memory back: other work may need it.
IDLE = 3.0


class Encoder:
    """Encodes and decodes with the ranks of a vocabulary in which every byte is a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the ranks lack {len(missing)} of the 256 bytes")
        self.token = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.token[i] = b
        self.length = list(map(len, self.token))
        self.code = "H" if len(self.token) <= 1 << 16 else "I"
        self.automaton = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self.shorter = [-1] * len(self.token)
        for b, i in ranks.items():
            self.shorter[i] = next((ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in ranks), -1)
        self.compatible = lru_cache(maxsize=PAIRS)(self._compatible)
        self.memo = Memo(self._stretch, GENERATION)
        self.timer: threading.Timer | None = None
        self.decimal = list(map(str, range(len(self.token))))

    def merged(self, piece: bytes) -> list[int]:
        """Merge the neighbours of lowest rank until none can merge: the definition, for short pieces."""
        parts = [piece[i: i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, len(self.ranks) + 1), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank > len(self.ranks):
                break
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _compatible(self, left: int, right: int) -> bool:
        return self.merged(self.token[left] + self.token[right]) == [left, right]

    def piece(self, piece: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        latin, n = piece.decode("latin-1"), len(piece)
        compatible = self.compatible
        ids = [i for _, (_, i) in self.automaton.iter_long(latin)]
        if all(map(compatible, ids, ids[1:])):  # always the longest token: no step back was needed
            return ids
        length, shorter, from_ = self.length, self.shorter, self.automaton.iter_long
        open_at, longest = bytearray(b"\1") * (n + 1), {n: -1}  # the longest token at each byte that the walk comes to
        start = 0
        for token in ids:
            longest[start] = token
            start += length[token]
        ids, at, last, candidate = [], 0, -1, ids[0]
        while at < n:
            end = at + length[candidate]
            if open_at[end] and (last < 0 or compatible(last, candidate)):
                ids.append(candidate)
                if end not in longest:
                    longest[end] = next(from_(latin, end))[1][1]
                last, at, candidate = candidate, end, longest[end]
            elif shorter[candidate] >= 0:
                candidate = shorter[candidate]
            else:  # nothing fits here: never end a token here again, and shorten the one before
                open_at[at] = False
                candidate = ids.pop()
                at -= length[candidate]
                last = ids[-1] if ids else -1
        return ids

    def _stretch(self, stretch: str) -> bytes:
        """The ids of a stretch, packed: smaller than a tuple, and nothing that the garbage collector looks at."""
        return array(self.code, chain.from_iterable(self.piece(p.encode()) for p in self.pattern.findall(stretch))).tobytes()

    def encode(self, text: str) -> list[int]:
        if self.pattern.pattern != STRETCH_PATTERN:
            packed = self._stretch(text)
        else:
            packed = b"".join(map(self.memo.__getitem__, STRETCH.findall(text)))
        return array(self.code, packed).tolist()

    def rest(self) -> None:
        """Forget what was remembered unless wake() comes soon."""
        self.timer = threading.Timer(IDLE, self.forget)
        self.timer.daemon = True
        self.timer.start()

    def wake(self) -> None:
        if self.timer is not None:
            self.timer.cancel()

    def forget(self) -> None:
        self.memo = Memo(self._stretch, GENERATION)
        self.compatible.cache_clear()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@lru_cache(maxsize=1)
def _encoder(rank_file: bytes, pattern: str) -> Encoder:
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rank_file.splitlines())}
    return Encoder(ranks, pattern)


def encoder(path: str, pattern: str) -> Encoder:
    return _encoder(Path(path).read_bytes(), pattern)


def _per_text(docs: DataFrame, rank_file: bytes, pattern: str, schema: str, of) -> DataFrame:
    """Apply of(encoder, texts) to each Arrow batch; the rank file (about 1 MB) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared.value, pattern)
        enc.wake()
        for b in batches:
            for at in range(0, b.num_rows, 250):
                part = b.slice(at, 250)
                columns = of(enc, [t.as_py() or "" for t in part.column("text")])
                yield pa.record_batch([part.column("doc_id"), *columns.values()], ["doc_id", *columns])
        enc.rest()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def encode(docs: DataFrame, rank_file: bytes, pattern: str) -> DataFrame:
    """doc_id and ids (array<int>) of each row of docs(doc_id, text).

    Null texts count as empty and have no ids. Rows that repeat and null doc_ids are returned
    as they come; columns beside doc_id and text are ignored; an empty table gives no rows.
    """
    def of(enc, texts):
        return {"ids": pa.array([enc.encode(t) for t in texts], pa.list_(pa.int32()))}

    return _per_text(docs, rank_file, pattern, "doc_id long, ids array<int>", of)


def decode(encoded: DataFrame, rank_file: bytes, pattern: str) -> DataFrame:
    """doc_id and bytes (binary) of each row of encoded(doc_id, ids); null ids count as none."""
    shared = encoded.sparkSession.sparkContext.broadcast(rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared.value, pattern)
        for b in batches:
            yield pa.record_batch([b.column("doc_id"), pa.array([enc.decode(i.as_py() or []) for i in b.column("ids")], pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, rank_file: bytes, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of docs(doc_id, text).

    ids_sha256 is of the decimal ids joined by commas, decoded_sha256 of the bytes that the ids
    decode to. Nulls, repeated rows and other columns are treated as encode() does.
    """
    def of(enc, texts):
        n, ids_sha, text_sha = [], [], []
        for t in texts:
            ids = enc.encode(t)
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join(map(enc.decimal.__getitem__, ids)).encode()).hexdigest())
            text_sha.append(hashlib.sha256(enc.decode(ids)).hexdigest())
        return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha), "decoded_sha256": pa.array(text_sha)}

    return _per_text(docs, rank_file, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", of)
